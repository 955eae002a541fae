"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is r times its size is taken floor(r) times for certain and
once more with probability p = r - floor(r).  Probabilities are rounded in pairs: two documents
move mass between them, at constant expected words (a.p + b.q stays), in a random direction whose
chances keep both expectations, until one of them is 0 or 1.  So a source's taken words differ from
its target by less than one document.

Each block of a source rounds its documents one after another and leaves one residual; residuals
are combined block by block in a tree, each level a distributed pass over 1/4096 of the rows before,
until a source has one left, which is settled by a coin of its own probability.  Blocks and coins
depend on ids and texts only, so reruns and other partitionings agree.

Null texts and wordless ones have size 0 and are taken once or twice as r says without rounding any
words; null sources form the last source; rows that repeat id and text may be taken differently.
"""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import native_words, written

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of a block, and residuals combined at once.
FAN_IN = 4096
EDGE = 1e-9


def pivot(a: float, p: float, b: float, q: float, coin: float) -> tuple[float, float]:
    """Moves mass between probabilities p and q of sizes a and b until one is 0 or 1; a.p + b.q stays."""
    up = min((1 - p) * a, q * b)
    down = min(p * a, (1 - q) * b)
    move = up if coin * (up + down) < down else -down
    p, q = p + move / a, q - move / b
    snap = lambda x: 0.0 if x < EDGE else 1.0 if x > 1 - EDGE else x
    return snap(p), snap(q)


def water_filled(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """target for each row of ``sources(source_size, weight)``: its weighted share, at most cap times its size.

    The excess of capped sources is reshared by weight among the others until none is above.  Only
    two sums and the cap set's count reach the driver each round.
    """
    limit = F.col("source_size") * cap
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= limit
        held, weight, n = sources.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == capped or not weight:
            break
        capped, level = n, max(0.0, budget - (held or 0.0)) / weight
    share = F.least(F.col("weight") * F.lit(level if level is not None else 0.0), limit)
    return sources.withColumn("target", limit if not weight and n else share)


def ranked(sources: DataFrame, weights) -> DataFrame:
    """(source, rank, weight): sources by code point, null last, with weights in turn, without one sorting task."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    kind = sources.schema["source"].dataType.simpleString()
    numbered = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    frame = sources.sparkSession.createDataFrame(numbered, f"source {kind}, rank long")
    return frame.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))


def _coins(seed: int, level: int, group: str, block: int) -> random.Random:
    return random.Random(hashlib.sha256(f"{seed}|{level}|{group}|{block}".encode()).digest())


def _rounded(seed: int, level: int):
    """One level of the tree over rows sorted by (g, block, rank): p becomes 0 or 1, but for one row a block."""

    def run(rows):
        now, held, coins = None, None, None
        for batch in rows:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = {"row": [], "p": [], "g": [], "size": [], "block": []}

            def emit(x, out=out):
                for k, v in zip(out, x, strict=True):
                    out[k].append(v)

            for row, p, g, size, block in zip(cols["row"], cols["p"], cols["g"], cols["size"], cols["block"], strict=True):
                if (g, block) != now:
                    if held:
                        emit(held)
                    now, held, coins = (g, block), None, _coins(seed, level, g, block)
                if not 0.0 < p < 1.0:
                    emit((row, p, g, size, block))
                elif held is None:
                    held = (row, p, g, size, block)
                else:
                    p0, q0 = pivot(held[3], held[1], size, p, coins.random())
                    a, b = (held[0], p0, *held[2:]), (row, q0, g, size, block)
                    held = a if 0.0 < p0 < 1.0 else None
                    if held is None:
                        emit(a)
                    if 0.0 < q0 < 1.0:
                        held = b
                    else:
                        emit(b)
            yield _mass(out)
        if held:
            yield _mass({k: [v] for k, v in zip(("row", "p", "g", "size", "block"), held, strict=True)})

    return run


def _mass(out: dict) -> pa.RecordBatch:
    kinds = {"row": pa.int64(), "p": pa.float64(), "g": pa.string(), "size": pa.int64(), "block": pa.int64()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _level(rows: DataFrame, seed: int, level: int) -> DataFrame:
    cols = ("row", "p", "g", "size", "block")
    dealt = rows.select(*cols).repartition("g", "block").sortWithinPartitions("g", "block", "row", "size")
    return written(dealt.mapInArrow(_rounded(seed, level), "row long, p double, g string, size long, block long"), "mass")


def rounded(mass: DataFrame, seed: int = 0) -> DataFrame:
    """(row, g, size, p) with p 0 or 1 for ``mass(row, g, size, p)``: all levels of the tree."""
    counts = mass.groupBy("g").agg(F.count("*").alias("n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN_IN)).cast("long")
    now = _level(mass.join(counts, "g").withColumn("block", F.pmod(F.xxhash64("row", "size"), blocks)), seed, 0)
    settled, level = [], 1
    while True:
        settled.append(now.where("p = 0 or p = 1"))
        left = now.where("p > 0 and p < 1")
        top = left.agg(F.max("block")).first()[0]
        if top is None:
            break
        if top == 0:
            coin = F.pmod(F.xxhash64("row", "g", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
            settled.append(left.withColumn("p", F.when(coin < F.col("p"), 1.0).otherwise(0.0)))
            break
        now, level = _level(left.withColumn("block", F.floor(F.col("block") / FAN_IN)), seed, level), level + 1
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("row", "g", "size", "p")


def row_hash(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)


def mixed(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """doc_id, text_hash, size, source_size, target and copies, a row per row of ``docs``.

    ``share`` of all words is dealt to sources by ``weights``; ``cap`` bounds a source's target, and
    so a document's copies, at that many times its size.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "source", F.size(native_words(text)).cast("long").alias("size"), F.xxhash64(text).alias("t"))
    base = base.withColumn("g", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    base = written(base, "sizes")
    sizes = written(base.groupBy("source", "g").agg(F.sum("size").alias("source_size")), "sources")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    weighted = sizes.join(ranked(sizes.select("source"), weights).withColumn("g", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))).drop("source"), "g")
    targets = written(water_filled(written(weighted, "weights"), share * total, cap), "targets").select("g", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    # Sizes only matter in whole documents: p is the chance of one more copy than floor(ratio).
    planned = base.join(targets, "g").withColumn("ratio", F.least(ratio, F.lit(cap))).withColumn("sure", F.floor(F.col("ratio") + EDGE))
    part = F.greatest(F.lit(0.0), F.col("ratio") - F.col("sure"))
    planned = planned.withColumns({"p": F.when((F.col("size") > 0) & (part > EDGE), part).otherwise(0.0), "row": row_hash("doc_id", "t")})
    # Rows that repeat id and text share a key; each is rounded by itself and they are handed out in turn.
    extra = rounded(planned.where("p > 0").select("row", "g", "size", "p"), seed).groupBy("g", "row").agg(F.sum("p").cast("long").alias("ones"), F.count("*").alias("times"))
    joined = planned.join(extra, ["g", "row"], "left")
    return joined.select("doc_id", "source", F.col("t").alias("text_hash"), "size", "source_size", "target", "sure", "row", "g", "ones", "times")


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words, repeats counted), a row per row of ``docs``."""
    rows = mixed(docs, **options)
    once = rows.where("times is null or times = 1").withColumn("copies", F.col("sure") + F.coalesce("ones", F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("g", "row").orderBy("doc_id"))
    more = rows.where("times > 1").withColumn("copies", F.col("sure") + (turn <= F.col("ones")).cast("long"))
    both = once.unionByName(more)
    return both.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns kept, whatever their names."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    key = lambda t: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), source, F.hex(t)).alias("key")
    plan = taken(docs, **options).groupBy(key(F.col("text_hash"))).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key(F.xxhash64(F.coalesce("text", F.lit("")))))
    joined = keyed.join(plan, "key")
    # Rows that repeat everything are equal, so their copies are dealt evenly, the rest to the first ones.
    turn = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    alone = joined.where("rows = 1").select("row", F.col("copies").alias("own"))
    even = F.floor(F.col("copies") / F.col("rows")) + (F.col("turn") <= F.col("copies") % F.col("rows")).cast("long")
    repeated = joined.where("rows > 1").withColumn("turn", turn).select("row", even.alias("own"))
    both = alone.unionByName(repeated).where("own > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own").cast("long")))).select("row.*")
