"""Sharding by histogram sort: equal bytes a shard, in one exchange.

Rows are ordered by (XXH64 of the text, doc_id): a shuffled order that keeps equal texts together.
Splitters of this order are found by counting only.  Each round sends a bounded set of probe keys
to all partitions, which return the exact bytes and rows below each; every splitter keeps the
interval that brackets its goal and probes it more finely, until a probe lies within the tolerance.
Then rows move once, to the sub-range between two splitters, and are numbered by exact counts that
the last histogram already holds: a shard is many sub-ranges, so no task ever sorts a whole shard.

The law is ``bytes``.  A splitter prefers a boundary between texts; a group of equal texts is split
(by doc_id) only where it is itself too large to fall on one side.  Null texts count as empty; null
doc_ids come first among equal texts; rows that repeat both stay together, in any order, and are the
only ones that cannot be split.  doc_id may have any type; ids that are no whole numbers are ordered
by their XXH64.  Working columns take names that the input does not have.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from ._common import dropped, free_names, let, written

#: Probes of each unsettled splitter a round, and the rounds after which the best probe is taken.
PROBES, ROUNDS = 24, 40
#: Bytes of a sub-range, which is one task of a shard's sort; sub-ranges of a shard, at least and at most.
SUB_BYTES, LEAST_SUB, MOST_SUB = 256 << 20, 8, 1024
LOW = -(1 << 63)


def _key(h: int, d: int) -> bytes:
    return (h - LOW).to_bytes(8, "big") + (d - LOW).to_bytes(8, "big")


def _number(key: bytes) -> int:
    return int.from_bytes(key, "big")


def _keys(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    flip = np.uint64(1 << 63)
    both = np.stack([h.view(np.uint64) ^ flip, d.view(np.uint64) ^ flip], 1).astype(">u8")
    return both.view("S16").ravel()


def _histogram(probes: list[bytes]):
    edges = np.array(probes, "S16")

    def run(rows):
        size, count = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in rows:
            keys = _keys(batch.column("h").to_numpy(), batch.column("d").to_numpy())
            at = np.searchsorted(edges, keys, side="right")
            np.add.at(size, at, batch.column("size").to_numpy())
            count += np.bincount(at, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(size[some], pa.int64()), pa.array(count[some], pa.int64())], names=["at", "size", "rows"])

    return run


def _below(rows: DataFrame, probes: list[bytes]) -> tuple[list[int], list[int]]:
    """The exact bytes and rows with keys below each probe: one scan, one row a probe to the driver."""
    got = rows.mapInArrow(_histogram(probes), "at long, size long, rows long").groupBy("at").agg(F.sum("size"), F.sum("rows")).collect()
    size, count = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for at, s, n in got:
        size[at], count[at] = s, n
    return np.cumsum(size)[:-1].tolist(), np.cumsum(count)[:-1].tolist()


def splitters(rows: DataFrame, goals: Sequence[float], tolerance: float, ids: tuple[int, int] = (LOW, -LOW - 1)) -> list[tuple[bytes, int]]:
    """For each goal, in bytes: (key, rows below it) with the bytes below within ``tolerance`` of it.

    ``rows`` has h, d (within ``ids``) and size.  A key is never dropped for lack of rounds: the closest probe stands.
    """
    top = (1 << 128) - 1
    span = [(0, top)] * len(goals)
    best: list[tuple[float, bytes, int] | None] = [None] * len(goals)
    for _ in range(ROUNDS):
        live = [i for i, b in enumerate(best) if (b is None or b[0] > tolerance) and span[i][1] - span[i][0] > 1]
        if not live:
            break
        wanted = set()
        for i in live:
            low, high = span[i]
            # Whole texts first; below one text the doc_id decides.
            unit = 1 << 64 if (high >> 64) - (low >> 64) > 1 else 1
            if unit == 1:
                base = low >> 64 << 64
                low, high = span[i] = max(low, base + ids[0] - LOW), min(high, base + ids[1] - LOW + 1)
            a, b = -(-low // unit), high // unit
            wanted |= {min(top, max(1, (a + (b - a) * j // PROBES) * unit)) for j in range(1 if unit == 1 else 0, PROBES + 1)}
        probes = [x.to_bytes(16, "big") for x in sorted(wanted)]
        size, count = _below(rows, probes)
        numbers = [_number(p) for p in probes]
        for i, goal in enumerate(goals):
            low, high = span[i]
            for x, p, s, n in zip(numbers, probes, size, count, strict=True):
                if best[i] is None or abs(s - goal) < best[i][0]:
                    best[i] = (abs(s - goal), p, n)
                if s <= goal:
                    low = max(low, x)
                else:
                    high = min(high, x)
            span[i] = (low, max(low, high))
    out = sorted((b[1], b[2]) for b in best if b is not None)
    return out


def histogram_sharded(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, sub_bytes: int = SUB_BYTES) -> DataFrame:
    """The rows of ``docs`` with size (UTF-8 bytes and one), shard and slot (gapless from 0 in each shard).

    ``tolerance`` is the share of a shard by which each splitter may miss its goal.  The columns of
    ``docs`` stay; its own columns size, shard or slot would be replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce("text", F.lit(""))
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    d = F.coalesce(F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.lit(LOW))
    # No struct of the whole row: columns that a caller does not read are not to be shuffled.
    base = docs.drop("size", "shard", "slot")
    h, dd, part, n, place = free_names(base, "__h", "__d", "__part", "__n", "__place")
    sized = base.withColumns({h: F.xxhash64(text), dd: d, "size": (F.octet_length(text) + 1).cast("long")})
    keys = written(sized.select(F.col(h).alias("h"), F.col(dd).alias("d"), "size"), "keys")
    total, *ids = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.min("d"), F.lit(0)), F.coalesce(F.max("d"), F.lit(0))).first()
    sub_ranges = min(MOST_SUB, max(LEAST_SUB, -(-total // (shards * sub_bytes))))
    parts = shards * sub_ranges
    # Shard bounds are found within the tolerance, the sub-ranges inside a shard only roughly.
    bounds = splitters(keys, [total * i / shards for i in range(1, shards)], max(1.0, tolerance * total / shards), tuple(ids))
    inner = splitters(keys, [total * i / parts for i in range(1, parts) if i % sub_ranges], max(1.0, 0.2 * total / parts), tuple(ids))
    dropped(docs.sparkSession, keys)
    cuts = sorted([(k, 0, n) for k, n in bounds] + [(k, 1, n) for k, n in inner])
    shard, start, shard_start, places = 0, 0, 0, []
    for _, kind, below in cuts:
        places.append({"shard": shard, "start": start - shard_start})
        start = below
        if kind == 0:
            shard, shard_start = shard + 1, below
    places.append({"shard": shard, "start": start - shard_start})
    flip = lambda x: int.from_bytes(x, "big") + LOW
    # As text, so that thousands of bounds are one constant of the plan.
    listed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<struct<{kind}>>")
    me = F.struct(F.col(h).alias("h"), F.col(dd).alias("d"))
    edges = listed([{"h": flip(k[:8]), "d": flip(k[8:])} for k, _, _ in cuts], "h: long, d: long")
    routed = sized.withColumn(part, _bisected(edges, me, len(cuts)) if cuts else F.lit(0)).repartition(len(cuts) + 1, part)
    order = Window.partitionBy(part).orderBy(h, dd)
    at = F.element_at(listed(places, "shard: int, start: long"), F.col(part) + 1)
    numbered = routed.withColumn(n, F.row_number().over(order)).withColumn(place, at)
    out = numbered.withColumns({"shard": F.col(place)["shard"], "slot": F.col(place)["start"] + F.col(n) - 1})
    return out.drop(h, dd, part, n, place)


def _bisected(edges, me, n: int):
    """How many edges are at most ``me``, by a search in about log2(n) comparisons."""
    at = F.lit(0)
    step = 1 << max(0, n.bit_length() - 1)

    def refine(at, step):
        if not step:
            return at
        nxt = let(at, lambda a: F.when((a + step <= n) & (F.try_element_at(edges, F.when(a + step <= n, a + step).otherwise(1)) <= me), a + step).otherwise(a))
        return refine(nxt, step // 2)

    return refine(at, step)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes each shard as a folder of Parquet files whose names follow the order of slots."""
    sharded.write.partitionBy("shard").parquet(path)
