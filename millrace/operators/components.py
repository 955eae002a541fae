"""Connected components over an edge table, by alternating star contraction.

Edges first contract inside each partition (a union-find with bounded memory), which leaves at most
one edge a node and partition.  Large-star and small-star rounds (Kiveris and others, 2014) then
take O(log^2 n) rounds in practice, each a minimum per node and a join back.  The links of a node
are dealt over up to ``PARTS`` parts, so one with very many links is no single task's.  No links or
labels reach the driver, only a count and a checksum a round; each round's table is deleted once
the next one is written.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.shared import dropped, written


class Forest:
    """Union-find over integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        r = x
        while (p := parent.get(r, r)) != r:
            r = p
        while (p := parent.get(x, x)) != r:
            parent[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Nodes that one partition's union-find holds before it is emptied.
HELD_NODES = 2_000_000
#: Parts over which the links of one node are dealt.
PARTS = 64


def _contract(rows):
    forest = Forest()

    def out():
        pairs = [(x, forest.root(x)) for x in list(forest.parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        for at in range(0, len(pairs), 100_000):
            part = pairs[at : at + 100_000]
            yield pa.record_batch([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], schema=EDGES)

    for batch in rows:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.parent) > HELD_NODES:
            yield from out()
            forest = Forest()
    yield from out()


def _with_least(rows: DataFrame, key: str, other: str) -> DataFrame:
    """``rows(key, other)`` with m, the least ``other`` of each key, and no task that holds all rows of a key.

    Rows of a key are dealt by the other node too; minima are taken in two steps, and go back to
    those parts of a key that hold rows, so a key costs a row a part and never more than its rows.
    """
    part = F.pmod(F.xxhash64(other), F.lit(PARTS)).cast("int").alias("part")
    dealt = rows.select(key, other, part)
    halves = dealt.groupBy(key, "part").agg(F.min(other).alias("m"))
    whole = halves.groupBy(key).agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))
    return dealt.join(whole.select(key, "m", F.explode("parts").alias("part")), [key, "part"]).drop("part")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    found = _with_least(both, "a", "b").where("b > a")
    return found.select(F.col("b").alias("u"), F.least("a", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_least(edges, "u", "v")
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(found.where("v = m").select("u", "v")).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``, two BIGINT columns without nulls.

    ``component`` is the smallest node reachable; the root itself gets a row too.  Self loops and
    repeated edges are allowed, an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = written(pairs.mapInArrow(_contract, "u long, v long"), name)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        after = written(_small_star(_large_star(now)), name)
        dropped(spark, now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
