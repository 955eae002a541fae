"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint is eight bytes.  Two that differ in at most ``k`` bits differ in at most ``k`` bytes,
so they share the byte at 8-k or more positions.  Postings of single (position, byte) pairs would
hold 1/256 of all documents each, so the index posts triples of positions, chosen (Turan's
construction) so that every set of 8-k positions holds one: each true pair meets in a list, and a
list is 2^24 times shorter than the table.  Within a list the shared positional bytes of a pair are
tallied, pairs below the guaranteed minimum go, and the rest are verified bit by bit.

Only distinct fingerprints are indexed, each list yields a spanning forest of its verified links
(never all pairs of a group), and components are found by star contraction.  A list of over ``LONG``
fingerprints, as the variants of one boilerplate text make, is not compared in one task but dealt
again: the bits that vary in it are cut into k+1 blocks, of which a true pair leaves one unchanged,
so each member posts k+1 longer agreements, until every list is short (varying bits shrink each
time, and v of them make 2^v fingerprints at most).  All lists are tallied and verified alike.

Text rules: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, features are 4-word shingles
with repeats (a shorter text is one shingle), hashed by XXH64 with seed 42.  Null and wordless
texts have fingerprint zero and link like any other; a null doc_id is a row of its own that takes
its component from the others; repeated rows stay repeated; very long texts are streamed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, Forest, as_bytes, batches, dropped, freed, groups, written
from millrace.operators.components import connected_components

SEED, SHINGLE = 42, 4
#: Fingerprints of a posting list beyond which it is dealt again by longer agreements.
LONG = 4_096
#: Hashes tallied at once, which bounds memory for a very long text.
CHUNK = 65_536


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of one text, after lower-casing A-Z."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, join, ones = xxhash.xxh64_intdigest, b" ".join, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        if width == 4 and len(words) >= 4:
            part = words[at : at + CHUNK + 3]
            hashes = [digest(b"%b %b %b %b" % x, SEED) for x in zip(part, part[1:], part[2:], part[3:], strict=False)]
        else:
            hashes = [digest(join(words[i : i + width]), SEED) for i in range(at, min(n, at + CHUNK))]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def _fingerprints(rows):
    for batch in batches(rows, 2_000, 4 << 20):
        prints = [fingerprint(x) for x in as_bytes(batch.column(batch.num_columns - 1))]
        yield pa.record_batch([*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*batch.schema.names[:-1], "fp"])


def with_fingerprints(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the signed fingerprint of ``text``."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(freed(_fingerprints), f"{fields}, fp long" if fields else "fp long")


def position_sets(k: int) -> list[tuple[int, ...]]:
    """Triples of byte positions of which every set of 8-k positions holds at least one."""
    if not 1 <= k <= 4:
        raise ValueError("k must be 1 to 4")
    if k < 4:
        parts = [range(0, 4), range(4, 8)]
        return [t for p in parts for t in combinations(p, 3)]
    a, b, c = range(0, 3), range(3, 6), range(6, 8)
    return [tuple(sorted(t)) for p, q in ((a, b), (b, c), (c, a)) for t in [*combinations(p, 3), *((*two, one) for two in combinations(p, 2) for one in q)]]


def index_keys(fp: Column, k: int) -> Column:
    """One key a posting list: the number of the position triple and its three bytes."""
    byte = lambda p: F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long"))
    keys = []
    for i, (x, y, z) in enumerate(position_sets(k)):
        keys.append(F.lit(i << 24).cast("long") + F.shiftleft(byte(x), 16) + F.shiftleft(byte(y), 8) + byte(z))
    return F.array(*keys)


def _tallied(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Which pairs share the byte at 8-k positions or more and, verified, differ in at most k bits."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    ok = shared >= 8 - k
    ok[ok] = np.bitwise_count(x[ok]) <= k
    return ok


def _frontier_links(fp: np.ndarray, k: int):
    """A spanning forest of one list: each newly reached member is compared with all unreached ones."""
    left = fp
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = _tallied(left, np.full(len(left), x), k)
            yield from ((int(x), int(y)) for y in left[near])
            reached.extend(left[near])
            left = left[~near]


def _links(k: int):
    def run(rows):
        forest = Forest()

        def out(pairs):
            pairs = [(a - (a >> 63 << 64), b - (b >> 63 << 64)) for a, b in pairs]
            return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

        for part in groups(rows, "key"):
            key = part.column("key").to_numpy()
            fp = part.column("fp").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            found: list[tuple[int, int]] = []
            small = np.repeat(size <= 32, size)
            for step in range(1, 32):
                if step >= len(key):
                    break
                both = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
                if not len(both):
                    break
                both = both[_tallied(fp[both], fp[both + step], k)]
                found += zip(fp[both].tolist(), fp[both + step].tolist(), strict=True)
            for at, n in zip(starts[size > 32].tolist(), size[size > 32].tolist(), strict=True):
                own = np.unique(fp[at : at + n])
                found += _frontier_links(own, k)
            found = [p for p in found if forest.join(*p)]
            if found:
                yield out(found)
            if len(forest.parent) > 1_000_000:
                forest = Forest()

    return run


def _blocks(k: int):
    """Of (key, varying): k+1 masks a list, each of some of its varying bits."""

    def run(rows):
        for batch in rows:
            keys, masks = [], []
            for key, varying in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                free = [b for b in range(64) if varying >> b & 1]
                for part in range(k + 1):
                    mask = sum(1 << b for b in free[part :: k + 1])
                    keys.append(key)
                    masks.append(mask - (mask >> 63 << 64))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(masks, pa.int64())], names=["key", "mask"])

    return run


def posting_lists(prints: DataFrame, k: int, long: int = LONG, made: list | None = None):
    """Yields (key, fp) tables of posting lists of at most ``long`` members in which all true pairs meet.

    ``prints`` has distinct ``fp``.  The driver only learns whether there are long lists.  Tables
    that the lists are read from are added to ``made``.
    """
    made = [] if made is None else made
    rows = prints.select(F.explode(index_keys(F.col("fp"), k)).alias("key"), "fp")
    while True:
        varying = F.expr("bit_or(fp) & ~bit_and(fp)").alias("varying")
        large = rows.groupBy("key").agg(F.count("*").alias("n"), varying).where(F.col("n") > long).select("key", "varying")
        large = written(large, "long-lists")
        made.append(large)
        if large.isEmpty():
            yield rows
            return
        yield rows.join(large, "key", "left_anti")
        masks = written(large.mapInArrow(_blocks(k), "key long, mask long"), "list-blocks")
        # A new key is a hash of the old one and of the further bits agreed on; what a collision brings together is verified.
        rows = written(rows.join(masks, "key").select(F.xxhash64("key", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp"), "postings")
        made += [masks, rows]


def hamming_components(prints: DataFrame, k: int = 4, long: int = LONG) -> DataFrame:
    """(fp, component) for those distinct ``fp`` of ``prints`` that link to another one.

    Fingerprints link at ``k`` or fewer differing bits; ``component`` is the smallest fingerprint
    reachable, as a signed number.  Fingerprints without links have no row.
    """
    links, made = None, []
    for lists in posting_lists(prints.select("fp").distinct(), k, long, made):
        found = lists.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(k), "u long, v long")
        links = found if links is None else links.union(found)
    found = connected_components(links, "simhash").withColumnRenamed("node", "fp")
    dropped(prints.sparkSession, *made)
    return found


def _classed(prints: DataFrame, k: int) -> DataFrame:
    """(fp, component) for every distinct ``fp``."""
    distinct = written(prints.select("fp").distinct(), "distinct-prints")
    linked = hamming_components(distinct, k)
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed), fingerprint (hex) and component_id: the smallest doc_id reachable.

    One row per row of ``docs``.  component_id is null only where no row of the component has an id.
    """
    prints = written(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), text), "doc_id", text=text), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classed = written(_classed(prints, k).join(least, "fp"), "classes")
    label = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = classed.join(label, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, k: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, then text hash.

    Extra columns stay.  Of repeated rows one stays; rows without doc_id come last in the order.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64(text)))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", key.alias("key"))
    prints = written(with_fingerprints(keyed, "doc_id", "key"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "key")).alias("first")
    per_print = prints.groupBy("fp").agg(first)
    heads = per_print.join(_classed(prints, k), "fp").groupBy("component").agg(F.min("first").alias("first"))
    heads = written(heads.select(F.col("first.key").alias("key")), "heads")
    dropped(docs.sparkSession, prints)
    return keyed.select("row", "key").join(heads, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
