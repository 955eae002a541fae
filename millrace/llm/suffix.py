"""Removal of repeated 200-byte strings by a suffix sort.

A suffix array of every byte does not fit a cluster's disks, so the sort runs over those suffixes
that can matter.  Each 200-byte window of a text elects an anchor, the k-byte string of least hash
in it (leftmost on ties): equal windows elect equal anchors at equal places, so all occurrences of
a repeated window meet at one anchor hash.  About one byte in 80 is an anchor, and an anchor's
context is the text of all windows that elected it.

1. Anchors that occur once go.  Where all contexts of an anchor are equal, all its windows repeat.
   Whole contexts are compared by two independent 64-bit hashes (XXH3 and a polynomial), not by bytes.
2. For the rest, the distinct contexts of an anchor come together, and all their window suffixes
   are sorted: by their first eight bytes, ties by the next eight, and so on, vectorised over all
   anchors of a batch.  What is still tied after 200 bytes is equal, so no hash decides there.
3. The windows found are merged to byte runs per text and cut out, all judged on the input.

Nothing depends on how many copies there are: contexts are counted before they are gathered, so a
group of copies arrives as one context and a count.  The suffixes of an anchor with very many
places, such as the edge of a passage that a third of all documents share, are not sorted in one
task: they are dealt over all tasks by their distance from the anchor and the polynomial hash of
their 200 bytes, which puts equal ones together, and a second, independent hash verifies them (no
bytes are compared there).  Null is an empty text; texts under 200 bytes lose nothing; repeated rows are copies of each other; null doc_ids are kept apart by text only.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import POWERS, as_bytes, batches, dropped, freed, groups, written

LENGTH, ANCHOR = 200, 32
#: Window suffixes sorted at once in one task.
BATCH_SUFFIXES = 1_000_000
#: Places of an anchor beyond which its suffixes are dealt over all tasks.
HOT = 20_000
CONTEXT = {"d": pa.int64(), "t": pa.int64(), "at": pa.int32(), "h": pa.int64(), "c": pa.int64(), "p": pa.int64(), "off": pa.int32(), "hot": pa.bool_(), "body": pa.binary()}


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of a byte array, modulo 2^64."""
    up, _ = POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def polynomial(data: bytes) -> int:
    """The polynomial hash of one byte string, as differences of ``prefix_hashes`` give it."""
    x = np.frombuffer(data, np.uint8)
    return int(((x.astype(np.uint64) + np.uint64(1)) * POWERS.to(len(x))[0][: len(x)]).sum())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def anchors(text: bytes, length: int = LENGTH, k: int = ANCHOR) -> list[tuple[int, int, int, int, int]]:
    """(hash, position, first window, last window, polynomial hash of the context) of each anchor of one text, in order."""
    n = len(text)
    if n < length:
        return []
    data = np.frombuffer(text, np.uint8)
    prefix = prefix_hashes(data)
    _, down = POWERS.to(n + 1)
    h = _mixed((prefix[k:] - prefix[:-k]) * down[: n - k + 1])
    span, m = length - k + 1, n - k + 1
    padded = np.full(m + -m % span, np.uint64(2**64 - 1))
    padded[:m] = h
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - span + 1], ahead[span - 1 : m])
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])).tolist()
    out = []
    for first, after in zip(starts, [*starts[1:], len(least)], strict=True):
        while first < after:
            at = first + int(h[first : first + span].argmin())
            out.append((int(h[at]), at, first, min(at, after - 1)))
            first = at + 1
    ends = np.array([(x[2], x[3] + length) for x in out])
    poly = ((prefix[ends[:, 1]] - prefix[ends[:, 0]]) * down[ends[:, 0]]).tolist()
    return [(*x, p) for x, p in zip(out, poly, strict=True)]


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _anchor_rows(length: int, k: int):
    """Per anchor its hash, two hashes of its context, and its place, packed in one number, in the text (d, t)."""

    def run(rows):
        for batch in batches(rows, 4_000, 8 << 20):
            d, t = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: dict[str, list[int]] = {x: [] for x in ("h", "c", "p", "place", "d", "t")}
            for i, text in enumerate(as_bytes(batch.column(2))):
                found = anchors(text, length, k)
                out["h"] += [_signed(x[0]) for x in found]
                out["c"] += [_signed(context_hash(text, at, first, last, length)) for _, at, first, last, _ in found]
                out["p"] += [_signed(x[4]) for x in found]
                out["place"] += [at << 24 | (at - first) << 12 | (at - last) for _, at, first, last, _ in found]
                out["d"] += [d[i]] * len(found)
                out["t"] += [t[i]] * len(found)
            yield pa.RecordBatch.from_pydict({name: pa.array(v, pa.int64()) for name, v in out.items()})

    return run


def context_hash(text: bytes, at: int, first: int, last: int, length: int) -> int:
    return xxhash.xxh3_64_intdigest(text[first : last + length], at - first)


def _unpacked(place: int) -> tuple[int, int, int]:
    at = place >> 24
    return at, at - (place >> 12 & 4095), at - (place & 4095)


def _contexts(length: int):
    """Of (d, t, text, anchor hashes and places): each context with its hash, its owner and its place."""

    def run(rows):
        for batch in batches(rows, 4_000, 8 << 20):
            out = {name: [] for name in CONTEXT}
            for d, t, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for x in found:
                    at, first, last = _unpacked(x["place"])
                    c = _signed(context_hash(text, at, first, last, length))
                    poly = polynomial(text[first : last + length])
                    for name, v in zip(out, (d, t, at, x["h"], c, _signed(poly), at - first, x["hot"], text[first : last + length]), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict({name: pa.array(v, CONTEXT[name]) for name, v in out.items()})

    return run


class Suffixes:
    """Suffixes of some contexts, compared by their bytes, eight at a time."""

    def __init__(self, bodies: list[bytes], length: int) -> None:
        self.length = length
        self.data = np.frombuffer(b"".join(bodies) + bytes(max(length, 8)), np.uint8)

    @cached_property
    def prefix(self) -> np.ndarray:
        return prefix_hashes(self.data)

    @property
    def down(self) -> np.ndarray:
        return POWERS.to(len(self.data) + 1)[1]

    @cached_property
    def words(self) -> np.ndarray:
        """The eight bytes from each place on, as numbers in the order of the bytes."""
        return np.ndarray(len(self.data) - 7, ">u8", self.data, strides=(1,)).astype(np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest common extension of each pair of suffixes, at most ``length``, byte by byte; for tests."""
        same = self.data[a[:, None] + np.arange(self.length)] == self.data[b[:, None] + np.arange(self.length)]
        return np.where(same.all(1), self.length, same.argmin(1))

    def tied(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers, ascending, of suffixes ``at`` that agree on ``length`` bytes with another one of their segment.

        ``lengths`` are those of consecutive segments.  Suffixes are sorted by their first eight bytes, ties by the
        next eight, and so on; who stands alone is in place.  Ties without a difference need no sort.
        """
        who, group = np.arange(len(at)), np.repeat(np.arange(len(lengths)), lengths)
        # Where texts are shorter than eight bytes, what follows them is cut off.
        over = np.uint64(8 * max(0, 8 - self.length))
        for step in [*range(0, self.length - 8, 8), max(0, self.length - 8)]:
            word = self.words[at[who] + step] >> over
            new = group[1:] != group[:-1]
            differ = (word[1:] != word[:-1]) & ~new
            if differ.any():
                mixed = np.zeros(group[-1] + 1, bool)
                mixed[group[1:][differ]] = True
                part = np.flatnonzero(mixed[group])
                order = part[np.lexsort((word[part], group[part]))]
                who[part], word[part] = who[order], word[order]
                new |= word[1:] != word[:-1]
            ends = np.append(new, True)
            alone = ends & np.concatenate([[True], new])
            group = np.cumsum(np.concatenate([[0], new]))
            if alone.any():
                who, group = who[~alone], group[~alone]
                if not len(who):
                    break
        return np.sort(who)


def _repeated(suffixes: Suffixes, segment: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers of those suffixes that another one of their segment agrees with on the whole length."""
    order = np.argsort(segment, kind="stable")
    kept = segment[order]
    heads = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]])) if len(kept) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(heads, len(kept)))
    order, lengths = order[np.repeat(lengths > 1, lengths)], lengths[lengths > 1]
    if not len(order):
        return order
    return np.sort(order[suffixes.tied(at[order], lengths)])


def repeated_windows(contexts: list[tuple[int, bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For contexts (anchor number, bytes, anchor offset): runs of window starts seen in another one.

    A run (a, b) says that each window of its context that starts at a to b-1 also starts in another
    context of the same anchor, as far from it.
    """
    bodies = [x[1] for x in contexts]
    base = np.cumsum([0, *map(len, bodies)])[:-1]
    counts = np.array([max(0, len(b) - length + 1) for b in bodies], np.int64)
    group, offset = np.array([x[0] for x in contexts], np.int64), np.array([x[2] for x in contexts], np.int64)
    _, group = np.unique(group, return_inverse=True)
    suffixes = Suffixes(bodies, length)
    # Only windows equally far from the anchor can be equal, so a large group is done in bands of that distance.
    bands = max(1, -(-int(counts.sum()) // BATCH_SUFFIXES))
    hits = []
    for band in range(bands):
        first = (offset - band) % bands
        many = np.maximum(0, -(-(counts - first) // bands))
        owner = np.repeat(np.arange(len(bodies)), many)
        local = first[owner] + bands * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
        segment = group[owner] * (2 * length) + (offset[owner] - local)
        hit = _repeated(suffixes, segment, base[owner] + local)
        hits.append((owner[hit], local[hit]))
    owner, local = (np.concatenate(x) for x in zip(*hits, strict=True))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    by = np.lexsort((local, owner))
    owner, local = owner[by], local[by]
    if len(owner):
        breaks = np.flatnonzero((owner[1:] != owner[:-1]) | (local[1:] != local[:-1] + 1)) + 1
        for s, e in zip([0, *breaks.tolist()], [*breaks.tolist(), len(owner)], strict=True):
            out[owner[s]].append((int(local[s]), int(local[e - 1]) + 1))
    return out


def _resolved(length: int):
    """Of distinct contexts sorted by anchor: (h, c, p, spans) with spans as (from, to) from the anchor."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def solve(part: list[dict]):
        found = repeated_windows([(x["h"], x["body"], x["off"]) for x in part], length)
        h, c, p, spans = [], [], [], []
        for x, runs in zip(part, found, strict=True):
            if x["n"] > 1:
                runs = [(0, len(x["body"]) - length + 1)]
            if runs:
                h.append(x["h"])
                c.append(x["c"])
                p.append(x["p"])
                spans.append([{"a": a - x["off"], "b": b - 1 + length - x["off"]} for a, b in runs])
        return pa.record_batch([*(pa.array(v, pa.int64()) for v in (h, c, p)), pa.array(spans, kind)], names=["h", "c", "p", "spans"])

    def run(rows):
        part, suffixes = [], 0
        for whole in groups((b for b in rows), "h"):
            group, last = [], None
            for x in whole.to_pylist():
                if last is not None and x["h"] != last:
                    part += group
                    group = []
                    if suffixes >= BATCH_SUFFIXES:
                        yield solve(part)
                        part, suffixes = [], 0
                group.append(x)
                suffixes += len(x["body"]) - length + 1
                last = x["h"]
            part += group
        if part:
            yield solve(part)

    return run


def _dealt(length: int):
    """Of distinct contexts: each window suffix with its distance from the anchor and two hashes of its bytes."""

    def run(rows):
        for batch in batches(rows, 4_000, 2 << 20):
            bodies = as_bytes(batch.column(batch.schema.names.index("body")))
            suffixes = Suffixes(bodies, length)
            base = np.cumsum([0, *map(len, bodies)])[:-1]
            many = np.array([len(b) - length + 1 for b in bodies], np.int64)
            owner = np.repeat(np.arange(len(bodies)), many)
            local = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            at = base[owner] + local
            poly = (suffixes.prefix[at + length] - suffixes.prefix[at]) * suffixes.down[at]
            check = [_signed(xxhash.xxh3_64_intdigest(bodies[o][i : i + length])) for o, i in zip(owner.tolist(), local.tolist(), strict=True)]
            off = np.asarray(batch.column(batch.schema.names.index("off")))[owner]
            own = [batch.column(batch.schema.names.index(x)).take(pa.array(owner)) for x in ("h", "c", "p", "n")]
            yield pa.record_batch([*own, pa.array((off - local).astype(np.int32)), pa.array(poly.view(np.int64)), pa.array(check, pa.int64())], names=["h", "c", "p", "n", "far", "poly", "check"])

    return run


def _resolved_hot(distinct: DataFrame, length: int) -> DataFrame:
    """As ``_resolved``, for contexts of anchors with very many places."""
    key = ["h", "far", "poly", "check"]
    suffixes = written(distinct.mapInArrow(freed(_dealt(length)), "h long, c long, p long, n long, far int, poly long, check long"), "hot-suffixes")
    twice = written(suffixes.groupBy(*key).agg(F.sum("n").alias("times")).where("times > 1").select(*key), "hot-repeats")
    hit = suffixes.join(twice, key).groupBy("h", "c", "p").agg(F.array_sort(F.collect_set("far")).alias("far"))
    # The ends of each run of consecutive distances are those without a neighbour.
    end = lambda step: F.filter("far", lambda x: ~F.array_contains("far", x + step))
    runs = F.arrays_zip(end(1).alias("high"), end(-1).alias("low"))
    return hit.select("h", "c", "p", runs.alias("runs")).select("h", "c", "p", F.expr(f"transform(runs, x -> named_struct('a', -x.high, 'b', {length} - x.low))").alias("spans"))


def _cut(text: bytes, spans: list[dict]) -> tuple[list[tuple[int, int]], bytes]:
    runs: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return runs, b"".join([*kept, text[at:]])


def _cut_rows(rows):
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches(rows, 4_000, 8 << 20):
        runs, kept = [], []
        for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            r, k = _cut(text, [x for part in spans or () for x in part])
            runs.append([{"a": a, "b": b} for a, b in r])
            kept.append(k)
        yield pa.record_batch([batch.column(0), pa.array(list(map(len, as_bytes(batch.column(1)))), pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "runs", "kept"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs`` with a row key (d, t) that only rows of equal id and text share."""
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) if whole else F.xxhash64("doc_id")
    return docs.select("doc_id", "text", d.alias("d"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("t"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(d, t, spans): for each row key of ``docs`` the byte spans of repeated strings, unmerged."""
    texts = _keyed(docs).select("d", "t", "text")
    # One pass over the texts finds all anchors; written, they are read twice.
    found = written(texts.mapInArrow(freed(_anchor_rows(length, k)), "h long, c long, p long, place long, d long, t long"), "all-anchors")
    mixed = ((F.min("c") != F.max("c")) | (F.min("p") != F.max("p"))).alias("mixed")
    seen = found.groupBy("h").agg(F.count("*").alias("n"), mixed)
    # Both sides of a join on anchors are written tables, so that the parts of a frequent anchor are dealt anew.
    seen = written(seen.where("n > 1").select("h", "mixed", (F.col("mixed") & (F.col("n") > HOT)).alias("hot")), "repeated-anchors")
    shared = written(found.select("h", "place", "d", "t").join(seen, "h").select("d", "t", "h", "place", "mixed", "hot"), "anchors")
    dropped(docs.sparkSession, found, seen)
    # Repeated rows share a key, so each anchor of theirs is gathered once.
    per_row = shared.where("mixed").groupBy("d", "t").agg(F.collect_set(F.struct("h", "place", "hot")).alias("found"))
    bodies = texts.join(per_row, ["d", "t"]).select("d", "t", "text", "found").mapInArrow(_contexts(length), "d long, t long, at int, h long, c long, p long, off int, hot boolean, body binary")
    bodies = written(bodies, "contexts")
    distinct = lambda rows: rows.groupBy("h", "c", "p").agg(F.count("*").alias("n"), F.first("off").alias("off"), F.first("body").alias("body"))
    solved = distinct(bodies.where("not hot")).repartition("h").sortWithinPartitions("h", "c", "p").mapInArrow(freed(_resolved(length)), "h long, c long, p long, spans array<struct<a: int, b: int>>")
    solved = written(solved.unionByName(_resolved_hot(distinct(bodies.where("hot")), length)), "solved")
    moved = bodies.select("d", "t", "at", "h", "c", "p").join(solved, ["h", "c", "p"]).select("d", "t", F.expr("transform(spans, x -> named_struct('a', at + x.a, 'b', at + x.b))").alias("spans"))
    first, last = "shiftright(place, 24) - (shiftright(place, 12) & 4095)", f"shiftright(place, 24) - (place & 4095) + {length}"
    whole = shared.where("not mixed").select("d", "t", F.expr(f"array(named_struct('a', cast({first} as int), 'b', cast({last} as int)))").alias("spans"))
    return whole.unionByName(moved)


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, runs (maximal removed byte runs) and kept (the remaining bytes), a row per row of ``docs``."""
    spans = repeated_spans(docs, length, k).groupBy("d", "t").agg(F.collect_set("spans").alias("spans"))
    joined = _keyed(docs).join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut_rows, f"doc_id {kind}, n_bytes long, runs array<struct<a: int, b: int>>, kept binary")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(removed bytes, runs, sha256 of the rest) of each text, by counting every window; for tests."""
    seen: dict[bytes, int] = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for t in texts:
        spans = [{"a": i, "b": i + length} for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
        runs, kept = _cut(t, spans)
        out.append((len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out
