"""Fuzzy line deduplication over a whole corpus.

A line is normalised (lower case, words joined by single spaces) and gets a 128-bit identity.  Equal lines
are counted first and go on as one row.  Distinct lines meet through blocks of min-hashes, which stand in
for SimHash blocks: a SimHash of 64 bits moves by 4 to 8 bits where one word of an ordinary line changes,
more than pigeonhole blocks of a useful width allow for (the README has figures).  Lines of fewer than
``FEW`` words have blocks of 4-grams, lines of ``MANY`` words or more blocks of words, those between have
both, so that alike lines on either side have blocks in common.  A block is a few minima with the order in
which they stand in the line (edits do not reorder what they leave) and a class of length.  Within a block
lines whose lengths or minima lie too far apart are split off, and only what is left fetches its text.
Pairs are verified by edit similarity, 1 - distance / longer length, unless they are connected already, so
a group of thousands of variants costs about one verification a line and never all pairs.  Links of all
blocks are merged by star contraction.  Of each connected group the first occurrence, by (doc_id, line
number), stays.

A block of over ``LONG`` lines, as a template makes, is no task of its own.  First its lines are compared
tile by tile, and the first lines of the tiles with each other; links found are merged.  Then each two
tiles are compared as well, but for lines that are connected already.  So all pairs of any block are
compared or connected, whatever its size, and no task holds more than two tiles of it.

Meeting is by chance, so a pair may be missed; the README has the measured share of pairs that meet.

Lines without words are never removed.  Null texts have no lines and stay null; null doc_ids come last in
the order; rows that repeat id and text are copies of each other, of which the first keeps its lines; ids
may have any type that sorts.  A very long text or line is handled whole, by the task that holds it.
"""

from __future__ import annotations

from bisect import bisect_left
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.components import PARTS, connected_components

from ._common import BASE, POWERS, Forest, as_bytes, batches, dropped, freed, groups, written

SIMILARITY = 0.9
#: Minima of a block; each block draws one more, which only tells near lines from far ones.
GRAM, BLOCKS, MINIMA = 4, 9, 3
#: Words of a line below which it has blocks of grams, and from which on of words.
FEW, MANY = 32, 16
#: Shorter words are features only of lines with few longer ones.
LONG_WORD, ENOUGH = 4, 8
#: Minima of two lines whose low bits differ in more places than this are too far apart to be alike.
FAR = 11
#: Shorter lines allow no edit at all and have no blocks.
LEAST = 10
#: Lines of a tile: a block of more is dealt tile by tile.  No result depends on it.
LONG = 512
#: Pairs that a task makes and holds at a time, and nodes of its forest before it is emptied.
MADE, HELD, NODES = 1 << 17, 1 << 18, 300_000

_RNG = np.random.default_rng(11)
TIMES, PLUS = _RNG.integers(0, 1 << 32, (2, BLOCKS * (MINIMA + 1)), dtype=np.uint32)
SHIFT = _RNG.random(BLOCKS)
FACTORS, HIGH = TIMES | np.uint32(1), np.uint32(0xFFFFFF00)
#: Features that are worked on at a time.
PIECE = 1 << 15


def normalised(line: bytes) -> bytes:
    return b" ".join(_lowered(line).split())


def _joined(line: bytes, plain: bool) -> bytes:
    """The words of a line joined by single spaces; ``plain`` if only spaces, one at a time, can stand between them."""
    return line.strip() if plain else b" ".join(line.split())


def _plain(text: bytes) -> bool:
    return b"  " not in text and not any(x in text for x in (b"\t", b"\r", b"\v", b"\f"))


def _all_plain(texts: list[bytes]) -> bool:
    """Whether all of ``texts`` are ``_plain``, in a few passes over them together."""
    every = b"\n".join(texts)
    space = np.frombuffer(every, np.uint8) == 32
    return not (space[1:] & space[:-1]).any() and not any(x in every for x in (b"\t", b"\r", b"\v", b"\f"))


def _lowered(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def _scrambled(h: np.ndarray) -> np.ndarray:
    for by, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h = (h ^ h >> np.uint32(by)) * np.uint32(factor)
    return h ^ h >> np.uint32(15)


def _places(at: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places in lines in 1/256 of their length."""
    return (at * np.repeat(256 / lengths, counts)).astype(np.uint32)


def gram_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of the 4-grams of all lines, and where each line starts among them."""
    pad = b"\0" * (GRAM - 1)
    raw = np.frombuffer(pad.join(x.replace(b"\0", b"\1") for x in lines) + pad, np.uint8)
    size = len(raw) - GRAM + 1
    h = np.zeros(size, np.uint32)
    for i in range(GRAM):
        h = h * np.uint32(0x01000193) + raw[i : i + size]
    h = h[raw[:size] != 0]
    lengths = np.array(list(map(len, lines)))
    start = np.cumsum(lengths) - lengths
    return _scrambled(h), _places(np.arange(len(h)) - np.repeat(start, lengths), lengths, lengths), start


def word_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``gram_features``, of words; short words count only where a line has few others."""
    raw = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    end = np.flatnonzero((raw == 32) | (raw == 10))
    begin = np.concatenate([[0], end[:-1] + 1])
    counts = np.diff(np.concatenate([[-1], np.flatnonzero(raw[end] == 10)]))
    first = np.cumsum(counts) - counts
    long = end - begin >= LONG_WORD
    enough = np.add.reduceat(long.astype(np.int64), first) >= ENOUGH
    taken = long | ~np.repeat(enough, counts)
    n = np.add.reduceat(taken.astype(np.int64), first)
    begin, end = begin[taken], end[taken]
    up, down = POWERS.to(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    x = raw.astype(np.uint64)
    x += np.uint64(1)
    x *= up[: len(raw)]
    np.cumsum(x, out=prefix[1:])
    h = prefix[end]
    h -= prefix[begin]
    h *= down[begin]
    h ^= h >> np.uint64(32)
    lengths = np.array(list(map(len, lines)))
    place = _places(begin - np.repeat(np.cumsum(lengths + 1) - lengths - 1, n), lengths, n)
    return _scrambled(h.astype(np.uint32)), place, np.cumsum(n) - n


def _minima(lines: list[bytes], words: bool, low: np.ndarray) -> None:
    """Into ``low``: for each hash and line the least hash of a feature, with its place in the low byte."""
    h, place, start = (word_features if words else gram_features)(lines)
    # Pieces that stay in the cache.
    cuts = np.flatnonzero(np.diff(start // PIECE, prepend=-1)).tolist()
    for s, e in zip(cuts, [*cuts[1:], len(lines)], strict=True):
        part = slice(start[s], start[e] if e < len(lines) else len(h))
        own, own_place, own_start = h[part], place[part], start[s:e] - start[s]
        x = np.empty_like(own)
        for k in range(len(TIMES)):
            np.multiply(own, FACTORS[k], out=x)
            x += PLUS[k]
            # The place of a feature rides in the low byte of its hash.
            x &= HIGH
            x |= own_place
            np.minimum.reduceat(x, own_start, out=low[k, s:e])


def _keyed(low: np.ndarray, chars: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, marks) of lines by their minima: a key for each block; 36 low bits of minima and 16 of length."""
    log = np.log(chars)
    own = low.reshape(BLOCKS, MINIMA + 1, len(chars))[:, :MINIMA]
    key = np.floor(log / 0.5 + SHIFT[:, None]).astype(np.uint64) + ((np.arange(BLOCKS) << 8) + (words << 16)).astype(np.uint64)[:, None]
    at = own.astype(np.uint8)
    ranks = [sum((at[:, i] > at[:, j]).view(np.uint8) for j in range(MINIMA) if j != i) for i in range(MINIMA)]
    for part in (*np.moveaxis(own >> np.uint32(8), 1, 0), *ranks):
        key ^= part
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    keys = (key >> np.uint64(32)).astype(np.uint32).view(np.int32).T
    bits = np.zeros((len(chars), 6), np.uint8)
    some = np.packbits((low >> np.uint32(8) & np.uint32(1)).astype(np.uint8), axis=0)
    bits[:, : len(some)] = some.T
    code = np.rint(log / np.log(1.01)).astype(">u2").view(np.uint8).reshape(-1, 2)
    return keys, np.concatenate([bits, code], 1).copy().view(">i8").ravel().astype(np.int64)


def near(mark: np.ndarray | np.int64, marks: np.ndarray) -> np.ndarray:
    """Which ``marks`` are near enough to be alike: lengths within a tenth, minima not ``FAR``."""
    lengths = np.abs((marks & 0xFFFF) - (mark & 0xFFFF)) <= 12
    return lengths & (np.bitwise_count((marks ^ mark).view(np.uint64) >> np.uint64(16)) <= FAR)


LINE = "n_lines int, line int, a long, b long, sketch binary"
#: Blocks of grams come first in a line's keys, then those of words.
SLOTS = 2 * BLOCKS
#: A line's sketch; bit 0 of ``kinds`` is set where it has blocks of grams, bit 1 where it has those of words.
SKETCH = np.dtype([("kinds", "u1"), ("keys", "<i4", SLOTS), ("marks", "<i8", 2)])
#: A line in a block: ``high`` and ``low`` hold its mark without the bits that are always zero.
ENTRY = np.dtype([("slot", "u1"), ("key", "<u4"), ("a", "<i8"), ("high", "<u4"), ("low", "<u2")])
#: Entries that a task holds before it deals them out, and the least number of buckets.  No result depends on them.
ENTRIES, BUCKETS = 1 << 18, 4096
#: Lines that a task remembers, so that repeats need no sketch.
SEEN = 200_000
_NO_LINE = bytes(16)


def _sketched(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and the marks of each line, of grams or words or both, and which keys there are."""
    keys, marks = np.zeros((len(lines), SLOTS), np.int32), np.zeros((len(lines), 2), np.int64)
    there = np.zeros((len(lines), SLOTS), bool)
    lengths = np.array(list(map(len, lines)))
    spaces = np.flatnonzero(np.frombuffer(b"".join(lines), np.uint8) == 32)
    words = np.diff(np.searchsorted(spaces, np.cumsum(lengths)), prepend=0) + 1
    chars = np.array([n if x.isascii() else len(x.decode("utf-8", "replace")) for x, n in zip(lines, lengths.tolist(), strict=True)])
    fit = lengths >= LEAST
    for kind, chosen in ((0, fit & (words < FEW)), (1, fit & (words >= MANY))):
        own = np.flatnonzero(chosen)
        if not len(own):
            continue
        low = np.empty((len(TIMES), len(own)), np.uint32)
        # Pieces that stay in the cache.
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths[own]) >> 17, prepend=-1)).tolist()
        for s, e in zip(cuts, [*cuts[1:], len(own)], strict=True):
            _minima([lines[i] for i in own[s:e].tolist()], bool(kind), low[:, s:e])
        part = slice(kind * BLOCKS, (kind + 1) * BLOCKS)
        keys[own, part], marks[own, kind] = _keyed(low, chars[own], bool(kind))
        there[own, part] = True
    return keys, marks, there


def _packed(lines: list[bytes]) -> np.ndarray:
    """The sketch of each line as one record; no kinds where the line has none."""
    out = np.zeros(len(lines), SKETCH)
    if lines:
        out["keys"], out["marks"], there = _sketched(lines)
        out["kinds"] = there[:, 0] + 2 * there[:, BLOCKS]
    return out


def _binaries(values: np.ndarray, ends: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Records as binary values, of which each ends before the record of that number in ``ends``."""
    offsets = np.concatenate([[0], ends * values.dtype.itemsize]).astype(np.int32)
    bits = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends), [bits, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _records(column: pa.Array | pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """The records of all values of a binary column without nulls, one after the other."""
    parts = []
    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(x):
            _, ends, data = x.buffers()
            ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1]
            parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).view(kind)


def _line_rows(rows):
    """A row for each line with words; the first row of each text, which has no line if no line has words, holds its number of lines."""
    seen: set[bytes] = set()
    for batch in batches(rows, 2_000, 4 << 20):
        owner, line, hashes, fresh, places, total = [], [], [], [], [], []
        texts = as_bytes(batch.column(2))
        all_plain = _all_plain(texts)
        for i, text in enumerate(texts):
            # A line feed is no letter and no mark, so letters are lowered as they are line by line.
            text = _lowered(text)
            plain = all_plain or _plain(text)
            own = [_joined(x, plain) for x in text.split(b"\n")]
            there = [n for n, x in enumerate(own) if x]
            total.append(len(own))
            if len(there) < len(own):
                own = [x for x in own if x]
            if not own:
                owner.append(i)
                line.append(-1)
                hashes.append(_NO_LINE)
                continue
            digests = list(map(xxhash.xxh3_128_digest, own))
            for n, h in enumerate(digests, len(line)):
                if h not in seen:
                    seen.add(h)
                    fresh.append(own[n - len(line)])
                    places.append(n)
            owner += [i] * len(there)
            line += there
            hashes += digests
        if len(seen) > SEEN:
            seen.clear()
        both = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
        packed, there = _packed(fresh), np.zeros(len(line), bool)
        there[places] = packed["kinds"] > 0
        owner, line = np.array(owner), np.array(line, np.int32)
        total = np.where(batch.column(2).is_valid().to_numpy(zero_copy_only=False), total, 0).astype(np.int32)
        columns = {x: batch.column(k).take(pa.array(owner)) for k, x in enumerate(("doc_id", "t"))}
        columns |= {"n_lines": pa.array(total[owner], mask=np.diff(owner, prepend=-1) == 0)}
        columns |= {x: pa.array(v, mask=line < 0) for x, v in (("line", line), ("a", both[:, 0]), ("b", both[:, 1]))}
        yield pa.RecordBatch.from_pydict(columns | {"sketch": _binaries(packed[packed["kinds"] > 0], np.cumsum(there), ~there)})


def _indexed(buckets: int):
    """Of (a, sketch): (bucket, entries) with the entries of all blocks of these lines, dealt by the key of the block."""

    def dealt(held):
        every = np.concatenate(held)
        bucket = (every["key"] % np.uint32(buckets)).astype(np.uint16)
        n = np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        ordered = every[np.argsort(bucket, kind="stable")]
        return pa.record_batch([pa.array(some.astype(np.int32)), _binaries(ordered, np.cumsum(n[some]))], names=["bucket", "entries"])

    def run(rows):
        held, n = [], 0
        for batch in rows:
            if not batch.num_rows:
                continue
            ids, sketch = batch.column(0).to_numpy(), _records(batch.column(1), SKETCH)
            who, slot = np.nonzero(sketch["kinds"][:, None] >> (np.arange(SLOTS) // BLOCKS) & 1)
            marks = sketch["marks"][who, slot // BLOCKS].view(np.uint64)
            entry = np.empty(len(who), ENTRY)
            entry["slot"], entry["key"], entry["a"] = slot, sketch["keys"][who, slot].view(np.uint32), ids[who]
            entry["high"], entry["low"] = marks >> np.uint64(32), (marks >> np.uint64(16) & np.uint64(0xF000)) + (marks & np.uint64(0xFFF))
            held.append(entry)
            if (n := n + len(entry)) >= ENTRIES:
                yield dealt(held)
                held, n = [], 0
        if n:
            yield dealt(held)

    return freed(run)


def _entries(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key with slot, a, mark) of entries, sorted by key."""
    entry = _records(column, ENTRY)
    key = (entry["slot"].astype(np.int64) << 32) + entry["key"]
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    # Lines that are alone in their block go no further.
    some = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    key, entry = key[some], entry[order[some]]
    low = entry["low"].astype(np.uint64)
    mark = (entry["high"].astype(np.uint64) << np.uint64(32)) + ((low & np.uint64(0xF000)) << np.uint64(16)) + (low & np.uint64(0xFFF))
    return key, entry["a"], mark.view(np.int64)


def distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance by Myers' bit-parallel recursion, after common ends are cut off; ``most`` + 1 where it is larger."""
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    end = 0
    while end < high - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    most = len(a) + len(b) if most is None else most
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    m, at = len(a), {}
    for i, c in enumerate(a, 1):
        at[c] = at.get(c, 0) | 1 << (i - 1)
    full, plus, minus = (1 << m) - 1, (1 << m) - 1, 0
    for n, c in enumerate(b):
        if not n & 127 and (row := n + m - len(b)) > 0:
            # Distances never fall along the diagonal on which the table ends.
            low = (1 << row) - 1
            if n + (plus & low).bit_count() - (minus & low).bit_count() > most:
                return most + 1
        eq = at.get(c, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        x = (minus | ~(d | plus)) << 1 | 1
        minus, plus = x & d & full, ((d & plus) << 1 | ~(x | d)) & full
    return min(len(b) + plus.bit_count() - minus.bit_count(), most + 1)


#: Steps over an edit, the least first, and characters that have to be equal after it.
STEPS = [(p, q) for e in range(1, 9) for p, q in [(e, e), *((e, k) for k in range(e)), *((k, e) for k in range(e))]]
AHEAD = 4
#: Characters of the windows that long texts are stitched at, and edits from which on these two ways are tried.
WINDOW, STITCHED = 12, 100


def walked(a: str, b: str, most: int) -> bool:
    """Whether a walk along both texts, by the least step over each edit, takes ``most`` edits at most.

    No walk is shorter than the distance, so True is certain; False says nothing.
    """
    i, j, done = 0, 0, 0
    while i < len(a) and j < len(b) and done <= most:
        if a[i] != b[j]:
            p, q = next((x for x in STEPS if a[i + x[0] : i + x[0] + AHEAD] == b[j + x[1] : j + x[1] + AHEAD]), (1, 1))
            i, j, done = i + p, j + q, done + max(p, q)
            continue
        size = 16
        while i < len(a) and a[i : i + size] == b[j : j + size]:
            i, j, size = i + size, j + size, 2 * size
        while size > 1:
            size //= 2
            if a[i : i + size] == b[j : j + size]:
                i, j = i + size, j + size
    # Slices may end with their texts, so a step may lead beyond the end of both, but not of one alone.
    return done + max(len(a) - i, len(b) - j, 0) <= most


def stitched(a: str, b: str, most: int) -> bool:
    """Whether the edits between windows that each text has once, in the order of both, add up to ``most`` at most.

    Their sum is never below the distance, so True is certain; False says nothing.
    """
    once = []
    for text in (a, b):
        x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = np.zeros(max(0, len(x) - WINDOW + 1), np.uint64)
        for i in range(WINDOW):
            h = h * np.uint64(BASE) + x[i : i + len(h)]
        h, at, n = np.unique(h, return_index=True, return_counts=True)
        once.append((h[n == 1], at[n == 1]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    x, y = once[0][1][i], once[1][1][j]
    order = np.argsort(x)
    x, y = x[order], y[order]
    # Of windows in a row the first is enough.
    fresh = np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1)])[: len(x)]
    x, y = x[fresh].tolist(), y[fresh].tolist()
    ends, last, before = [], [], []
    for k, at in enumerate(y):
        n = bisect_left(ends, at)
        before.append(last[n - 1] if n else -1)
        ends[n : n + 1], last[n : n + 1] = [at], [k]
    cuts, k = [(len(a), len(b))], last[-1] if last else -1
    while k >= 0:
        cuts.append((x[k], y[k]))
        k = before[k]
    done, left, right = 0, 0, 0
    for p, q in reversed(cuts):
        one, two = a[left:p], b[right:q]
        if one != two and (done := done + distance(one, two)) > most:
            return False
        left, right = p, q
    return True


#: Edits up to which pairs are followed along their diagonals, and characters of the pairs that are followed together.
EDITS, FOLLOWED = 320, 1 << 19
#: Part of the pace at which a pair uses up its limit at its very end, below which one that may stay open is left to the band.
PACE = 0.8
#: Characters that places which go on to match are looked ahead by: many where such places are few, since calls cost more.
STRIDES, FEW_PLACES = np.arange(0, 512, 8), 1 << 11


def _equal(x: np.ndarray) -> np.ndarray:
    """How many low bytes are zero."""
    return np.bitwise_count(~x & (x - np.uint64(1))) >> np.uint8(3)


def _windows(codes: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of these sizes, which have ``end`` behind them, the 8 characters from each place on, and where each text starts."""
    start = np.cumsum(size + 1) - size - 1
    flat = np.full(len(codes) + len(size) + int(STRIDES[-1]) + 24, end, np.uint8)
    flat[np.arange(len(codes)) + np.repeat(np.arange(len(size)), size)] = codes
    return flat, np.ndarray(len(flat) - 7, "<u8", flat, strides=(1,)).astype(np.uint64), start


def _small_codes(texts: list[str]) -> np.ndarray | None:
    """Characters of all texts as numbers below 254; None where they have more kinds of characters."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if raw.max(initial=0) >= 254:
        there = np.zeros(int(raw.max()) + 1, bool)
        there[raw] = True
        if np.count_nonzero(there) > 254:
            return None
        raw = (np.cumsum(there) - 1)[raw]
    return raw.astype(np.uint8)


def _followed(pairs: list[tuple[str, str]], limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(within, open): which pairs are ``limit`` edits apart at most, and which are not settled.

    After each edit the farthest place on each diagonal is known (Ukkonen; Landau and Vishkin), so the work grows
    with the edits and not with the texts.  Pairs stay open that may take more than ``EDITS``, and very short ones.
    """
    edits = min(EDITS, int(limit.max()))
    out, left = np.zeros(len(pairs), bool), limit > edits
    codes = _small_codes([x for side in zip(*pairs, strict=True) for x in side])
    if codes is None:
        return out, ~out
    la, lb = np.array([(len(a), len(b)) for a, b in pairs]).T
    total = int(la.sum())
    (ca, wa, sa), (cb, wb, sb) = _windows(codes[:total], la, 255), _windows(codes[total:], lb, 254)
    # A place is on both texts as long as none of them is shorter than the diagonals reach.
    short = np.minimum(la, lb) <= edits
    left |= short
    who = np.flatnonzero(~short & (np.abs(lb - la) <= np.minimum(limit, edits)))
    sa, sb, la, lb, most = (x[who] for x in (sa, sb, la, lb, limit))
    mid = edits + 1
    # Places count from the start of all texts; ``across`` leads from a place in the first text to that in the second.
    far = np.full((len(who), 2 * mid + 1), -(1 << 40), np.int64)
    far[:, mid] = sa
    every = np.arange(-mid, mid + 1)
    most_far, across = np.minimum(la[:, None], lb[:, None] - every) + sa[:, None], (sb - sa)[:, None] + every
    for e in range(edits + 1 if len(who) else 0):
        end = lb - la
        # Diagonals that are too far from the last one to get back to it are left as they are.
        low, high = max(-e, int((end - most).min()) + e), min(e, int((end + most).max()) - e)
        if low <= high:
            part = slice(mid + low, mid + high + 1)
            if e:
                at = np.maximum(far[:, part], far[:, mid + low + 1 : mid + high + 2])
                at += 1
                np.maximum(at, far[:, mid + low - 1 : mid + high], out=at)
                np.minimum(at, most_far[:, part], out=at)
            else:
                at = far[:, part].copy()
            one, two = at.ravel(), (at + across[:, part]).ravel()
            # Most diagonals stop at once, so few are looked at eight characters at a time.
            on = np.flatnonzero(ca.take(one) == cb.take(two))
            if len(on):
                first, second = one[on], two[on]
                same = _equal(wa.take(first) ^ wb.take(second)).astype(np.int64)
                more = np.flatnonzero(same == 8)
                ahead = 8
                first, second = first[more], second[more]
                while len(more):
                    steps = STRIDES if len(more) <= FEW_PLACES else STRIDES[:8]
                    x = wa.take((first + ahead)[:, None] + steps)
                    x ^= wb.take((second + ahead)[:, None] + steps)
                    other = x != 0
                    where, still = other.argmax(1), ~other.any(1)
                    same[more] += np.where(still, 8 * len(steps), 8 * where + _equal(x[np.arange(len(x)), where]))
                    more, first, second, ahead = more[still], first[still], second[still], ahead + 8 * len(steps)
                one[on] += same
            far[:, part] = at
        done = (far[np.arange(len(who)), mid + end] >= la + sa) & (most >= e)
        out[who[done]] = True
        stay = ~done & (most > e)
        if e >= 6 and low <= high and most[-1] > edits:
            # Of pairs that may stay open anyway, those leave that use up their limit too early.
            stay &= (most <= edits) | ((far[:, part].max(1) - sa) * most >= PACE * e * la)
        if np.count_nonzero(stay) < 0.9 * len(stay):
            who, sa, la, lb, most, far, most_far, across = (x[stay] for x in (who, sa, la, lb, most, far, most_far, across))
            if not len(who):
                break
    return out, left & ~out


#: Words of 64 bits of a band, and pairs together, beyond and below which pairs are compared one by one.
WORDS, FEW_PAIRS = 48, 12


def _codes(texts: list[str]) -> list[np.ndarray]:
    """Characters of texts as numbers of the narrowest type that has two to spare."""
    raw = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts]
    most = max((int(x.max()) for x in raw if len(x)), default=0)
    kind = np.uint8 if most < 254 else np.uint16 if most < 65_534 else np.uint32
    return [x.astype(kind) for x in raw]


def _banded(pairs: list[tuple[str, str]], limit: np.ndarray) -> np.ndarray:
    """``within`` for pairs of like length, longer than their limits: Hyyrö's bit-parallel band, column by column together.

    Bit k of a band of ``size`` bits at column j stands for row j + band - (size - 1) + k of the table.
    ``top`` is the distance along the highest diagonal; the steps down to the diagonal on which the
    table ends are counted in the band, and distances never fall along a diagonal.
    """
    band, one = int(limit.max()), np.uint64(1)
    words = (2 * band + 1 + 63) // 64
    size = 64 * words
    m = np.array([len(b) for _, b in pairs])
    order = np.argsort(-m)
    m, limit = m[order], limit[order]
    down = band + m - np.array([len(pairs[i][0]) for i in order])
    codes = _codes([x for i in order for x in pairs[i]])
    none = np.iinfo(codes[0].dtype).max
    a = np.full((len(m), int(m.max()) + size), none, codes[0].dtype)
    b = np.full((len(m), int(m.max())), none - 1, codes[0].dtype)
    lead = size - 1 - band
    for r in range(len(m)):
        x, y = codes[2 * r : 2 * r + 2]
        x = x[: a.shape[1] - lead]
        a[r, lead : lead + len(x)], b[r, : len(y)] = x, y
    at = np.arange(size)
    flat = lambda x: x.reshape(1, -1) if words == 1 else np.ascontiguousarray(x.T)
    to_words = lambda bits: flat(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    steps = to_words((at >= size - 1 - down[:, None]) & (at <= size - 2))
    plus, minus = to_words(np.broadcast_to(at >= lead, (len(m), size))), np.zeros((words, len(m)), np.uint64)
    none_over = np.zeros((1, len(m)), bool)
    top, out, who, last = np.full(len(m), band), np.zeros(len(m), bool), order, np.uint64(63)
    for j in range(int(m[0])):
        eq = to_words(a[:, j : j + size] == b[:, j, None])
        d = eq & plus
        d += plus
        if words > 1:
            # A carry seldom passes through a word, so all words are added at once until none is left.
            over = (d < plus)[:-1]
            while over.any():
                d[1:] += over
                over = np.concatenate([none_over, (over & (d[1:] == 0))[:-1]])
        d ^= plus
        d |= eq
        d |= minus
        top += (d[-1] >> last) == 0
        high = minus | ~(d | plus)
        low = d & plus
        moved = d >> one
        if words > 1:
            moved[:-1] |= d[1:] << last
        plus, minus = low | ~(moved | high), moved & high
        if m[-1] == j + 1 or j % 32 == 31:
            done = int(np.searchsorted(-m, -(j + 1)))
            now = top - np.bitwise_count(plus & steps).sum(0, np.int64) + np.bitwise_count(minus & steps).sum(0, np.int64)
            out[who[done:]] = (now <= limit)[done:]
            stay = now[:done] <= limit[:done]
            if done < len(m) or not stay.all():
                who, m, limit, top, a, b = (x[:done][stay] for x in (who, m, limit, top, a, b))
                plus, minus, steps, none_over = (np.ascontiguousarray(x[:, :done][:, stay]) for x in (plus, minus, steps, none_over))
                if not len(m):
                    break
    return out


def within(pairs: list[tuple[str, str]], most: list[int]) -> np.ndarray:
    """Which pairs are at most so many edits apart: pairs of like length together, single long ones by themselves."""
    out = np.zeros(len(pairs), bool)
    most = np.array(most, np.int64)
    size = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    words = (2 * most + 64) // 64
    fit = (np.abs(size[:, 0] - size[:, 1]) <= most) & (most >= 0)
    alone = fit & (words > WORDS)
    order = np.flatnonzero(fit & ~alone)
    order = order[np.lexsort((size[order, 1], most[order]))]
    if len(order) >= FEW_PAIRS:
        left = np.zeros(len(pairs), bool)
        # Limits below 16 go together, and others with those up to twice as large.
        part = 64 * (np.cumsum(size[order].sum(1)) // FOLLOWED) + np.frexp(most[order] // 16)[1]
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for s, e in zip(cuts, [*cuts[1:], len(order)], strict=True):
            out[order[s:e]], left[order[s:e]] = _followed([pairs[i] for i in order[s:e]], most[order[s:e]])
        order = order[left[order]]
    while len(order):
        # Bands of half as many words more go along, since calls cost more than words.
        least = int(words[order[0]])
        n = int(np.searchsorted(words[order[: max(64, 2048 // least)]], least + least // 2, side="right"))
        who, order = order[:n], order[n:]
        long = size[who].min(1) > most[who].max()
        alone[who[~long]], who = True, who[long]
        if len(who) < FEW_PAIRS:
            alone[who] = True
        else:
            out[who] = _banded([pairs[i] for i in who], most[who])
    for i in np.flatnonzero(alone):
        n = int(most[i])
        out[i] = n >= STITCHED and (walked(*pairs[i], n) or stitched(*pairs[i], n)) or distance(*pairs[i], n) <= n
    return out


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of characters of a text as hash and place in one number, in order and sorted."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = np.zeros(max(0, len(x) - GRAM + 1), np.uint32)
    for i in range(GRAM):
        h = h * np.uint32(0x01000193) + x[i : i + len(h)]
    both = (h.astype(np.uint64) << np.uint64(32)) + np.arange(len(h), dtype=np.uint64)
    return both, np.sort(both)


def may_be_alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> bool:
    """An edit breaks four grams at most and moves the others by one place at most.

    So texts are not alike where more grams of the one have no like gram near the same place of the
    other, as in rows of a table with the same words in another order.
    """
    n, m = len(a[0]), len(b[0])
    edits = int((1 - similarity) * (max(n, m) + GRAM - 1) + 1e-9)
    if not n or not m:
        return True
    place = (a[0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = a[0] - np.minimum(place, edits).astype(np.uint64)
    at = np.searchsorted(b[1], low)
    found = (at < m) & (b[1][np.minimum(at, m - 1)] <= a[0] + np.uint64(edits))
    return n - int(np.count_nonzero(found)) <= GRAM * edits


def allowed(a: str, b: str, similarity: float = SIMILARITY) -> int:
    """Edits that alike texts may be apart; -1 where their lengths alone are."""
    edits = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return edits if abs(len(a) - len(b)) <= edits else -1


def alike(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    edits = allowed(a, b, similarity)
    return edits >= 0 and distance(a, b, edits) <= edits


def _mixed(x: np.ndarray) -> np.ndarray:
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(by)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def _kin(key: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each row of a table sorted by ``key``: the first row that near rows of its key lead to."""
    label, n = np.arange(len(key)), len(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(first[1:], n)
    # Short blocks go by steps over the whole table.
    short, left, right = np.repeat(last - first <= 16, last - first), [], []
    at = np.flatnonzero(short)
    for step in range(1, 16):
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        ok = at[near(marks[at], marks[at + step])]
        left.append(ok)
        right.append(ok + step)
    if left:
        left, right = np.concatenate(left), np.concatenate(right)
        while (label[left] != label[right]).any():
            least = np.minimum(label[left], label[right])
            np.minimum.at(label, left, least)
            np.minimum.at(label, right, least)
    for s, e in zip(first.tolist(), last.tolist(), strict=True) if not short.all() else ():
        rest = np.arange(s, e) if e - s > 16 else ()
        while len(rest):
            reached, root, rest = [int(rest[0])], rest[0], rest[1:]
            while reached and len(rest):
                ok = near(marks[reached.pop()], marks[rest])
                reached.extend(rest[ok].tolist())
                label[rest[ok]] = root
                rest = rest[~ok]
    return label


def _parts(rows, key: str, least: int):
    """``groups``, several together until they have ``least`` rows or 16 MB."""
    held, n, size = [], 0, 0
    for part in groups(rows, key):
        held.append(part)
        n, size = n + part.num_rows, size + part.nbytes
        if n >= least or size >= 16 << 20:
            yield pa.concat_tables(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.concat_tables(held)


def _split(long: int):
    """Of (bucket, entries) sorted by bucket: (block, tile, a, slot, tiles) of the members of blocks that may be alike.

    ``block`` is a hash of the members, so the same members met under other keys of a kind are one
    block.  Tiles are of ``long`` members; the first of each also stand in tile -1.
    """

    def run(rows):
        for part in _parts(rows, "bucket", 100_000):
            key, ids, marks = _entries(part.column("entries"))
            if not len(key):
                continue
            label = _kin(key, marks)
            order = np.lexsort((ids, label))
            label, ids, slot = label[order], ids[order], key[order] >> 32
            fresh = np.concatenate([[True], (label[1:] != label[:-1]) | (ids[1:] != ids[:-1])])
            label, ids, slot = label[fresh], ids[fresh], slot[fresh]
            first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
            n = np.diff(np.append(first, len(label)))
            seed = (slot[first] // BLOCKS + 1).astype(np.uint64)
            total = np.add.reduceat(_mixed(ids.view(np.uint64) + np.repeat(seed, n)), first)
            columns = [np.repeat(_mixed(total).view(np.int64), n), (np.arange(len(ids)) - np.repeat(first, n)), ids, slot, np.repeat(n, n)]
            block, place, ids, slot, n = (x[np.repeat(n > 1, n)] for x in columns)
            if len(ids):
                heads = np.flatnonzero((place % long == 0) & (n > long))
                tile = np.concatenate([place // long, np.full(len(heads), -1)]).astype(np.int32)
                every = lambda x: np.concatenate([x, x[heads]])
                tiles = every((n - 1) // long + 1).astype(np.int32)
                yield pa.record_batch([pa.array(x) for x in (every(block), tile, every(ids), every(slot).astype(np.int32), tiles)], names=["block", "tile", "a", "slot", "tiles"])

    return freed(run)


def _first_met(keys: np.ndarray, there: np.ndarray, marks: np.ndarray, ii: np.ndarray, jj: np.ndarray) -> np.ndarray:
    """For each pair of lines: the first block in which the two meet and are near, ``SLOTS`` if there is none."""
    shared = (keys[ii] == keys[jj]) & there[ii] & there[jj]
    for kind in (0, 1):
        shared[:, kind * BLOCKS : (kind + 1) * BLOCKS] &= near(marks[ii, kind], marks[jj, kind])[:, None]
    return np.where(shared.any(1), shared.argmax(1), SLOTS)


def _first_slots(keys: np.ndarray, there: np.ndarray, marks: np.ndarray, hot: np.ndarray, i: int) -> np.ndarray:
    """``_first_met`` of each line before ``i`` with line ``i``; no block is left out, whatever ``hot`` says."""
    return _first_met(keys, there, marks, np.full(i, i), np.arange(i))


def _same(pairs: list[tuple[str, str]], most: list[int]) -> np.ndarray:
    """``within``, after very long texts went through ``may_be_alike``."""
    out = np.array([m <= 32 * WORDS or may_be_alike(*map(grams_of, x)) for x, m in zip(pairs, most, strict=True)], bool)
    asked = np.flatnonzero(out)
    out[asked] = within([pairs[k] for k in asked], [most[k] for k in asked])
    return out


#: Kinds of characters that are counted, and characters or pairs that are worked on at a time.
KINDS, AT_ONCE = 64, 1 << 14


def _counted(texts: list[str], chars: np.ndarray) -> np.ndarray:
    """How many characters of each kind each text has."""
    out = np.empty((len(texts), KINDS), np.int32)
    cuts = np.flatnonzero(np.diff(np.cumsum(chars) // (16 * AT_ONCE), prepend=-1)).tolist()
    for s, e in zip(cuts, [*cuts[1:], len(texts)], strict=True):
        kind = np.frombuffer("".join(texts[s:e]).encode("utf-32-le"), np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(26)
        out[s:e] = np.bincount(np.repeat(np.arange(e - s) * KINDS, chars[s:e]) + kind, minlength=(e - s) * KINDS).reshape(-1, KINDS)
    return out


class Lines:
    """Lines of whole blocks or tiles, compared pair by pair within each, but for what is connected already."""

    def __init__(self, part: pa.Table, forest: Forest, across: bool) -> None:
        self.forest, self.across = forest, across
        self.unit, self.slot, self.side, self.label = (part.column(c).to_numpy() for c in ("unit", "slot", "side", "label"))
        self.texts = [x.decode() for x in part.column("line").to_pylist()]
        self.chars = np.array(list(map(len, self.texts)))
        self.counts = _counted(self.texts, self.chars)
        listed = part.column("keys").combine_chunks().flatten()
        self.there = listed.is_valid().to_numpy(zero_copy_only=False).reshape(-1, SLOTS)
        self.keys = listed.fill_null(0).to_numpy().reshape(-1, SLOTS)
        self.marks = part.column("marks").combine_chunks().flatten().to_numpy().reshape(-1, 2)
        self.own = self.marks[np.arange(len(self.slot)), self.slot // BLOCKS]
        # Sets of connected lines as numbers; ``up`` leads from each to the one that it was joined to.
        known, self.set = np.unique(np.array([forest.root(x) for x in self.label.tolist()], np.int64), return_inverse=True)
        self.up = np.arange(len(known))

    def _roots(self) -> np.ndarray:
        while ((above := self.up[self.up]) != self.up).any():
            self.up = above
        return self.up[self.set]

    def _pairs(self):
        """The pairs to compare, as rows ii and jj, a bounded number at a time."""
        first = np.concatenate([[True], self.unit[1:] != self.unit[:-1]])
        place = np.arange(len(self.unit)) - np.maximum.accumulate(np.where(first, np.arange(len(self.unit)), 0))
        cuts = np.flatnonzero(np.diff(np.cumsum(place) // MADE, prepend=-1)).tolist()
        for s, e in zip(cuts, [*cuts[1:], len(place)], strict=True):
            n = place[s:e]
            ii = np.repeat(np.arange(s, e), n)
            jj = ii - 1 - (np.arange(len(ii)) - np.repeat(np.cumsum(n) - n, n))
            roots = self._roots()
            ok = (roots[ii] != roots[jj]) & near(self.own[ii], self.own[jj])
            if self.across:
                ok &= self.side[ii] != self.side[jj]
            ii, jj = ii[ok], jj[ok]
            ok = np.abs(self.chars[ii] - self.chars[jj]) <= self._most(ii, jj)
            ii, jj = ii[ok], jj[ok]
            ok = _first_met(self.keys, self.there, self.marks, ii, jj) == self.slot[ii]
            yield ii[ok], jj[ok]

    def _most(self, ii: np.ndarray, jj: np.ndarray) -> np.ndarray:
        return ((1 - SIMILARITY) * np.maximum(self.chars[ii], self.chars[jj]) + 1e-9).astype(np.int64)

    def _may(self, ii: np.ndarray, jj: np.ndarray) -> np.ndarray:
        """Which pairs' counts allow so few edits: each edit adds a character at most and takes one at most."""
        most, out = self._most(ii, jj), np.empty(len(ii), bool)
        for at in range(0, len(ii), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            more = self.counts[ii[part]] - self.counts[jj[part]]
            added = np.maximum(more, 0).sum(1)
            out[part] = np.maximum(added, added - more.sum(1)) <= most[part]
        return out

    def links(self) -> list[tuple[int, int]]:
        out, held, n = [], [], 0
        for pair in self._pairs():
            held.append(pair)
            if (n := n + len(pair[0])) > HELD:
                out += self._compared(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        return out + (self._compared(*map(np.concatenate, zip(*held, strict=True))) if held else [])

    def _compared(self, ii: np.ndarray, jj: np.ndarray) -> list[tuple[int, int]]:
        """First each line is compared with the nearest earlier one.  After that each two sets that are
        not connected are compared by 8, 64, 512, ... pairs of their lines, until none are left.
        """
        out, many = [], 1
        while len(ii):
            roots = self._roots()
            ri, rj = roots[ii], roots[jj]
            ii, jj, ri, rj = (x[ri != rj] for x in (ii, jj, ri, rj))
            if not len(ii):
                break
            key = (ii, ii) if many == 1 else (np.minimum(ri, rj), np.maximum(ri, rj))
            far = np.bitwise_count((self.own[ii] ^ self.own[jj]).view(np.uint64) >> np.uint64(16))
            order = np.lexsort((far, *key))
            new = np.concatenate([[True], (key[0][order][1:] != key[0][order][:-1]) | (key[1][order][1:] != key[1][order][:-1])])
            first = np.flatnonzero(new)
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            now, later = order[rank < many], np.sort(order[rank >= many])
            now = now[self._may(ii[now], jj[now])]
            same = now[_same([(self.texts[i], self.texts[j]) for i, j in zip(ii[now].tolist(), jj[now].tolist(), strict=True)], self._most(ii[now], jj[now]).tolist())]
            for i, j in zip(ii[same].tolist(), jj[same].tolist(), strict=True):
                u, v = int(self.label[i]), int(self.label[j])
                if self.forest.join(u, v):
                    out.append((u, v))
                    x, y = self._root(self.set[i]), self._root(self.set[j])
                    self.up[max(x, y)] = min(x, y)
            ii, jj, many = ii[later], jj[later], 8 * many
        return out

    def _root(self, x: int) -> int:
        while self.up[x] != x:
            x = self.up[x]
        return x


def _unpacked(part: pa.Table) -> pa.Table:
    """``part`` with the keys and marks of its sketches as lists; keys of blocks that a line is not in are null."""
    sketch = _records(part.column("sketch"), SKETCH)
    none = (sketch["kinds"][:, None] >> (np.arange(SLOTS) // BLOCKS) & 1) == 0
    lists = lambda x, null=None: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), mask=null))
    return part.drop_columns("sketch").append_column("keys", lists(sketch["keys"], none.ravel())).append_column("marks", lists(sketch["marks"]))


def _verified(across: bool):
    """Of (unit, a, slot, side, label, line, sketch) sorted by unit: links between labels of alike lines.

    Units are blocks or tiles of blocks; with ``across`` only lines of different sides are compared.
    A task yields a spanning forest.  A pair that meets in several blocks is compared in the first of them.
    """

    def run(rows):
        forest = Forest()
        for part in _parts(rows, "unit", 40_000):
            if links := Lines(_unpacked(part), forest, across).links():
                yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])
            if len(forest.parent) > NODES:
                forest = Forest()

    return freed(run)


def _id_text(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("string"), F.lit("-"))


def _dealt(rows: DataFrame, fetched: DataFrame, across: bool) -> DataFrame:
    """Links of ``rows(unit, a, slot, side, label)``, unit by unit."""
    joined = fetched.join(rows.hint("shuffle_hash"), "a").select("unit", "a", "slot", "side", "label", "line", "sketch")
    return written(joined.repartition("unit").sortWithinPartitions("unit", "a").mapInArrow(_verified(across), "u long, v long"), "line-links")


def _tile_links(members: DataFrame, fetched: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Links across the tiles of each block, but for tiles that are all connected; None where there are no tiles."""
    spark = members.sparkSession
    dealt = members.where("tile >= 0 and tiles > 1")
    if dealt.isEmpty():
        return None
    dealt = written(dealt.join(roots, "a", "left").select("block", "tile", "a", "slot", F.coalesce("component", "a").alias("label")), "line-tiles")
    tiles = dealt.groupBy("block", "tile").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    other = tiles.select("block", *(F.col(c).alias(f"{c}2") for c in ("tile", "low", "high")))
    two = tiles.join(other, "block").where("tile < tile2 and not (low = high and low = low2 and low = high2)")
    sides = F.explode(F.array(*(F.struct(F.col(c).alias("tile"), F.lit(k).alias("side")) for k, c in enumerate(("tile", "tile2"))))).alias("s")
    two = two.select("block", F.xxhash64("block", "tile", "tile2").alias("unit"), sides).select("block", "unit", "s.tile", "s.side")
    links = _dealt(dealt.join(two, ["block", "tile"]).select("unit", "a", "slot", "side", "label"), fetched.where("tiled"), True)
    dropped(spark, dealt)
    return links


@contextmanager
def _shuffles_deleted(spark: SparkSession):
    """Within, Spark deletes the shuffle files of a query at its end, not at some later collection of the driver's garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def line_groups(docs: DataFrame, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(occurrences, groups): doc_id, t, line, a, b of each line with words; a, b and the keeper of each repeated line."""
    lines, found = _line_groups(docs, long)
    return lines.where("line is not null").select("doc_id", "t", "line", "a", "b"), found


def _line_groups(docs: DataFrame, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(lines, groups): the rows of ``_line_rows``, also of texts without lines; ``groups`` as of ``line_groups``."""
    with _shuffles_deleted(docs.sparkSession):
        return _grouped(docs, long)


def _grouped(docs: DataFrame, long: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = written(keyed.mapInArrow(freed(_line_rows), f"doc_id {kind}, t long, {LINE}"), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "line", "t")
    distinct = written(lines.where("line is not null").groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")), "distinct-lines")
    buckets = min(1 << 16, max(BUCKETS, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    index = lines.where("sketch is not null").select("a", "sketch").mapInArrow(_indexed(buckets), "bucket int, entries binary")
    split = index.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_split(long), "block long, tile int, a long, slot int, tiles int")
    members = written(split.groupBy("block", "tile", "a").agg(F.min("slot").alias("slot"), F.max("tiles").alias("tiles")), "line-blocks")
    met = members.groupBy("a").agg((F.max("tiles") > 1).alias("tiled"))
    asked = F.collect_list(F.struct(F.col("first.line").alias("line"), "a", "b", "tiled")).alias("wanted")
    wanted = distinct.select("a", "b", "first").join(met.hint("shuffle_hash"), "a").groupBy(_id_text("first.doc_id").alias("d"), F.col("first.t").alias("t")).agg(asked)
    texts = keyed.select(_id_text().alias("d"), "t", "text").join(wanted.hint("shuffle_hash"), ["d", "t"])
    fetched = texts.mapInArrow(freed(_fetched), "a long, b long, tiled boolean, line binary, sketch binary")
    fetched = written(fetched, "suspect-lines")
    links = _dealt(members.select(F.xxhash64("block", "tile").alias("unit"), "a", "slot", F.lit(0).alias("side"), F.col("a").alias("label")), fetched, False)
    roots = connected_components(links, "line-links").withColumnRenamed("node", "a")
    more = _tile_links(members, fetched, roots)
    if more is not None and not more.isEmpty():
        # These links are between components, or lines that had none.
        merged = connected_components(more, "line-links")
        above = merged.select(F.col("node").alias("component"), F.col("component").alias("above"))
        moved = roots.join(above, "component", "left").select("a", F.coalesce("above", "component").alias("component"))
        roots = moved.unionByName(merged.withColumnRenamed("node", "a").join(roots, "a", "left_anti"))
    dropped(spark, members, fetched, links, more)
    # Lines of one component have one root; lines alone are told apart by both halves of their identity.
    alone = F.when(F.col("component").isNull(), F.col("b")).otherwise(0)
    rooted = distinct.select("a", "b", "first", "n").join(roots.hint("shuffle_hash"), "a", "left")
    # Lines that occur once and are like no other are in no group.
    rooted = rooted.where("component is not null or n > 1")
    rooted = written(rooted.select("a", "b", "first", "n", F.coalesce("component", "a").alias("ra"), alone.alias("rb")), "rooted-lines")
    dropped(spark, distinct)
    # A group may have very many lines, so they are dealt over parts, and its keeper goes back to the parts that hold some.
    dealt = rooted.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int"))
    halves = dealt.groupBy("ra", "rb", "part").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    keepers = halves.groupBy("ra", "rb").agg(F.min("first").alias("keeper"), F.sum("n").alias("n"), F.collect_list("part").alias("parts")).where("n > 1")
    keepers = keepers.select("ra", "rb", "keeper", F.explode("parts").alias("part"))
    found = dealt.select("a", "b", "ra", "rb", "part").join(keepers, ["ra", "rb", "part"]).select("a", "b", "keeper")
    return lines, found


def _fetched(rows):
    """The wanted lines of (d, t, text, wanted); rows that repeat d and t, which meet in a task, count once."""
    seen: set[tuple[str, int]] = set()
    for batch in batches(rows, 1_000, 8 << 20):
        fresh = []
        for i, owner in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if owner not in seen:
                seen.add(owner)
                fresh.append(i)
        if not fresh:
            continue
        batch = batch.take(pa.array(fresh))
        # The wanted lines of all texts, and where those of each text end.
        wanted, ends = batch.column(3).flatten(), np.cumsum(batch.column(3).value_lengths().to_numpy()).tolist()
        at, lines = dict(zip((x.name for x in wanted.type), wanted.flatten(), strict=True)), []
        numbers = at["line"].to_pylist()
        for text, s, e in zip(as_bytes(batch.column(2)), [0, *ends], ends, strict=False):
            split = text.split(b"\n")
            lines += [normalised(split[n]) for n in numbers[s:e]]
        columns = {"a": at["a"], "b": at["b"], "tiled": at["tiled"], "line": pa.array(lines, pa.binary())}
        yield pa.RecordBatch.from_pydict(columns | {"sketch": _binaries(_packed(lines), np.arange(1, len(lines) + 1))})


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, t, line, n and times: of the ``n`` rows of one id and text, ``times`` lose the line.

    times is n, or n - 1 where the first of the rows keeps it.
    """
    return _removed(*_line_groups(docs))


def _removed(lines: DataFrame, found: DataFrame) -> DataFrame:
    me = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "line", "t")
    each = lines.select("doc_id", "t", "line", "a", "b").join(found.hint("shuffle_hash"), ["a", "b"])
    counted = each.groupBy("doc_id", "t", "line", me.eqNullSafe(F.col("keeper")).alias("keeps")).agg(F.count("*").alias("n"))
    times = F.col("n") - F.col("keeps").cast("int")
    return counted.select("doc_id", "t", "line", "n", times.alias("times")).where("times > 0")


def _with_lost(keyed: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows of ``keyed``, by d and t, with lost, the sorted numbers of the lines that each row loses."""
    found = removed.groupBy(_id_text().alias("d"), "t").agg(F.max("n").alias("n"), F.collect_list(F.struct("line", "times")).alias("gone"))
    # Only rows that repeat id and text are told apart; the first of them keeps what the group keeps.
    turn = F.row_number().over(Window.partitionBy("d", "t").orderBy("d"))
    rows = keyed.join(found.hint("merge"), ["d", "t"], "left").withColumn("turn", turn)
    own = F.transform(F.filter("gone", lambda x: F.col("turn") > F.col("n") - x["times"]), lambda x: x["line"])
    lost = F.coalesce(F.array_sort(own), F.array().cast("array<int>"))
    return rows.withColumn("lost", lost).drop("d", "t", "n", "gone", "turn")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (numbers of the lines that go), a row per row of ``docs``."""
    lines, found = _line_groups(docs)
    # The texts are not read again for their numbers of lines.
    keyed = lines.where("n_lines is not null").select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), _id_text().alias("d"), "t")
    lost = _with_lost(keyed, _removed(lines, found))
    return lost.select("doc_id", "n_lines", F.size("lost").cast("long").alias("n_removed"), F.col("lost").alias("removed_lines"))


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text rebuilt from the lines that stay; all columns kept, also those of any other name."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), _id_text().alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    rows = _with_lost(keyed, removed_lines(docs))
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("lost", i)), "\n")
    text = F.when(F.size("lost") == 0, F.col("row.text")).otherwise(kept).alias("text")
    return rows.select(*(text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
