"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of benchmark items (a shorter item is one pattern).  For patterns
of one length m, a table maps each block of two neighbouring words to the shift that is safe where
a text shows that block at the end of the search window; unknown blocks, nearly all of them, skip
m-1 words at once.  Where the shift is zero, the bucket of that suffix block, split by the pattern's
first words, selects test strings, which are compared word by word.

Distinct windows are dealt into pack files of bounded size below the shared folder.  A task reads its
texts in chunks of bounded size and, for each chunk, loads one pack after another: its memory is one
pack and one chunk, whatever the benchmark holds, in one Python worker and one stage; nothing is
shuffled but the windows themselves.  A single text longer than a chunk is a chunk of its own.

A-Z are lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Null and wordless texts have no
words and are never hit; wordless items are no patterns.  Items with equal windows are all reported;
repeated benchmark rows with one id count once; null item ids take part in hits but are not listed.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, batches, freed, dropped, shared_path, written
from .files import file_uri, opened

WINDOW = 13
#: (window, item) pairs of one pack file, on average.
PACK = 200_000
#: Bytes of text that are scanned with every pack before the next texts are read.
CHUNK = 32 << 20
#: Keeps a-z, 0-9 and all bytes from 0x80, lower-cases A-Z, blanks the rest.
WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) < width:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


class WuManber:
    """Search for word sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]) -> None:
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(b, m + 1):
                block = p[end - b : end]
                self.shift[block] = min(self.shift.get(block, m), m - end)
            self.buckets[p[m - b :]][p[:b]].append((p, items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def search(self, words: list[bytes]):
        """(start, items) of each occurrence, in order."""
        m, n, default, shift, b = self.length, len(words), self.default, self.shift, self.block
        at = m
        if b == 2:
            while at <= n:
                block = (words[at - 2], words[at - 1])
                step = shift.get(block, default)
                if step:
                    at += step
                    continue
                yield from self._confirmed(words, at - m, block)
                at += 1
        else:
            for i, w in enumerate(words):
                if (w,) in shift:
                    yield from self._confirmed(words, i, (w,))

    def _confirmed(self, words, start, suffix):
        for p, items in self.buckets[suffix].get(tuple(words[start : start + self.block]), ()):
            if tuple(words[start : start + self.length]) == p:
                yield start, items


def compiled(patterns: dict[tuple[bytes, ...], list]) -> list[WuManber]:
    """One search a pattern length."""
    by_length: dict[int, dict] = defaultdict(dict)
    for p, items in patterns.items():
        by_length[len(p)][p] = items
    return [WuManber(x) for _, x in sorted(by_length.items())]


class Packs:
    """The pack files of a run, one compiled at a time; the last one stays for the next chunk."""

    def __init__(self, root: str, names: list[str]) -> None:
        self.root, self.names, self.held = root, names, (None, [])

    def searches(self):
        # The one at hand goes first, so that a single pack is compiled once a task.
        for name in sorted(self.names, key=lambda x: x != self.held[0]):
            if name != self.held[0]:
                self.held = (None, [])
                files, path = opened(self.root)
                with files.open_input_file(f"{path}/{name}") as f:
                    self.held = (name, compiled(pickle.loads(f.read())))
            yield self.held[1]


def _chunks(rows, most: int):
    """Lists of batches that hold ``most`` bytes of text together, or a little more."""
    held, size = [], 0
    for batch in batches(rows, 2_000, 4 << 20):
        held.append(batch)
        size += batch.column(batch.num_columns - 1).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return runs


def _scanned(root: str, names: list[str]):
    """Of rows with the text last: the other columns and what the packs find in it."""
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "spans": pa.list_(pa.int32())}

    def run(rows):
        packs = Packs(root, names)
        # With one pack there is nothing to come back to, so texts stream through.
        for chunk in _chunks(rows, CHUNK if len(names) > 1 else 1):
            texts = [as_bytes(b.column(b.num_columns - 1)) for b in chunk]
            found = [[([], set()) for _ in x] for x in texts]
            for searches in packs.searches():
                for own, out in zip(texts, found, strict=True):
                    for text, (spans, ids) in zip(own, out, strict=True):
                        words = words_of(text)
                        for s in searches:
                            for start, owners in s.search(words):
                                spans.append((start, start + s.length))
                                ids.update(owners)
            for batch, own, out in zip(chunk, texts, found, strict=True):
                cols: dict[str, list] = {k: [] for k in kinds}
                for text, (spans, ids) in zip(own, out, strict=True):
                    n, runs, items = len(words_of(text)), _merged(spans), sorted(ids)
                    hit = sum(b - a for a, b in runs)
                    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
                    for k, v in zip(cols, (n, hit, len(items), digest, hit > 0 and 20 * hit >= n, [x for r in runs for x in r]), strict=True):
                        cols[k].append(v)
                yield pa.record_batch([*batch.columns[:-1], *(pa.array(v, kinds[k]) for k, v in cols.items())], names=[*batch.schema.names[:-1], *cols])

    return run


def _patterns(width: int):
    def run(rows):
        for batch in batches(rows, 1_000, 4 << 20):
            words, items, part = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                for w in set(windows_of(words_of(text), width)):
                    joined = b" ".join(w)
                    words.append(joined)
                    items.append(item)
                    part.append(int.from_bytes(hashlib.blake2b(joined, digest_size=6).digest(), "big"))
            yield pa.record_batch([pa.array(words, pa.binary()), pa.array(items, pa.string()), pa.array(part, pa.int64())], names=["words", "item", "part"])

    return run


def _packed(root: str):
    """Of (pack, words, item) sorted by pack: one file a pack, named in the rows that come back."""

    def run(rows):
        files, path = opened(root)
        files.create_dir(path, recursive=True)
        now, held = None, {}

        def out():
            name = f"pack-{uuid.uuid4().hex}.bin"
            with files.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(pickle.dumps(held))
            return pa.record_batch([pa.array([name])], names=["name"])

        for batch in rows:
            for pack, words, item in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if pack != now:
                    if now is not None:
                        yield out()
                    now, held = pack, {}
                own = held.setdefault(tuple(words.split(b" ")), [])
                if item is not None:
                    own.append(item)
        if now is not None:
            yield out()

    return run


def pattern_packs(benchmark: DataFrame, width: int = WINDOW, pack: int = PACK) -> tuple[str, list[str]]:
    """Writes the windows of ``benchmark(item_id, text)`` as pack files: their folder and their names.

    The benchmark is read once; the driver receives one name a pack.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(_patterns(width), "words binary, item string, part long")
    rows = written(rows.distinct(), "windows")
    packs = max(1, -(-rows.count() // pack))
    root = file_uri(shared_path(spark, "packs"))
    dealt = rows.select(F.pmod("part", F.lit(packs)).alias("pack"), "words", "item").repartition(packs, "pack").sortWithinPartitions("pack")
    names = [r["name"] for r in written(dealt.mapInArrow(_packed(root), "name string"), "pack-names").collect()]
    dropped(spark, rows)
    return root, sorted(names)


def hits(docs: DataFrame, benchmark: DataFrame, *keep: str, width: int = WINDOW, pack: int = PACK) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and spans.

    spans lists the hit word runs as from, to, from, to; columns of these names in ``keep`` are not allowed.
    """
    state = docs.select(*keep, F.col("text").alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in state.schema.fields[:-1])
    result = f"{fields}n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>"
    return state.mapInArrow(freed(_scanned(*pattern_packs(benchmark, width, pack))), result)


def decontaminated(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` without benchmark windows, all columns kept.

    One window (13 consecutive words of an item, or a whole shorter item) is a leak in a text of any
    length, so a row with a hit word goes.  With ``least_share`` above 0 rows stay whose hit words
    are a smaller share of their words than that.
    """
    row = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    hit = F.col("n_hit") >= F.greatest(F.lit(1.0), F.col("n_words") * F.lit(float(least_share)))
    return hits(row, benchmark, "__row").where(~hit).select("__row.*")
