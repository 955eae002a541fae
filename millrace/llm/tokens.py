"""Token ids as raw binary shards with a minimal perfect hash index.

Shards: documents in ascending doc_id order are range-partitioned; each task encodes its range and
writes one headerless file of little-endian unsigned ids, 16 bits wide where the vocabulary fits,
else 32.  Index: document keys are hashed to index buckets; each bucket is one file that holds a
minimal perfect hash (levels of bit arrays with the rank of every 512th bit), and per slot a 32-bit
fingerprint, the shard, the offset and the length.  A lookup hashes the key once a level, reads the
64 bytes around its bit and one rank, then one slot, compares the fingerprint, and reads the ids by
one byte range: constant work a key, whatever the corpus holds.  Many keys are dealt by bucket, so
each index file has one reader; one that looks up a large part of a bucket reads it whole.

Encoding: the tokenizer splits text before a single space between two non-spaces, so such pieces are
encoded once and looked up afterwards; texts with other runs of white space or with special
tokens are encoded whole.  Either way the ids are those of the tokenizer on the whole text.

Null text is empty and has the end id only.  Null doc_ids come first.  Rows with equal doc_ids are
told apart by their ordinal (in the order of the text's hash), which is part of the key.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import batches, freed, groups, shared_path, written
from .files import coalesced, file_uri, opened

END = 2
#: Pieces remembered by a Python worker, halved when full; rows of an index bucket; bytes read at once.
CACHE, BUCKET_ROWS, READ_MOST = 400_000, 250_000, 8 << 20
LOW = -(1 << 63)
#: Two characters that regular expressions may take for white space, side by side (for RE2, whose own class is ASCII).
RUNS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]{2}"
MAGIC = b"MPHI2\0\0\0"
GAMMA, LEVELS = 2.0, 48


class Encoder:
    """Ids of texts as packed bytes, with a bounded memory of pieces."""

    loaded: dict[tuple, Encoder] = {}

    def __init__(self, path: str, wide: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u4" if wide else "<u2")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for x, i in self.tokenizer.get_vocab().items() if x.startswith("\u0120")]] = True
        self.pieces = "ByteLevel" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None and "add_prefix_space=True" not in str(self.tokenizer.pre_tokenizer)
        # Pieces, their ids and how often batches met them; the first one is the empty piece, which stays.
        self.known, self.ids, self.met = pa.array([""], pa.large_string()), pa.array([b""], pa.large_binary()), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str, wide: bool) -> Encoder:
        if (path, wide) not in cls.loaded:
            cls.loaded[path, wide] = cls(path, wide)
        return cls.loaded[path, wide]

    def _direct(self, texts: list[str]) -> list[bytes]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in got]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, each behind a space, and where each starts: where an id starts with the space."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        texts = [" " + " ".join(pieces[at : at + 400]) for at in range(0, len(pieces), 400)]
        found = np.concatenate([np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        return found, np.flatnonzero(self.spaced[found])

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text; null is empty."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        if not len(texts):
            return []
        whole = pc.or_(pc.match_substring_regex(texts, RUNS), pc.match_substring_regex(texts, "^ | $|\\A\\z"))
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        whole = whole.to_numpy(zero_copy_only=False) if self.pieces else np.ones(len(texts), bool)
        out: list[bytes] = [b""] * len(texts)
        at = np.flatnonzero(whole)
        for i, ids in zip(at.tolist(), self._direct(texts.take(pa.array(at)).to_pylist()), strict=True):
            out[i] = ids
        at = np.flatnonzero(~whole)
        if len(at):
            split = pc.split_pattern(texts.take(pa.array(at)), " ")
            pieces, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            # The first piece of a text has no space before it.
            first = pieces.take(pa.array(offsets[:-1])).dictionary_encode()
            heads = self._direct(first.dictionary.to_pylist())
            data, ends = self._joined(pieces, offsets[:-1])
            ends = ends[offsets].tolist()
            for i, head, a, b in zip(at.tolist(), first.indices.to_pylist(), ends, ends[1:], strict=False):
                out[i] = heads[head] + data[a:b]
        return out

    def _joined(self, pieces: pa.Array, skipped: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Ids of all pieces in order but those ``skipped``, and where each piece's bytes start, with their end.

        Distinct pieces are encoded, the rest is gathered.
        """
        coded = pieces.dictionary_encode()
        names, which = coded.dictionary, coded.indices
        place = pc.index_in(names, value_set=self.known)
        new = names.filter(place.is_null())
        place = place.to_numpy(zero_copy_only=False)
        old = place[~np.isnan(place)].astype(np.int64) if len(new) else place.astype(np.int64)
        self.met[old] += 1
        row = np.empty(len(names), np.int64)
        missing = np.isnan(place) if len(new) else np.zeros(len(names), bool)
        row[~missing], row[missing] = old, len(self.known) + np.arange(len(new))
        if len(new):
            parts = [self._encoded(new.slice(at, 20_000)) for at in range(0, len(new), 20_000)]
            self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, *parts])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        own = self.ids.take(pa.array(row))
        if len(self.known) > CACHE:
            # Half of it stays: what batches met most often since it came, of late above all.
            kept = np.sort(np.argsort(-self.met[1:], kind="stable")[: CACHE // 2]) + 1
            kept = np.concatenate([np.zeros(1, np.int64), kept])
            self.known, self.ids, self.met = self.known.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.met[kept] // 2
        rows = which.to_numpy().copy()
        rows[skipped] = len(names)
        got = pa.concat_arrays([own, pa.array([b""], pa.large_binary())]).take(pa.array(rows))
        return memoryview(got.buffers()[2] or b""), np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)

    def _encoded(self, pieces: pa.Array) -> pa.Array:
        """Ids of each piece behind a space, as bytes."""
        found, cuts = self._pieces(pieces.to_pylist())
        if len(cuts) != len(pieces):
            raise ValueError("pieces and their ids do not match")
        offsets = np.append(cuts, len(found)).astype(np.int64) * self.kind.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(offsets), pa.py_buffer(found)])


def _write_shards(root: str, tokenizer: str, wide: bool, end: int):
    def run(rows):
        encoder, item = Encoder.of(tokenizer, wide), 4 if wide else 2
        files, path = opened(root)
        files.create_dir(path, recursive=True)
        name, at, stream = f"shard-{uuid.uuid4().hex}.bin", 0, None
        tail = np.array([end], encoder.kind).tobytes()
        last, times = object(), 0
        try:
            for batch in batches(rows, 8_000, 8 << 20):
                ids = encoder.encode(batch.column("text"))
                starts, lengths, ordinals = [], [], []
                stream = stream or files.open_output_stream(f"{path}/{name}", compression=None)
                for doc, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                    times = times + 1 if doc == last else 0
                    last = doc
                    ordinals.append(times)
                    stream.write(x + tail)
                    starts.append(at)
                    lengths.append(len(x) // item + 1)
                    at += lengths[-1]
                yield pa.record_batch([batch.column("part"), batch.column("doc_id"), pa.array(ordinals, pa.int32()), pa.array([name] * len(ids)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=["part", "doc_id", "ordinal", "file", "at", "n_tokens"])
        finally:
            if stream:
                stream.close()

    return run


def write_shards(docs: DataFrame, root: str, tokenizer: str, end: int = END, wide: bool = False) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` to shards below ``root``: part, doc_id, ordinal, file, at, n_tokens (committed)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__t", F.xxhash64(F.coalesce("text", F.lit(""))))
    ranged = ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__t")
    # Equal ids share a range, so they are neighbours in one sorted task and are numbered on the way.
    return written(ranged.select("part", "doc_id", "text").mapInArrow(freed(_write_shards(root, tokenizer, wide, end)), "part int, doc_id long, ordinal int, file string, at long, n_tokens long"), "shards")


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def key_hashes(doc_id: list[int | None], ordinal: list[int]) -> np.ndarray:
    ids = np.array([LOW if x is None else x for x in doc_id], np.int64).view(np.uint64)
    return _mix(_mix(ids, 1) + np.array(ordinal, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.array([x is None for x in doc_id], np.uint64), 2)


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """A minimal perfect hash over distinct 64-bit keys: levels of bit arrays.

    A key's slot is the rank of its bit at the first level where no other key of that level shared it.
    """
    levels, left = [], keys
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("keys are not distinct")
        size = max(8, int(GAMMA * len(left)))
        at = _level_bits(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def _level_bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mix(keys, 101 + level) % np.uint64(size)).astype(np.int64)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 7) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])
#: Of a level: its bits, where they and their ranks lie in the file, and the slots of the levels before.
LEVEL = np.dtype([("bits", "<u8"), ("at", "<u8"), ("ranks", "<u8"), ("before", "<u8")])
HEAD = struct.Struct("<8sQQQQ")
BLOCK_BYTES = 64


def dump_bucket(keys: np.ndarray, files: list[str], at: list[int], n: list[int]) -> bytes:
    """An index file: head, levels, shard names, bit arrays with ranks, entries by slot."""
    names = sorted(set(files))
    number = {x: i for i, x in enumerate(names)}
    listed = "\n".join(names).encode()
    levels = build_levels(keys)
    heads, parts = np.zeros(len(levels), LEVEL), []
    place, before = HEAD.size + heads.nbytes + len(listed), 0
    for i, bits in enumerate(levels):
        packed = np.packbits(bits, bitorder="little").tobytes()
        packed += bytes(-len(packed) % BLOCK_BYTES)
        counts = np.bitwise_count(np.frombuffer(packed, "<u8")).reshape(-1, 8).sum(1, dtype=np.int64)
        ranks = (np.cumsum(counts) - counts).astype("<u4").tobytes()
        heads[i] = (len(bits), place, place + len(packed), before)
        parts += [packed, ranks]
        place, before = place + len(packed) + len(ranks), before + int(counts.sum())
    table = np.zeros(len(keys), ENTRY)
    head = HEAD.pack(MAGIC, len(keys), len(levels), len(listed), place) + heads.tobytes() + listed + b"".join(parts)
    slot = Bucket(lambda size, offset: head[offset : offset + size]).slots(keys)
    table["print"][slot] = _prints(keys)
    table["shard"][slot] = [number[x] for x in files]
    table["at"][slot], table["n"][slot] = at, n
    return head + table.tobytes()


class Bucket:
    """One index file, of which ``read(size, offset)`` gives byte ranges."""

    def __init__(self, read) -> None:
        self.read = read
        magic, self.rows, levels, names, self.table = HEAD.unpack(read(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("no index file")
        rest = read(levels * LEVEL.itemsize + names, HEAD.size)
        self.levels = np.frombuffer(rest, LEVEL, levels)
        self.files = rest[levels * LEVEL.itemsize :].decode().split("\n") if names else []

    def _items(self, at: int, width: int, count: int, wanted: np.ndarray) -> np.ndarray:
        """Items of ``width`` bytes by number: one by one where they are few, else out of one whole read."""
        some, back = np.unique(wanted, return_inverse=True)
        if len(some) * 16 < count:
            data = b"".join(self.read(width, at + width * int(i)) for i in some)
            return np.frombuffer(data, np.uint8).reshape(-1, width)[back]
        return np.frombuffer(self.read(width * count, at), np.uint8).reshape(-1, width)[wanted]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit."""
        out = np.full(len(keys), -1, np.int64)
        for i, level in enumerate(self.levels):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            bit = _level_bits(keys[open_], i, int(level["bits"]))
            blocks = -(-int(level["bits"]) // (8 * BLOCK_BYTES))
            words = np.ascontiguousarray(self._items(int(level["at"]), BLOCK_BYTES, blocks, bit // 512)).view("<u8")
            word, inside = bit // 64 % 8, (bit % 64).astype(np.uint64)
            own = words[np.arange(len(bit)), word]
            hit = (own >> inside & np.uint64(1)).astype(bool)
            whole = np.where(np.arange(8) < word[:, None], np.bitwise_count(words), 0).sum(1)
            part = np.bitwise_count(own & ((np.uint64(1) << inside) - np.uint64(1)))
            ranks = np.ascontiguousarray(self._items(int(level["ranks"]), 4, blocks, bit[hit] // 512)).view("<u4").ravel()
            out[open_[hit]] = int(level["before"]) + ranks.astype(np.int64) + whole[hit] + part[hit]
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the keys that are there by fingerprint, and their entries."""
        slot = self.slots(keys)
        at = np.flatnonzero(slot >= 0)
        entry = np.ascontiguousarray(self._items(self.table, ENTRY.itemsize, self.rows, slot[at])).view(ENTRY).ravel()
        same = entry["print"] == _prints(keys[at])
        return at[same], entry[same]


def bucket_of(buckets: int) -> Column:
    """Ordinals spread the rows of one doc_id over buckets too."""
    return F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(LOW)), "ordinal"), F.lit(buckets)).cast("int")


def _write_buckets(root: str):
    def run(rows):
        files, path = opened(root)
        files.create_dir(path, recursive=True)
        held: dict[str, list] = {k: [] for k in ("doc_id", "ordinal", "file", "at", "n_tokens")}
        now = None

        def out():
            name = f"index-{uuid.uuid4().hex}.mph"
            data = dump_bucket(key_hashes(held["doc_id"], held["ordinal"]), held["file"], held["at"], held["n_tokens"])
            with files.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(data)
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([name]), pa.array([len(held["at"])], pa.int64())], names=["bucket", "name", "keys"])

        for batch in rows:
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if bucket[a] != now:
                    if now is not None:
                        yield out()
                        for x in held.values():
                            x.clear()
                    now = int(bucket[a])
                for k, x in held.items():
                    x += batch.column(k).slice(a, b - a).to_pylist()
        if now is not None:
            yield out()

    return run


def write_index(index: DataFrame, root: str, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """One perfect-hash file a bucket: (bucket, name, keys) committed, and the number of buckets."""
    # A bucket holds bucket_rows keys at most on average; small corpora still use every core.
    total = index.count()
    spread = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-total // bucket_rows), min(spread, -(-total // 1_000)))
    dealt = index.withColumn("bucket", bucket_of(buckets)).repartition("bucket").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(_write_buckets(root), "bucket int, name string, keys long"), "buckets"), buckets


def _lookup(root: str):
    def run(rows):
        files, path = opened(root)
        for part in groups(rows, "bucket"):
            # groups() gives whole buckets, several at once where they are small.
            number = part.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = part.slice(a, b - a)
                ids, ordinal = own.column("doc_id").to_pylist(), own.column("ordinal").to_pylist()
                with files.open_input_file(f"{path}/{own.column('name')[0].as_py()}") as f:
                    bucket = Bucket(lambda size, offset, f=f: f.read_at(size, offset))
                    at, entry = bucket.find(key_hashes(ids, ordinal))
                columns = [pa.array([ids[i] for i in at], pa.int64()), pa.array([ordinal[i] for i in at], pa.int32()), pa.array([bucket.files[i] for i in entry["shard"]], pa.string())]
                yield pa.record_batch([*columns, pa.array(entry["at"].astype(np.int64)), pa.array(entry["n"].astype(np.int64))], names=["doc_id", "ordinal", "file", "at", "n_tokens"])

    return run


def lookup(keys: DataFrame, buckets: DataFrame, count: int, root: str) -> DataFrame:
    """Where the documents of ``keys(doc_id, ordinal)`` lie: file, at and n_tokens; absent keys have no row."""
    dealt = keys.select("doc_id", "ordinal").withColumn("bucket", bucket_of(count)).repartition("bucket")
    placed = dealt.join(buckets.select("bucket", "name"), "bucket")
    return placed.sortWithinPartitions("bucket").mapInArrow(_lookup(root), "doc_id long, ordinal int, file string, at long, n_tokens long")


def _read(root: str, wide: bool, digest):
    def run(rows):
        files, path = opened(root)
        item, kind = (4, "<u4") if wide else (2, "<u2")
        for batch in rows:
            all_ = batch.to_pylist()
            by_file: dict[str, list[dict]] = {}
            for x in all_:
                by_file.setdefault(x["file"], []).append(x)
            for name, own in by_file.items():
                own.sort(key=lambda x: x["at"])
                with files.open_input_file(f"{path}/{name}") as f:
                    for start, n, inside in coalesced([(x["at"] * item, x["n_tokens"] * item) for x in own], 4096, READ_MOST):
                        data = f.read_at(n, start)
                        yield digest([(own[i], np.frombuffer(data, kind, own[i]["n_tokens"], own[i]["at"] * item - start)) for i in inside])

    return run


def _digests(found):
    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found]
    own = [x for x, _ in found]
    return pa.record_batch([pa.array([x["doc_id"] for x in own], pa.int64()), pa.array([x["ordinal"] for x in own], pa.int32()), pa.array([x["file"] for x in own]), pa.array([x["at"] for x in own], pa.int64()), pa.array([len(ids) for _, ids in found], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "ordinal", "file", "at", "n_tokens", "ids_crc32"])


def _id_lists(found):
    own = [x for x, _ in found]
    return pa.record_batch([pa.array([x["doc_id"] for x in own], pa.int64()), pa.array([x["ordinal"] for x in own], pa.int32()), pa.array([ids.astype(np.int64) for _, ids in found], pa.list_(pa.int64()))], names=["doc_id", "ordinal", "ids"])


def _dealt(places: DataFrame, wide: bool) -> DataFrame:
    block = F.floor(F.col("at") * (4 if wide else 2) / READ_MOST)
    return places.repartition("file", block).sortWithinPartitions("file", "at")


def read_ids(places: DataFrame, root: str, wide: bool = False) -> DataFrame:
    """doc_id, ordinal and ids (BIGINT array) of the places that ``lookup`` gave."""
    return _dealt(places, wide).mapInArrow(_read(root, wide, _id_lists), "doc_id long, ordinal int, ids array<long>")


def read_digests(places: DataFrame, root: str, wide: bool = False) -> DataFrame:
    """doc_id, ordinal, file, at, n_tokens and ids_crc32 of the places, read from the shards."""
    return _dealt(places, wide).mapInArrow(freed(_read(root, wide, _digests)), "doc_id long, ordinal int, file string, at long, n_tokens long, ids_crc32 long")


def wide_ids(tokenizer: str, end: int = END) -> bool:
    """Whether ids of a vocabulary need 32 bits."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab().values()
    return max(end, *vocabulary) > 0xFFFF


def tokenized(docs: DataFrame, tokenizer: str, end: int = END, wide: bool | None = None) -> DataFrame:
    """Writes shards and index, looks every document up in the index, reads it back and digests it.

    doc_id, start, n_tokens and ids_crc32, a row per row of ``docs``, all from the files.  ids are 16
    bits wide where the vocabulary fits, unless ``wide`` says otherwise.  doc_id is a whole number or
    null; other types raise an error.
    """
    spark = docs.sparkSession
    wide = wide_ids(tokenizer, end) if wide is None else wide
    root = file_uri(shared_path(spark, "tokens"))
    index = write_shards(docs, root, tokenizer, end, wide)
    buckets, count = write_index(index, root)
    found = lookup(index, buckets, count, root)
    return with_starts_of(read_digests(found, root, wide), index)


def with_starts_of(found: DataFrame, index: DataFrame) -> DataFrame:
    """start: the ids of all documents before, by sums over shards in order.

    The running sum is over one row a shard, which is what a listing of the files holds.
    """
    sums = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(sums.select("file", before.alias("base")), "file").select("doc_id", (F.col("base") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32", "ordinal")
