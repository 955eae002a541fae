"""A hidden Markov language model, trained by Baum-Welch over all training texts.

Tokens are words and one end a text.  Unigram counts cover the whole vocabulary and stay a
distributed table: texts are packed into blocks of a few MB with a local vocabulary, so counts and
look-ups move one row a block and distinct token, never one a token.  The hidden states emit token
classes (a hash of the word to 2^15 classes, the end, and the unknown), so a model has a fixed size
whatever the corpus holds, and a token has its unigram share within its class:

    P(text) = P_hmm(classes) * product of P(token) / P(class)

which sums to one over the same vocabulary as the smoothed unigram base.  Each Baum-Welch round reads
the blocks once; every task runs a scaled forward-backward over its texts, all texts of a block in
step, and returns expected counts that are added up chunk by chunk on the executors.  The driver
receives one model of fixed size a round.  Scores come from the scaled forward recursion in doubles.

Null and empty texts are the end token alone.  Repeated rows count and score each for itself; rows
with a null doc_id are held out when crc32 of the empty string says so (it is 0, so they are).
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, as_bytes, batches, written

STATES, ROUNDS, CLASSES = 6, 3, 1 << 15
ADDED = 0.1
BLOCK_BYTES = 16 << 20
#: Chunks of the expected counts that are added up apart from each other.
CHUNKS = 32
END, UNKNOWN = CLASSES, CLASSES + 1


def token_class(token: bytes) -> int:
    """The class of a token; the empty one is the end."""
    return zlib.crc32(token) % CLASSES if token else END


def packed(ids: np.ndarray) -> bytes:
    """Integers as compressed byte planes: local ids are ordered by frequency, so high planes are nearly empty."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return raw.reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


BLOCK = "block string, tokens array<binary>, counts array<int>, classes binary, ids binary, lengths array<int>, doc_ids array<long>, held array<boolean>"


def _encoded(rows):
    held: dict[str, list] = {"id": [], "out": [], "words": []}
    size = 0

    def block():
        seen: dict[bytes, int] = {b"": 0}
        number = seen.setdefault
        ids = [np.fromiter((number(w, len(seen)) for w in [*words, b""]), np.int64, len(words) + 1) for words in held["words"]]
        flat, lengths = np.concatenate(ids), [len(x) for x in ids]
        train = np.repeat(~np.array(held["out"], bool), lengths)
        order = np.argsort(-np.bincount(flat, minlength=len(seen)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names = list(seen)
        tokens = [names[i] for i in order]
        flat = place[flat]
        counts = np.bincount(flat[train], minlength=len(tokens))
        classes = np.array([token_class(x) for x in tokens], np.uint16)
        values = ([uuid.uuid4().hex], [tokens], [counts.astype(np.int32)], [classes.tobytes()], [packed(flat)], [lengths], [list(held["id"])], [list(held["out"])])
        kinds = (pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
        names = ("block", "tokens", "counts", "classes", "ids", "lengths", "doc_ids", "held")
        return pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(names, values, kinds, strict=True)})

    for batch in batches(rows, 2_000, 4 << 20):
        for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
            held["id"].append(doc)
            held["out"].append(out)
            held["words"].append(text.translate(LOWER).split())
            size += len(text) + 64
            if size >= BLOCK_BYTES:
                yield block()
                size = 0
                for x in held.values():
                    x.clear()
    if held["id"]:
        yield block()


def held_out(doc_id, folds: int = 10):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def encoded(docs: DataFrame) -> DataFrame:
    """The blocks of ``docs(doc_id, text)``, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    return written(rows.mapInArrow(_encoded, BLOCK), "blocks")


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(token, class, c): the training count of every token of the corpus, 0 where only held-out texts have it."""
    rows = blocks.select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").cast("long").alias("c"))
    kind = F.when(F.octet_length("token") == 0, F.lit(END)).otherwise(F.crc32("token") % CLASSES).cast("int")
    return written(rows.select("token", kind.alias("class"), "c"), "vocabulary")


@dataclass
class Model:
    """Start, transition and emission probabilities; emission has a row a class."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    share: np.ndarray  # of each class under the unigram model


def first_model(share: np.ndarray, states: int, seed: int) -> Model:
    """Sticky states around the unigram shares, told apart by random factors."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(rng.normal(0, 0.7, (len(share), states)))
    emit[UNKNOWN] = share[UNKNOWN]
    emit[:UNKNOWN] *= (1 - share[UNKNOWN]) / emit[:UNKNOWN].sum(0)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit, share)


def next_model(old: Model, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: float = 50.0) -> Model:
    """The M step, smoothed towards the unigram shares; the unknown keeps its share in each state."""
    emit = emit + prior * old.share[:, None]
    emit[UNKNOWN] = 0
    emit = emit / emit.sum(0) * (1 - old.share[UNKNOWN])
    emit[UNKNOWN] = old.share[UNKNOWN]
    start, move = start + 0.1, move + 0.1
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit, old.share)


class Steps:
    """Texts in step: at time t the first ``active[t]`` of them, longest first, have a token."""

    def __init__(self, classes: np.ndarray, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        begin = np.cumsum(lengths) - lengths
        self.lengths, begin = lengths[self.order], begin[self.order]
        top = int(self.lengths[0]) if len(lengths) else 0
        self.active = len(lengths) - np.cumsum(np.bincount(lengths, minlength=top + 1))[:top]
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        # Time-major copy of the tokens: all first ones, all second ones, ...
        self.classes = np.empty(len(classes), np.int64)
        chunk = 0
        for t, n in enumerate(self.active.tolist()):
            self.classes[chunk : chunk + n] = classes[begin[:n] + t]
            chunk += n

    def forward(self, model: Model, keep: np.ndarray | None = None, scales: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each text, in the texts' own order: the scaled recursion."""
        total = np.zeros(len(self.lengths))
        if not len(total):
            return total
        alpha, emit, move, at = None, model.emit, model.move, self.at.tolist()
        for t in range(len(self.active)):
            a, b = at[t], at[t + 1]
            e = emit[self.classes[a:b]]
            alpha = model.start * e if t == 0 else (alpha[: b - a] @ move) * e
            s = alpha.sum(1)
            alpha /= s[:, None]
            if keep is None:
                total[: b - a] += np.log(s)
            else:
                keep[a:b] = alpha
                scales[a:b] = s
        out = np.empty(len(total))
        out[self.order] = total
        return out

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions: the scaled forward-backward recursion."""
        k = len(model.start)
        gamma, scales = np.empty((len(self.classes), k)), np.empty(len(self.classes))
        self.forward(model, gamma, scales)
        moves, at, emit, back = np.zeros((k, k)), self.at.tolist(), model.emit, model.move.T.copy()
        beta = None
        for t in range(len(self.active) - 1, -1, -1):
            a, b = at[t], at[t + 1]
            now = np.ones((b - a, k))
            if beta is not None:
                c = at[t + 2]
                x = emit[self.classes[b:c]] * beta
                x /= scales[b:c, None]
                moves += gamma[a : a + c - b].T @ x
                now[: c - b] = x @ back
            beta = now
            if t + 1 < len(self.active):
                # Only now: the step above needs the plain forward probabilities of this time.
                gamma[at[t + 1] : at[t + 2]] *= later
            later = now
        if len(self.active):
            gamma[: at[1]] *= later
        emissions = np.stack([np.bincount(self.classes, gamma[:, s], minlength=len(emit)) for s in range(k)], 1)
        return gamma[: at[1]].sum(0) if len(self.active) else np.zeros(k), moves * model.move, emissions


def _expectation(model: Model):
    k = len(model.start)

    def run(rows):
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))
        for batch in rows:
            for classes, ids, lengths, held in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                flat = np.frombuffer(classes, np.uint16).astype(np.int64)[unpacked(ids)]
                lengths, train = np.array(lengths, np.int64), ~np.array(held, bool)
                flat = flat[np.repeat(train, lengths)]
                if len(flat):
                    s, m, e = Steps(flat, lengths[train]).expected(model)
                    start, move, emit = start + s, move + m, emit + e
        parts = np.array_split(emit.astype(np.float32), CHUNKS)
        blobs = [x.tobytes() for x in parts] + [np.concatenate([start, move.ravel()]).astype(np.float32).tobytes()]
        yield pa.record_batch([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "sums"])

    return run


def _added(rows):
    sums: dict[int, np.ndarray] = {}
    for batch in rows:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(blob, np.float32).astype(np.float64)
            sums[chunk] = sums[chunk] + x if chunk in sums else x
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "sums"])


def trained(blocks: DataFrame, model: Model, rounds: int) -> Model:
    spark = blocks.sparkSession
    k = len(model.start)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        counts = blocks.select("classes", "ids", "lengths", "held").mapInArrow(lambda rows, sent=sent: _expectation(sent.value)(rows), "chunk int, sums binary")
        got = dict(counts.repartition("chunk").mapInArrow(_added, "chunk int, sums binary").collect())
        if not got:
            return model
        arrays = {c: np.frombuffer(bytes(x), np.float64) for c, x in got.items()}
        emit = np.concatenate([arrays[c].reshape(-1, k) for c in range(CHUNKS)])
        tail = arrays[CHUNKS]
        model = next_model(model, tail[:k], tail[k:].reshape(k, k), emit)
        sent.unpersist()
    return model


def class_shares(vocab: DataFrame) -> tuple[np.ndarray, int, int]:
    """The unigram share of each class, with N and V: one row a class to the driver, a fixed number."""
    known = vocab.where("c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = sum(r["n"] for r in known), sum(r["v"] for r in known)
    share, total = np.zeros(CLASSES + 2), n + ADDED * (v + 1)
    for r in known:
        share[r["class"]] = (r["n"] + ADDED * r["v"]) / total
    share[UNKNOWN] = ADDED / total
    return share, n, v


def _by_block(rows):
    """Of (block, place, c) sorted: the counts of a block's tokens as one binary."""
    now, held = None, []

    def out():
        return pa.record_batch([pa.array([now]), pa.array([np.array(held, "<i8").tobytes()], pa.binary())], names=["block", "c"])

    for batch in rows:
        names, counts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for name, c in zip(names, counts, strict=True):
            if name != now:
                if now is not None:
                    yield out()
                now, held = name, []
            held.append(c)
    if now is not None:
        yield out()


def _scores(model: Model, n: int, v: int):
    total = n + ADDED * (v + 1)

    def run(rows):
        for batch in rows:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                c = np.frombuffer(row["c"], "<i8")
                classes = np.frombuffer(row["classes"], np.uint16).astype(np.int64)
                classes[c == 0] = UNKNOWN
                log_p = np.log10((c + ADDED) / total)
                inside = log_p - np.log10(model.share[classes])
                ids, lengths = unpacked(row["ids"]), np.array(row["lengths"], np.int64)
                at = np.cumsum(lengths) - lengths
                sums = lambda x: np.add.reduceat(x[ids], at)
                hidden = Steps(classes[ids], lengths).forward(model) / np.log(10)
                out = (row["doc_ids"], row["held"], lengths, sums((c > 0).astype(np.int64)), sums(log_p), hidden + sums(inside))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def scored(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), a row per row of ``docs``."""
    blocks = encoded(docs)
    vocab = vocabulary(blocks)
    share, n, v = class_shares(vocab)
    model = first_model(np.where(share > 0, share, 1e-12), states, seed)
    model = trained(blocks, model, rounds) if n else model
    pairs = blocks.select("block", F.posexplode("tokens").alias("place", "token"))
    looked = pairs.join(vocab, "token").select("block", "place", "c")
    counts = written(looked.repartition("block").sortWithinPartitions("block", "place").mapInArrow(_by_block, "block string, c binary"), "counts")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = blocks.select("block", "classes", "ids", "lengths", "doc_ids", "held").join(counts, "block")
    out = rows.mapInArrow(lambda rows: _scores(sent.value, n, v)(rows), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))
