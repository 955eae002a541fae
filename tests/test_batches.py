"""Workers hold a piece of a batch, and the survivors of a component, in Python objects."""

import tracemalloc

import pyarrow as pa

from millrace.functions import text as T
from millrace.operators import dedup


def test_pieces():
    rows = ["ä" * 700_000, None, "b", "c" * (T.PIECE + 5), "", "d" * 900_000, "e" * 200_000]
    got = list(T.pieces(pa.array(["skipped", *rows], pa.string()).slice(1)))
    assert [x for piece in got for x in piece] == [x or "" for x in rows]
    assert all(len(p) == 1 or sum(len(x.encode()) for x in p) <= T.PIECE for p in got) and len(got) > 3
    assert T.mapped(len, pa.array([], pa.string()), pa.int64()).to_pylist() == []


def test_a_batch_is_not_held_in_objects():
    """Before, all texts and results of a batch were Python objects together: about 25 MB of texts and 130 MB of words here."""
    batch = pa.array(["<p>" + f"word{i} " * 1_000 + "</p>" for i in range(3_000)], pa.string())
    tracemalloc.start()
    out = T.mapped(str.split, batch, pa.list_(pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 3_000 and peak < 24 * T.PIECE


def fold_batch(rows):
    schema = pa.schema([("id", pa.string()), ("id_source", pa.string()), ("title", pa.string()), ("link", pa.string()), ("content", pa.string()), ("summary", pa.string()), ("author", pa.string()), ("published", pa.timestamp("us", "UTC")), ("updated", pa.timestamp("us", "UTC")), ("published_raw", pa.string()), ("categories", pa.list_(pa.string())), ("source_title", pa.string()), ("source_url", pa.string()), ("seq", pa.int64()), ("k_id", pa.string()), ("k_url", pa.string()), ("k_title", pa.list_(pa.string())), ("k_content", pa.list_(pa.int64())), ("k_summary", pa.list_(pa.int64())), ("component", pa.int64())])
    made = [{"id": f"i{seq}", "id_source": "guid", "title": title, "content": "x" * 4_000, "seq": seq, "k_id": f"i{seq}", "k_url": "", "k_title": title.split(), "k_content": list(range(seq, seq + 300)), "k_summary": [], "component": component} for seq, title, component in rows]
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in made], schema=schema)


def test_the_fold_holds_survivors_only():
    """Before, all rows of a component were one pandas frame: here 6,000 rows with 24 MB of texts and 1.8 million hashes."""
    component = [fold_batch([(i, "the same title", 0) for i in range(at, at + 1_000)]) for at in range(0, 6_000, 1_000)]
    others = fold_batch([(5, "one two", 7), (6, "three four", 7), (7, "one two", 7), (8, "one two", 8)])
    run = dedup._folded(dedup.DedupOptions(0.9, 259_200, 0.8))
    tracemalloc.start()
    out = [r for b in run(iter([*component, others.slice(0, 1), others.slice(1)])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["seq"], r["id"]) for r in out] == [(0, "i0"), (5, "i5"), (8, "i8")] and peak < 12 * 2**20
    assert list(run(iter([]))) == []
