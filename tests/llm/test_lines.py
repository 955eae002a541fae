"""Line dedup: the chance that alike lines meet, by the kind of edit and the length of the line."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import lines
from millrace.operators.components import Forest


@pytest.fixture(scope="module")
def real_lines(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    return sorted({y for r in rows for x in (r["text"] or "").split("\n") if len((y := lines.normalised(x.encode()).decode()).split()) >= 5})


def edited(kind, text, rng):
    words, chars = text.split(" "), list(text)
    if kind == "word":
        words.pop(rng.randrange(len(words)))
        return " ".join(words)
    for i in rng.sample(range(len(chars)), int(kind)):
        chars[i] = rng.choice("abcdefghijklmnopqrstuvwxyz")
    return " ".join("".join(chars).split())


def meet(a, b):
    """Whether lines share a block in which they are near."""
    keys, marks, there = lines._sketched([a.encode(), b.encode()])
    return lines._first_slots(keys, there, marks, np.zeros(2, np.int64), 1)[0] < lines.SLOTS


@pytest.mark.parametrize("least, most", [(5, 14), (15, 39), (40, 10_000)])
@pytest.mark.parametrize("kind", ["1", "2", "word"])
def test_recall_over_alike_lines(real_lines, kind, least, most):
    rng, hit, n = random.Random(7), 0, 0
    for x in real_lines:
        if least <= len(x.split()) <= most:
            y = edited(kind, x, rng)
            if y != x and lines.alike(x, y):
                n, hit = n + 1, hit + meet(x, y)
    assert n >= 20 and hit >= 0.9 * n


def test_banded_tables_agree_with_the_distance():
    rng, pairs, most = random.Random(3), [], []
    for _ in range(3000):
        a = "".join(rng.choice("abc ä") for _ in range(rng.randint(0, 90)))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "xy"])
        pairs.append((a, "".join(b)))
        most.append(rng.randint(0, 9))
        if lines.alike(*pairs[-1]):
            assert lines.may_be_alike(*map(lines.grams_of, pairs[-1]))
    want = [lines.distance(a, b) <= m for (a, b), m in zip(pairs, most, strict=True)]
    assert lines.within(pairs, most).tolist() == want and 300 < sum(want) < 2700


@pytest.mark.parametrize("letters", ["abc ä", "ab—漢"])
def test_bands_of_several_words_agree_with_the_distance(letters):
    rng, pairs, most = random.Random(5), [], []
    for _ in range(600):
        n = rng.randint(0, 1200)
        a = "".join(rng.choice(letters) for _ in range(n))
        b = list(a)
        for _ in range(rng.randint(0, n // 5 + 2)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", letters[0], "xy"])
        pairs.append((a, "".join(b)))
        most.append(n // 10)
    want = [lines.distance(a, b) <= m for (a, b), m in zip(pairs, most, strict=True)]
    assert lines.within(pairs, most).tolist() == want and 60 < sum(want) < 540


def groups_by(spark, texts, long):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    occurrences, found = lines.line_groups(df, long)
    return {(r["doc_id"], r["keeper"]["doc_id"]) for r in occurrences.join(found, ["a", "b"]).select("doc_id", "keeper").collect()}


def test_groups_do_not_depend_on_the_size_of_tiles(spark):
    """Two groups of near copies each, of which only a few pairs of inner lines are alike."""
    rng, texts = random.Random(9), []

    def changed(text, n):
        chars = list(text)
        for at in rng.sample([i for i, c in enumerate(chars) if c != " "], n):
            chars[at] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        return "".join(chars)

    for _ in range(25):
        base = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(11)) for _ in range(25))
        for x in (base, changed(base, 27)):
            texts += [changed(x, 4) for _ in range(20)]
    whole = groups_by(spark, texts, 2_048)
    assert 25 <= len({k for _, k in whole}) < 45
    assert groups_by(spark, texts, 4) == whole


def test_memory_of_a_large_block():
    """All pairs of a block, in arrays of a few numbers each, do not fit a worker; they are made piece by piece."""
    n, head = 2_048, "one of very many lines that a template makes, which are alike but for the number "
    keys = pa.array([[7] * lines.SLOTS] * n, pa.list_(pa.int32()))
    marks = pa.array([[77, 77]] * n, pa.list_(pa.int64()))
    same = {k: pa.array(np.zeros(n, t)) for k, t in (("unit", np.int64), ("slot", np.int32), ("side", np.int32))}
    table = pa.table(same | {"label": pa.array(np.arange(n)), "line": pa.array([f"{head}{i:05}".encode() for i in range(n)]), "keys": keys, "marks": marks})
    tracemalloc.start()
    try:
        links = lines.Lines(table, Forest(), False).links()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(links) == n - 1 and peak < 64 << 20


def test_long_alike_texts_need_no_whole_table(monkeypatch):
    """A table of two texts of 30,000 characters costs more than a thousand pairs of ordinary lines."""
    rng, asked, pairs = random.Random(13), [], []
    for letters in ("abcdefghijklmnop qrstuvwxyz", "ab"):
        a = "".join(rng.choice(letters) for _ in range(30_000))
        b = list(a)
        for _ in range(600):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        pairs.append((a, "".join(b)))
    plain = lines.distance
    monkeypatch.setattr(lines, "distance", lambda a, b, most=None: asked.append(max(len(a), len(b))) or plain(a, b, most))
    assert lines.within(pairs, [3_000, 3_000]).all() and max(asked, default=0) < 3_000


def test_walks_and_stitches_are_never_shorter_than_the_distance():
    rng, found = random.Random(4), [0, 0, 0]
    for _ in range(5_000):
        letters = rng.choice(["ab", "abcd ", "abcdefghijkl mnopq"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        b = list(a)
        for _ in range(rng.randint(0, 10)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(["", letters[0], "xy", "z"])
        b, most = "".join(b), rng.randint(0, 14)
        got = [lines.distance(a, b) <= most, lines.walked(a, b, most), lines.stitched(a, b, most)]
        assert got[0] or not any(got[1:])
        found = [x + y for x, y in zip(found, got, strict=True)]
    assert min(found) > 1_000


def test_entries_hold_every_block_of_every_line(real_lines):
    """Blocks dealt out in buckets and read again are those of the sketches, but for blocks of one line."""
    some = [x.encode() for x in real_lines[:400]]
    some += [x + b" and" for x in some[:100]]
    packed = lines._packed(some)
    batch = pa.record_batch([pa.array(np.arange(len(some))), lines._binaries(packed, np.arange(1, len(some) + 1))], names=["a", "sketch"])
    out = pa.Table.from_batches(lines._indexed(64)(iter([batch.slice(0, 150), batch.slice(150)])))
    assert out.num_rows <= 64
    got = {}
    for part in out.column("entries").chunks[0]:
        for key, a, mark in zip(*(x.tolist() for x in lines._entries(pa.chunked_array([pa.array([part])]))), strict=True):
            got.setdefault(key, set()).add((a, mark))
    keys, marks, there = lines._sketched(some)
    want = {}
    for i, slot in zip(*(x.tolist() for x in np.nonzero(there)), strict=True):
        want.setdefault((slot << 32) + int(keys[i, slot].view(np.uint32)), set()).add((i, int(marks[i, slot // lines.BLOCKS])))
    assert got == {k: v for k, v in want.items() if len(v) > 1} and len(got) > 100


def test_shuffle_files_go_with_the_query_that_wrote_them(spark):
    """Left to the driver's garbage collection, those of all steps pile up; the session's setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    spark._jvm.System.gc()
    held = tracker.shuffleStatuses().size()
    df = spark.createDataFrame([(i, f"one line of text number {i // 2} that is alike") for i in range(40)], "doc_id long, text string")
    with lines._shuffles_deleted(spark):
        lines.written(df.groupBy("text").count(), "shuffled")
    assert tracker.shuffleStatuses().size() <= held and spark.conf.get(name, None) == before


def test_pairs_settled_by_edits_agree_with_the_distance(monkeypatch):
    """Also with limits above and below the edits that are followed, odd characters and pairs of other lengths together."""
    rng, pairs, most = random.Random(17), [], []
    for _ in range(1_500):
        letters = rng.choice(["ab", "abcd ", "abcdefghijkl mnopq", "ab ä—漢"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        b = list(a)
        for _ in range(rng.randint(0, 25)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(["", letters[0], "xy", "z"])
        pairs.append((a, "".join(b)) if rng.random() < 0.5 else ("".join(b), a))
        most.append(rng.randint(0, 40))
    want = np.array([lines.distance(a, b) <= m for (a, b), m in zip(pairs, most, strict=True)])
    assert lines.within(pairs, most).tolist() == want.tolist() and 300 < want.sum() < 1_200
    for edits in (5, 20, 320):
        monkeypatch.setattr(lines, "EDITS", edits)
        for at in range(0, len(pairs), 100):
            part = slice(at, at + 100)
            yes, left = lines._followed(pairs[part], np.array(most[part]))
            assert not (yes & left).any() and (yes == want[part])[~left].all() and not (yes & ~want[part]).any()
        assert left.mean() < 0.95
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 400)))
    assert lines.within([(many, many[:n] + "x" + many[n:]) for n in range(20)], [1] * 20).all()


def test_ordinary_pairs_need_no_table_of_columns(monkeypatch, real_lines):
    """The work on a pair grows with its edits; a table costs a step for every character."""
    rng, pairs, plain, asked = random.Random(19), [], lines._banded, []
    for x in [x for x in real_lines if len(x) >= 60][:200]:
        pairs += [(x, edited("2", x, rng)), (x, x[::-1])]
    monkeypatch.setattr(lines, "_banded", lambda pairs, limit: asked.extend(pairs) or plain(pairs, limit))
    got = lines.within(pairs, [lines.allowed(a, b) for a, b in pairs])
    assert got.tolist() == [lines.alike(a, b) for a, b in pairs] and len(asked) < len(pairs) // 20


def test_minima_do_not_depend_on_the_pieces(monkeypatch, real_lines):
    some = [x.encode() for x in real_lines[:300]]
    whole = lines._packed(some)
    monkeypatch.setattr(lines, "PIECE", 1 << 9)
    assert lines._packed(some).tobytes() == whole.tobytes()


@pytest.mark.parametrize("line", [b"", b"  ", b" a b ", b"a  b", b"a\tb", b"\va b\r", b"a\x1cb \xc2\xa0c", b"a\fb c"])
def test_plain_lines_are_joined_as_any_others(line):
    assert lines._joined(line, lines._plain(line)) == b" ".join(line.split())


def test_workers_collect_only_what_tasks_made():
    import gc

    from millrace.llm._common import freed

    gc.unfreeze()
    assert list(freed(iter)([1, 2])) == [1, 2] and gc.get_freeze_count() > 0
    gc.unfreeze()


def test_wanted_lines_are_fetched_once_per_row_key():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("line", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("tiled", pa.bool_())]))
    want = [[{"line": 1, "a": 5, "b": 6, "tiled": False}, {"line": 0, "a": 7, "b": 8, "tiled": True}], [], [{"line": 0, "a": 9, "b": 1, "tiled": False}]]
    rows = pa.record_batch([pa.array(["x", "y", "z"]), pa.array([1, 2, 3]), pa.array(["One  Two\nthree Four", "b", "\u00c4 long line"]), pa.array(want, kind)], names=["d", "t", "text", "wanted"])
    got = [r for batch in lines._fetched(iter([rows.slice(0, 1), rows])) for r in batch.to_pylist()]
    assert [(r["a"], r["b"], r["tiled"], r["line"].decode()) for r in got] == [(5, 6, False, "three four"), (7, 8, True, "one two"), (9, 1, False, "\u00e4 long line")]
    assert all(len(r["sketch"]) == lines.SKETCH.itemsize for r in got)


def test_equal_stretches_take_few_calls(monkeypatch):
    """Calls on few places cost more than characters, so a long equal stretch is looked at in large pieces."""
    calls, plain = [], lines._equal
    monkeypatch.setattr(lines, "_equal", lambda x: calls.append(len(x)) or plain(x))
    text = "".join(random.Random(23).choices("abcdefghijkl mnopq", k=6_000))
    pairs = [(text, text[:n] + "#" + text[n + 1 :]) for n in range(100, 1_300, 100)] + [("ab" * 3_000, "ba" * 3_000)]
    assert lines.within(pairs, [1] * len(pairs)).tolist() == [True] * 12 + [False] and len(calls) < 40
    assert lines.within([("ab" * 3_000, "ba" * 3_000)] * 12, [2] * 12).all()


def test_records_of_slices_and_of_large_binaries():
    values = np.arange(12, dtype="<u2")
    whole = lines._binaries(values, np.array([1, 5, 5, 12]))
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.chunked_array([whole.cast(kind)[:1], whole.cast(kind)[1:3], whole.cast(kind)[3:]])
        assert lines._records(column, values.dtype).tolist() == list(range(12))
        assert lines._records(whole.cast(kind)[1:], values.dtype).tolist() == list(range(1, 12)) and not len(lines._records(column[:0], values.dtype))


def test_texts_are_not_read_again_for_the_report(spark, tmp_path):
    """Numbers of lines come with the lines, for rows without lines too."""
    texts = [None, "", "\n\n", "one line\n\nanother line", "One  Line", "a\r\n\u00c4 b\n", None, "one line\n\nanother line"]
    ids = [1, 2, 3, 4, 5, 6, None, 4]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/read-once")
    report = lines.line_report(spark.read.parquet(f"{tmp_path}/read-once"))
    got = sorted((r["doc_id"] or 9, r["n_lines"], tuple(r["removed_lines"])) for r in report.collect())
    assert got == [(1, 0, ()), (2, 1, ()), (3, 3, ()), (4, 3, ()), (4, 3, (0, 2)), (5, 1, (0,)), (6, 3, ()), (9, 0, ())]
    assert not any("read-once" in x for x in report.inputFiles())
