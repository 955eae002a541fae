"""Each operator against brute force, over a fixture of awkward rows and over the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import catalog, decontaminate, hmm, lines, mixing, quality, sharding, simhash, suffix, tokens, warc

from .fixtures import CLASHING, SCHEMA, clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 1: SimHash


def brute_print(text):
    words = WORD.findall(lowered(text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, k=4):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= k:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("name", ["docs", "real"])
def test_simhash_matches_all_pairs(name, request):
    df = request.getfixturevalue(name)
    assert sets(simhash.near_duplicates(clashing(df)), "doc_id", "fingerprint", "component_id") == brute_components(texts_of(df))


def test_position_sets_cover_every_pair():
    from itertools import combinations

    for k in (1, 2, 3, 4):
        chosen = [set(x) for x in simhash.position_sets(k)]
        assert all(any(t <= set(c) for t in chosen) for c in combinations(range(8), 8 - k))


@pytest.mark.parametrize("k", [2, 4])
def test_long_lists_are_dealt_until_short(spark, k):
    import numpy as np

    rng = np.random.default_rng(k)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = sorted({int(b) ^ sum(1 << int(x) for x in rng.integers(0, 40, rng.integers(0, 7))) for b in base for _ in range(300)})

    def classes(links):
        from millrace.llm._common import Forest

        f = Forest()
        for a, b in links:
            assert (a ^ b).bit_count() <= k
            f.join(a, b)
        return {x: f.root(x) for x in prints}

    want = classes((a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= k)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    lists = list(simhash.posting_lists(df, k, long=20))
    assert len(lists) > 1 and all(x.groupBy("key").count().agg(F.max("count")).first()[0] <= 20 for x in lists)
    got = dict(simhash.hamming_components(df, k, long=20).collect())
    assert {x: got.get(x, x) for x in prints} == want
    assert classes((int(a), int(b)) for a, b in simhash._frontier_links(np.array(prints, np.uint64), k)) == want


def test_chains_and_stars_are_one_component(spark):
    from millrace.operators.components import connected_components

    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(chain, "u long, v long").repartition(7)).collect())
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def test_deduplicated_keeps_one_of_each_component(docs):
    left = [(r["doc_id"], r["text"]) for r in simhash.deduplicated(clashing(docs)).collect()]
    comps = {d: c for d, _, c in brute_components(texts_of(docs)) if d is not None and d != 7}
    assert len(left) == len({c for _, _, c in brute_components(texts_of(docs))})
    assert sorted(d for d, _ in left if d in comps and d != 7) == sorted({c for c in comps.values()} - {7})
    assert set(CLASHING) <= set(simhash.deduplicated(clashing(docs)).columns)


# 2: repeated strings


@pytest.mark.parametrize("name", ["docs", "real"])
def test_suffix_dedup_matches_every_window(name, request):
    df = request.getfixturevalue(name)
    rows = texts_of(df)
    want = suffix.brute_force([(t or "").encode() for _, t in rows])
    got = suffix.without_repeats(clashing(df)).select("doc_id", "n_bytes", "runs", "kept").collect()
    mine = Counter((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["runs"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    assert mine == Counter((d, len((t or "").encode()), *w) for (d, t), w in zip(rows, want, strict=True))


@pytest.mark.parametrize("length, k", [(24, 8), (40, 16)])
def test_suffix_dedup_of_dense_repeats(spark, length, k):
    import random

    rng = random.Random(length)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, "a" * 500), (61, "ab" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"] - len(r["kept"]), len(r["runs"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.without_repeats(df, length, k).collect()}
    assert [got[i] for i, _ in rows] == suffix.brute_force([t.encode() for _, t in rows], length)


@pytest.mark.parametrize("hot", [0, 20])
def test_suffixes_of_frequent_anchors_are_dealt(spark, monkeypatch, hot):
    import random

    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(hot)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = word(90), word(70)
    rows = [(i, word(rng.randint(0, 60)) + passage[rng.choice([0, 0, 3]) :] + word(rng.randint(0, 60)) + (other if i % 3 else "")) for i in range(120)]
    rows += [(i + 120, t) for i, t in rows[:30]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"] - len(r["kept"]), len(r["runs"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.without_repeats(df, 40, 8).collect()}
    assert [got[i] for i, _ in rows] == suffix.brute_force([t.encode() for _, t in rows], 40)


def test_mergesort_and_bands(monkeypatch):
    import random

    rng = random.Random(5)
    tail = "".join(rng.choice("ab") for _ in range(60))
    contexts = [(rng.randint(0, 2), (("".join(rng.choice("ab") for _ in range(8)))[-o:] + tail[: rng.randint(30, 60)]).encode(), o) for o in [rng.randint(1, 8) for _ in range(200)]]
    contexts = [c for c in contexts if len(c[1]) >= 20]
    want = suffix.repeated_windows(contexts, 20)
    monkeypatch.setattr(suffix, "BATCH_SUFFIXES", 50)
    assert suffix.repeated_windows(contexts, 20) == want
    seen = Counter((g, o - i, b[i : i + 20]) for g, b, o in contexts for i in range(len(b) - 19))
    for (g, b, o), runs in zip(contexts, want, strict=True):
        hit = {i for i in range(len(b) - 19) if seen[g, o - i, b[i : i + 20]] > 1}
        assert {i for s, e in runs for i in range(s, e)} == hit


def test_the_suffix_sort_compares_bytes_and_needs_no_hashes(monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(suffix, "prefix_hashes", None)
    rng = random.Random(6)
    for length in (3, 8, 20, 40):
        bodies = [bytes(rng.choice(b"\x00\xff") for _ in range(rng.randint(length, length + 3))) for _ in range(200 if length < 9 else 50)]
        bodies += bodies[:20]
        contexts = [(rng.randint(0, 1), b, 3) for b in bodies]
        seen = Counter((g, i, b[i : i + length]) for g, b, _ in contexts for i in range(len(b) - length + 1))
        for (g, b, _), runs in zip(contexts, suffix.repeated_windows(contexts, length), strict=True):
            assert {i for s, e in runs for i in range(s, e)} == {i for i in range(len(b) - length + 1) if seen[g, i, b[i : i + length]] > 1}
    one = suffix.Suffixes([b"abcabcabd"], 3)
    assert one.common(np.array([0, 0]), np.array([3, 6])).tolist() == [3, 2] and one.tied(np.array([0, 3, 6]), np.array([3])).tolist() == [0, 1]


def test_a_hash_collision_removes_nothing(monkeypatch):
    monkeypatch.setattr(suffix.Suffixes, "common", lambda self, a, b: __import__("numpy").full(len(a), self.length))
    bodies = [(1, b"a" * 30, 3), (1, b"a" * 3 + b"b" * 27, 3), (1, b"a" * 30, 3)]
    assert suffix.repeated_windows(bodies, 20) == [[(0, 11)], [], [(0, 11)]]


def test_equal_context_hashes_remove_nothing(spark, monkeypatch):
    import random

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(60)
    rows = [(i, word(300) + shared + word(300)) for i in range(6)]
    monkeypatch.setattr(suffix, "context_hash", lambda *_: 1)
    texts = [t.encode() for _, t in rows]
    got = {(h, p) for t in texts for h, at, first, last, p in suffix.anchors(t, 200, 32)}
    assert len(got) == sum(len(suffix.anchors(t, 200, 32)) for t in texts)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"d": [i for i, _ in rows], "t": [0] * 6, "text": [t for _, t in rows]})
    (out,) = suffix._anchor_rows(200, 32)(iter([batch]))
    assert set(out.column("c").to_pylist()) == {1} and len(set(zip(out.column("h").to_pylist(), out.column("p").to_pylist(), strict=True))) == out.num_rows


# 3: sharding


def test_sharding_is_balanced_gapless_and_complete(docs, real):
    for df, shards in ((real, 16), (docs, 4)):
        got = sharding.histogram_sharded(clashing(df.select("doc_id", "text")), shards).select("doc_id", "text", "size", "shard", "slot").collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(texts_of(df))
        per, total = defaultdict(list), 0
        for r in got:
            assert r["size"] == len((r["text"] or "").encode()) + 1
            per[r["shard"]].append(r)
            total += r["size"]
        assert set(per) <= set(range(shards))
        for rows in per.values():
            assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        largest = max(r["size"] for r in got)
        bytes_ = [sum(r["size"] for r in per[s]) for s in range(shards)]
        if df is real:
            assert max(abs(b - total / shards) for b in bytes_) <= 2 * largest


def test_sharding_splits_a_group_that_is_too_large(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = sharding.histogram_sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 40
    again = sharding.histogram_sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 8).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_registered_sharding_against_a_sorted_list(spark, sf_dir, real):
    """Rows in the order of (XXH64 of the text, doc_id), cut where the bytes before come nearest to each goal."""
    ordered = real.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy("h", "doc_id").collect()
    got = {r["doc_id"]: r for r in catalog.op3_histogram_sharding(spark, sf_dir).collect()}
    assert len(got) == len(ordered)
    total, largest = sum(len(r["text"].encode()) + 1 for r in ordered), max(len(r["text"].encode()) + 1 for r in ordered)
    before, last = 0, (0, -1)
    for r in ordered:
        x, size = got[r["doc_id"]], len(r["text"].encode()) + 1
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (size, zlib.crc32(r["text"].encode()), "bytes", None)
        # Each row follows its neighbour: the next slot of the same shard, or the first of the next one.
        assert (x["shard"], x["slot"]) in ((last[0], last[1] + 1), (last[0] + 1, 0)), (x, last)
        if x["slot"] == 0 and x["shard"]:
            assert abs(before - total * x["shard"] / 16) <= largest
        before, last = before + size, (x["shard"], x["slot"])
    assert last[0] == 15


def test_sharding_by_string_ids_and_many_sub_ranges(spark):
    rows = [(f"id{i}", f"text {i % 50}") for i in range(3000)] + [(None, "text 1")]
    got = sharding.histogram_sharded(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), 4, sub_bytes=100).collect()
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r)
    assert sorted((r["doc_id"] or "", r["text"]) for r in got) == sorted((a or "", b) for a, b in rows)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in per.values())
    sizes = [sum(r["size"] for r in per[i]) for i in range(4)]
    assert max(sizes) - min(sizes) < 60


# 4: lines


def test_edit_distance():
    import random

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert lines.distance(a, b) == slow(a, b)


def edits(a, b):
    """Edit distance by the textbook table, numpy a row."""
    import numpy as np

    y, row = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != ord(c)))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def brute_lines(rows):
    """All pairs of distinct lines by edit distance alone."""
    found = []
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            own = " ".join(line.lower().split())
            if own:
                found.append(((d is None, d or 0, n), d, own))
    distinct = sorted({x[2] for x in found}, key=len)
    letters = {x: Counter(x) for x in distinct}
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, b in enumerate(distinct):
        for a in reversed(distinct[:i]):
            most = int(0.1 * len(b) + 1e-9)
            if len(b) - len(a) > most:
                break
            # Letters that the longer one has more of cost an edit each.
            if (letters[b] - letters[a]).total() <= most and root(a) != root(b) and edits(a, b) <= most:
                parent[root(a)] = root(b)
    first = {}
    for place, _, own in sorted(found):
        first.setdefault(root(own), place)
    return Counter((d, place[2]) for place, d, own in found if first[root(own)] != place)


def test_line_dedup_matches_all_pairs(spark, real):
    df = real.where("doc_id < 200")
    got = Counter()
    for r in lines.line_report(clashing(df)).collect():
        assert r["n_removed"] == len(r["removed_lines"])
        got.update((r["doc_id"], n) for n in r["removed_lines"])
    assert got == brute_lines(texts_of(df))


def test_fuzzy_lines_join_and_repeated_rows(spark):
    base = "the quick brown fox jumps over the lazy dog while many other animals watch it from the hill near the old river bank " * 3
    rows = [(1, base), (2, base.replace("quick", "quicK").upper()), (3, base.replace("hill", "hall")), (4, "other\n" + base.strip() + " "), (5, None), (6, ""), (7, "\n\n"), (8, "twice in\nfull"), (8, "twice in\nfull"), (9, "full\nand more"), (None, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_lines"], r["removed_lines"]) for r in lines.line_report(df).collect()), key=str)
    want = brute_lines([r for r in rows if r[0] not in (8, 9)])
    assert sum(len(x[2]) for x in got if x[0] not in (8, 9)) == sum(want.values())
    assert [x for x in got if x[0] in (8, 9)] == [(8, 2, [0, 1]), (8, 2, []), (9, 2, [0])]
    names = ["row", "d", "t", "n", "gone", "lost", "turn", "line", "__d", "__t", "__gone"]
    left = lines.without_duplicate_lines(df.withColumns({x: F.lit(x) for x in names}))
    assert left.columns == [*df.columns, *names] and {r["gone"] for r in left.collect()} == {"gone"}
    texts = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert texts == Counter([(1, base), (2, ""), (3, ""), (4, "other"), (5, None), (6, ""), (7, "\n\n"), (8, "twice in\nfull"), (8, ""), (9, "and more"), (None, "")])


def test_string_ids_and_long_blocks_of_lines(spark):
    import random

    rng = random.Random(4)
    head = "this order of the regional office for public works was registered under the number "
    rows = [(f"d{i:04}", f"{head}{rng.randint(0, 10**6):07} and {rng.randint(0, 10**6):07}") for i in range(600)] + [(f"x{i}", hashlib.sha512(b"%d" % i).hexdigest()) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    for long in (2_048, 40):
        found = {(r["a"], r["b"]) for r in lines.line_groups(df, long)[1].select("a", "b").collect()}
        assert len(found) == len({t for d, t in rows if d[0] == "d"})
    assert lines.line_report(df).agg(F.sum("n_removed")).first()[0] == 599


# 5: WARC


def test_warc_round_trip(spark):
    pages = [(1, "http://a/ä b?x=1", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://c/\r\nX: y", "tail\r\n\r\nbody ä" * 1000), (None, "http://n/", "<p>one</p>"), (None, "http://m/", "alone"), (9, "http://e", "twin"), (9, "http://e", "twin")]
    index, root = warc.archived(clashing(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)), 0)
    got = warc.read_records(index, root).collect()
    largest = {}
    for p, _, h in pages:
        if p is not None:
            largest[h or ""] = max(p, largest.get(h or "", p))
    want = Counter()
    for p, _, h in pages:
        top = largest.get(h or "")
        revisit = top is not None and p != top
        want[p, len((h or "").encode()), warc.payload_digest((h or "").encode()), "revisit" if revisit else "response", top if revisit else None] += 1
    assert Counter((r["page_id"], r["size"], r["digest"], r["type"], r["refers_to"]) for r in got) == want
    assert {r["payload"].decode() for r in got if r["type"] == "response"} == {h or "" for _, _, h in pages}
    some = warc.read_records(index.where("page_id = 5"), root).collect()
    assert [r["payload"].decode() for r in some] == [pages[4][2]]


def test_warc_below_the_least_payload_all_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    index, root = warc.archived(pages, 3)
    assert sets(warc.read_records(index, root), "page_id", "type") == Counter([(1, "response"), (2, "response"), (3, "revisit"), (4, "response")])


def test_coalesced_reads_cover_all_ranges():
    from millrace.llm.files import coalesced

    ranges = [(0, 10), (10, 5), (30, 5), (1000, 50), (1050, 400)]
    got = list(coalesced(ranges, 20, 300))
    assert [x[2] for x in got] == [[0, 1, 2], [3], [4]]
    assert all(s <= ranges[i][0] and ranges[i][0] + ranges[i][1] <= s + n for s, n, inside in got for i in inside)


# 6: mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (budget - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        new = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not new:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= new


@pytest.mark.parametrize("name", ["docs", "real"])
def test_mixing_meets_targets_and_agrees(name, request):
    df = request.getfixturevalue(name)
    got = mixing.taken(clashing(df)).collect()
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in df.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    targets = brute_targets(dict(sizes))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(rows)
    words = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        words[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(words[s] - targets[s]) <= max(n for _, x, n in rows if x == s)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.taken(df.repartition(7)).collect()))
    copies = Counter((r["doc_id"], r["source"], r["size"]) for r in got for _ in range(r["copies"]))
    mix = mixing.mixture(clashing(df))
    assert Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in mix.collect()) == copies


def test_mixing_uses_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), "a" if i % 3 else "b") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.taken(df, weights=(1.0, 2.0)).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 9 for r in got)


# 7: language model


def brute_base(rows):
    toks = [[*WORD.findall(lowered(t)), None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return {i: (d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, ((d, _), t, h) in enumerate(zip(rows, toks, held, strict=True))}


@pytest.mark.parametrize("name", ["docs", "real"])
def test_language_model(name, request):
    df = request.getfixturevalue(name)
    got = hmm.scored(clashing(df)).collect()
    want = brute_base(texts_of(df))
    key = lambda x: (x[0] is None, x[0] or 0, x[2], round(x[5], 6))
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(mine, sorted(want.values(), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    if name == "real":
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_forward_backward_matches_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    share = np.zeros(hmm.CLASSES + 2)
    share[:3], share[hmm.END], share[hmm.UNKNOWN] = 0.3, 0.08, 0.02
    model = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), share[:, None] * rng.uniform(0.5, 1.5, (len(share), 2)), share)
    texts = [[0, 1, 2, hmm.END], [2, hmm.END], [1, 1, 0, 0, 2, hmm.END], [hmm.END]]
    flat, lengths = np.concatenate([np.array(t) for t in texts]), np.array([len(t) for t in texts])
    got = hmm.Steps(flat, lengths).forward(model)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros_like(model.emit)
    for i, t in enumerate(texts):
        paths = list(itertools.product(range(2), repeat=len(t)))
        p = [np.prod([model.start[s[0]], *(model.move[a, b] for a, b in itertools.pairwise(s)), *(model.emit[c, x] for c, x in zip(t, s, strict=True))]) for s in paths]
        assert math.isclose(got[i], math.log(sum(p)), rel_tol=1e-9)
        for q, s in zip(p, paths, strict=True):
            q = q / sum(p)
            start[s[0]] += q
            for a, b in itertools.pairwise(s):
                move[a, b] += q
            for c, x in zip(t, s, strict=True):
                emit[c, x] += q
    for mine, want in zip(hmm.Steps(flat, lengths).expected(model), (start, move, emit), strict=True):
        assert np.allclose(mine, want)


def test_model_sums_to_one_over_the_vocabulary():
    import numpy as np

    share = np.full(hmm.CLASSES + 2, 1 / (hmm.CLASSES + 2))
    model = hmm.first_model(share, 4, 1)
    assert np.allclose(model.emit.sum(0), 1)
    again = hmm.next_model(model, np.ones(4), np.ones((4, 4)), np.random.default_rng(0).uniform(0, 5, model.emit.shape))
    assert np.allclose(again.emit.sum(0), 1) and np.allclose(again.move.sum(1), 1) and np.allclose(again.emit[hmm.UNKNOWN], share[hmm.UNKNOWN])


# 8: tokens


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(catalog.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


@pytest.mark.parametrize("name", ["docs", "real"])
def test_token_round_trip(name, request):
    import struct

    df = request.getfixturevalue(name)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.tokenized(clashing(df), catalog.tokenizer_path()).collect() if True) if name == "real" else sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.tokenized(df, catalog.tokenizer_path()).collect()), key=str)
    rows = texts_of(df)
    ids = whole_ids([t for _, t in rows])
    want = Counter((d, len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for (d, _), i in zip(rows, ids, strict=True))
    assert Counter(x[1:] for x in got) == want
    at = 0
    last = (False, 0)
    for start, d, n, _ in sorted(got, key=lambda x: (x[0], x[2])):
        assert start == at and last <= (d is not None, d or 0)
        at, last = at + n, (d is not None, d or 0)


def test_pieces_give_the_ids_of_the_whole_text():
    import random

    import numpy as np

    rng = random.Random(2)
    parts = ["word", " ", "  ", "\n", "\t", "don't", "'s", "12.5", "<|endoftext|>", "ä漢", " ", " ", "\x1c", "​", "!", "...", "😀", "\u0085", "'", "<|", "᠎", "﻿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", " ", "a", " a", "a "]
    encoder = tokens.Encoder(catalog.tokenizer_path(), False)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [x[:-1] for x in whole_ids(texts)]


def test_pieces_met_often_stay_when_the_memory_is_full(monkeypatch):
    import numpy as np

    monkeypatch.setattr(tokens, "CACHE", 100)
    encoder, seen = tokens.Encoder(catalog.tokenizer_path(), False), []
    inner = encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda pieces: seen.extend(pieces) or inner(pieces))
    common = "x " + " ".join(f"common{i}" for i in range(20))
    batches = [[common, common]] * 3 + [[f"x rare{i} seldom{i}" for i in range(at, at + 30)] for at in range(0, 120, 30)] + [[common, "alone", ""]]
    for texts in batches:
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [x[:-1] for x in whole_ids(texts)]
    assert sum(x.startswith("common") for x in seen) == 20
    assert len(encoder.known) <= 100 and encoder.encode(["a b", None]) == [*encoder.encode(["a b"]), b""]


def test_perfect_hash_is_minimal_and_rejects_strangers():
    import numpy as np

    n = 50_000
    keys = tokens.key_hashes(list(range(n)), [0] * n)
    strange = tokens.key_hashes(list(range(n, 3 * n)), [0] * 2 * n)
    data = tokens.dump_bucket(keys, ["f"] * n, list(range(n)), [1] * n)
    read = []

    def at(size, offset):
        read.append(size)
        return data[offset : offset + size]

    bucket = tokens.Bucket(at)
    assert sorted(bucket.slots(keys)) == list(range(n))
    got, entry = bucket.find(keys)
    assert len(got) == n and np.array_equal(entry["at"], np.arange(n))
    assert len(bucket.find(strange)[0]) <= 2
    read.clear()
    got, entry = tokens.Bucket(at).find(keys[100:110])
    assert np.array_equal(entry["at"], np.arange(100, 110)) and sum(read) < 20_000 < len(data)
    assert len(tokens.Bucket(lambda size, offset: tokens.dump_bucket(keys[:0], [], [], [])[offset : offset + size]).find(keys[:5])[0]) == 0


def test_keyed_access(spark, docs, tmp_path):
    root = f"file://{tmp_path}/shards"
    index = tokens.write_shards(docs, root, catalog.tokenizer_path())
    buckets, n = tokens.write_index(index, root, 10)
    keys = spark.createDataFrame([(7, 0), (7, 1), (7, 2), (12, 0), (99999, 0), (None, 0)], "doc_id long, ordinal int")
    got = {(r["doc_id"], r["ordinal"]): r["ids"] for r in tokens.read_ids(tokens.lookup(keys, buckets, n, root), root).collect()}
    assert set(got) == {(7, 0), (7, 1), (12, 0), (None, 0)}
    assert got[12, 0] == whole_ids([documents()[12][1]])[0]
    assert sorted([got[7, 0], got[7, 1]]) == sorted(whole_ids(["   \n\t ", "a second text with the id seven"]))
    assert not tokens.wide_ids(catalog.tokenizer_path(), 2) and tokens.wide_ids(catalog.tokenizer_path(), 70_000)


# 9: quality rules


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    own = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(hit)


@pytest.mark.parametrize("name", ["docs", "real"])
def test_quality_measures(name, request):
    df = request.getfixturevalue(name)
    book = quality.ledger(clashing(df))
    want = Counter()
    for d, t in texts_of(df):
        m = brute_measures(t)
        want[d, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]] += 1
    assert sets(book, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.rejected(quality.BASE)) == want


def test_policies_and_ablation_use_the_ledger_only(docs):
    rows = quality.ledger(docs).select("failed").collect()
    book = quality.ledger(docs).select("doc_id", "failed")
    got = {r["rule"]: (r["fails"], r["fails_only_it"], r["kept_without"]) for r in quality.ablation(book, quality.V1).collect()}
    for i, rule in enumerate(quality.RULES):
        f = [r["failed"] for r in rows]
        assert got[rule.name] == (sum(x >> i & 1 for x in f), sum(x == 1 << i for x in f), sum(x & ~(1 << i) == 0 for x in f))
    both = quality.judged(book, quality.BASE, quality.V1).columns
    assert both[-2:] == ["kept_base", "kept_v1"]
    assert quality.accepted(clashing(docs)).columns == clashing(docs).columns


# 10: decontamination


def brute_hits(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))

    wins = defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12)) if w else ():
            wins[tuple(w[i : i + 13])].add(item)
    out = Counter()
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= own
        names = sorted(str(x) for x in ids if x is not None)
        out[d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("pack", [7, 200_000])
def test_decontamination_matches_every_window(spark, docs, pack):
    a = documents()[0][1]
    items = [(1, a), (2, "ONE, two... three!"), (3, "three"), (4, None), (5, "!!!"), (10, a), (10, a), (6, "absent words that are nowhere to be found in any of the texts at all here"), (7, "one two"), (None, "漢字"), (8, "aa ab aa ab aa ab aa ab aa ab aa ab aa ab aa")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame([(500, "aa ab " * 30), (501, "x " + a + " y " + a[30:]), (502, "one two one two three one")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    got = decontaminate.hits(clashing(df), bench, "doc_id", pack=pack)
    assert sets(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_hits(texts_of(df), items)


def test_packs_are_files_that_one_stage_loads_in_turn(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 2_000)
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(50)], "item_id long, text string")
    root, names = decontaminate.pattern_packs(bench, pack=8)
    assert len(names) > 20
    rows = [(i, f"before w{i}x3 " + " ".join(f"w{i}x{j}" for j in range(4, 17)) + " after") for i in range(50)]
    got = decontaminate.hits(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")), bench, "doc_id", pack=8)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert got.where("n_hit = 14 and contaminated").count() == 50


def test_decontamination_of_the_tables(spark, real, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontaminate.hits(real, bench, "doc_id")
    want = brute_hits(texts_of(real), [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert sets(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    kept = decontaminate.decontaminated(clashing(real), bench)
    assert kept.count() == sum(n for x, n in want.items() if not x[2]) and kept.columns == clashing(real).columns


# Empty tables


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    index, root = warc.archived(pages)
    for df in (simhash.near_duplicates(empty), simhash.deduplicated(empty), suffix.without_repeats(empty), sharding.histogram_sharded(empty), lines.line_report(empty), lines.without_duplicate_lines(empty), warc.read_records(index, root), mixing.taken(empty), mixing.mixture(empty), hmm.scored(empty), tokens.tokenized(empty, catalog.tokenizer_path()), quality.ledger(empty), quality.accepted(empty), decontaminate.hits(empty, bench, "doc_id"), decontaminate.decontaminated(empty, bench)):
        assert df.count() == 0


def test_an_empty_benchmark_hits_nothing(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert sets(decontaminate.hits(docs, bench, "doc_id"), "contaminated") == Counter({(False,): docs.count()})
