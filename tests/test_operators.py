"""Search, rules, resolution, health and the store."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, health, merge, rules, search, store
from millrace.schema import ENTRY


def entry(seq, **k):
    return tuple({**dict.fromkeys(f.name for f in ENTRY.fields), "id_source": "guid", "seq": seq, **k}[f.name] for f in ENTRY.fields)


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def doc(seq, key, title, body, day, author=None, cats="", source=None):
    return entry(seq, id=key, title=title, content=f"<p>{body}</p>", published=datetime(2026, 7, day), author=author, categories=cats.split(), source_title=source)


# Words, required words, excluded words, phrases and excluded phrases of each query.
QUERIES = [
    ("yeast", "yeast", "", "", [], []), ("oven salt", "oven salt", "", "", [], []), ('"cast iron pan"', "", "", "", ["cast iron pan"], []), ('"iron cast pan"', "", "", "", ["iron cast pan"], []), ("yeast -starter", "yeast", "", "starter", [], []),
    ("oven +pan", "oven pan", "pan", "", [], []), ('yeast -"starter jar"', "yeast", "", "", [], ["starter jar"]), ("mehta", "mehta", "", "", [], []), ("pickles salt salt", "pickles salt salt", "", "", [], []), ("gazette", "gazette", "", "", [], []), ("sushi", "sushi", "", "", [], []),
    ("by the with", "", "", "", [], []), ("-yeast", "", "", "yeast", [], []), ("+vinegar salt", "vinegar salt", "vinegar", "", [], []), ('bread "hot oven"', "bread", "", "", ["hot oven"], []), ("omar", "omar", "", "", [], []),
]
DOCS = [
    ("w", "White bread for beginners", "Flour, yeast, salt and a hot oven are all that white bread asks for.", 11, "Lena Frost", "bread oven", "Crumb Letter"),
    ("t", "Searing without smoke", "Heat a cast iron pan in the oven first, then add salt.", 12, "Omar Diaz", "meat", "Pan Notes"),
    ("s", "Keep your sourdough alive", "Feed the starter jar daily; wild yeast does the rest.", 13, "Priya Mehta", "bread", "Crumb Letter"),
    ("v", "Quick pickles", "Vinegar, sugar and salt turn any cucumber into pickles overnight. Salt again.", 14, "Omar Diaz", "jars", "Cellar Gazette"),
]


def ranking(words, required, excluded, phrases, against):
    """BM25 with k1 1.2 and b 0.75 over weighted fields, phrases as bonuses, ties by date."""
    import math
    from collections import Counter

    from millrace.functions.text import tokenize

    tf = {k: Counter() for k, *_ in DOCS}
    text, day = {}, {}
    for k, title, body, d, author, cats, source in DOCS:
        for part, weight in ((title, 3), (cats, 2), (author, 1.5), (source, 1), (body, 1)):
            for w in tokenize(part):
                tf[k][w] += weight
        text[k], day[k] = " " + " ".join(tokenize(title) + tokenize(body)) + " ", d
    mean = sum(x.total() for x in tf.values()) / len(tf)
    score = Counter()
    for w in words.split():
        n = sum(w in x for x in tf.values())
        for k, x in tf.items():
            if x[w]:
                score[k] += math.log(1 + (len(tf) - n + 0.5) / (n + 0.5)) * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * x.total() / mean))
    for p in phrases:
        for k in tf:
            if f" {p} " in text[k]:
                score[k] += len(p.split())
    ok = [k for k in score if all(tf[k][w] for w in required.split()) and not any(tf[k][w] for w in excluded.split()) and all(f" {p} " in text[k] for p in phrases) and not any(f" {p} " in text[k] for p in against)]
    return sorted(ok, key=lambda k: (-score[k], -day[k], k))


@pytest.fixture(scope="module")
def corpus(spark):
    return entries(spark, *(doc(i, *x) for i, x in enumerate(DOCS)))


@pytest.mark.parametrize("limit", [0, 1])
def test_ranking(corpus, limit):
    index = search.indexed(corpus).cache()
    for query, *parts in QUERIES[: 4 if limit else None]:
        got = [r["id"] for r in search.search(index, query, limit).collect()]
        assert got == ranking(*parts)[: limit or None], query


def test_hits_carry_snippets(corpus):
    rows = search.hits(corpus, "oven").collect()
    assert sorted(r["id"] for r in rows) == ["t", "w"] and "oven" in rows[0]["snippet"] and rows[0]["matched"] == ["oven"]


def test_query_text():
    assert str(search.parse_query('soup +hot -cold "the bread of today" -"x y z"')) == 'soup +hot -cold "bread today" -"x y z"'
    assert str(search.parse_query('"left open for good')) == '"left open good"'


ROWS = [dict(id="1", title="Go 1.22 released", author="Ann", categories=["go", "release"], source_title="The Blog"), dict(id="2", title="Sponsored: buy now", content="ad text", source_url="https://ads.example"), dict(id="3", title="Rust news\nSecond line", summary="about go")]


@pytest.mark.parametrize(
    "text, want",
    [("", "123"), ("include title ~ Go", "1"), ("include any =~ /GO/i", "13"), ("exclude title ~ ^Sponsored", "13"), ("exclude title !~ e", "123"), ("include category ~ release\nexclude author ~ Ann", ""), ("# comment\n\nInclude Title ~ news$", ""), ("include title ~ line$", "3"), ("include title =~ /news.second/is", "3"), ("include source ~ ads", "2"), ("include title ~ \\bnow\\b", "2"), ("include title ~ [[:digit:]]", "1")],
)
def test_rules(spark, text, want):
    df = entries(spark, *(entry(i, **r) for i, r in enumerate(ROWS)))
    assert "".join(r["id"] for r in rules.filtered(df, text).orderBy("seq").collect()) == want


@pytest.mark.parametrize("text", ["keep title ~ x", "include nothing ~ x", "include title = x", "include title ~ /x", "include title ~ //", "include title ~ (", "include title", "include title ~ /x/q", "include title ~ (?=x)", r"include title ~ (a)\1"])
def test_bad_rules(text):
    with pytest.raises(rules.RuleError, match="line 2"):
        rules.parse_rules("# first\n" + text)


def brute_fold(rows, options):
    from millrace.functions.text import content_words, normalize_title, set_similarity, shingle_set

    url = {"": "", None: ""}
    for r in rows:
        url[r["link"]] = (r["link"] or "").rstrip("/")
    kept, by_id, by_url = [], {}, {}
    body = lambda e: shingle_set(content_words(e["content"] if (e["content"] or "").strip() else e["summary"] or ""))

    def near(a, b):
        return options.title_window <= 0 or not a["published"] or not b["published"] or abs((a["published"] - b["published"]).total_seconds()) <= options.title_window

    for r in rows:
        e = dict(r)
        at = by_id.get(e["id"]) if e["id"] else None
        at = by_url.get(url[e["link"]]) if at is None and url[e["link"]] else at
        for on, sets in ((options.title_threshold, lambda x: set(normalize_title(x["title"] or "").split())), (options.content_threshold, body)):
            if at is None and on > 0:
                at = next((i for i, k in enumerate(kept) if near(k, e) and sets(e) and set_similarity(sets(k), sets(e)) >= on), None)
        own = (e["id"], url[e["link"]])
        if at is None:
            at = len(kept)
            kept.append(e)
        else:
            k = kept[at]
            for name in ("title", "link", "content", "summary"):
                k[name] = k[name] or e[name]
            k["published"] = k["published"] or e["published"]
            if k["id_source"] == "hash" and e["id_source"] != "hash":
                k["id"], k["id_source"] = e["id"], e["id_source"]
        for i, u in ((kept[at]["id"], url[kept[at]["link"]]), own):
            if i:
                by_id[i] = at
            if u:
                by_url[u] = at
    return [(k["seq"], k["id"], k["title"], k["link"], k["content"]) for k in kept]


@pytest.mark.parametrize("seed", range(4))
def test_dedup_equals_the_sequential_fold(spark, seed):
    rng, rows = random.Random(seed), []
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    for i in range(40):
        pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
        rows.append(dict(seq=i, id=rng.choice(["", f"g{rng.randint(0, 25)}"]), id_source=rng.choice(["hash", "guid"]), title=rng.choice([None, "", pick(rng.randint(1, 5))]), link=rng.choice([None, f"https://x.example/{rng.randint(0, 25)}"]), content=rng.choice([None, " ", pick(7)]), summary=rng.choice([None, pick(7)]), published=rng.choice([None, datetime(2026, 7, 1) + timedelta(hours=rng.randint(0, 200))])))
    options = dedup.DedupOptions(rng.choice([0, 0.8, 1.0]), rng.choice([0, 90_000]), rng.choice([0, 0.6]))
    got = dedup.deduplicated(entries(spark, *(entry(**r) for r in rows)), options)
    key = lambda x: x[0]
    mine = sorted(((r["seq"], r["id"], r["title"], r["link"], r["content"]) for r in got.collect()), key=key)
    assert mine == sorted(brute_fold(rows, options), key=key)


def test_merge_order_and_limit(spark):
    a = entries(spark, entry(0, id="old", published=datetime(2026, 1, 1)), entry(1, id="none"))
    b = entries(spark, entry(0, id="new", published=datetime(2026, 2, 1)), entry(1, id="tie", published=datetime(2026, 1, 1), source_title="x"))
    out = merge.sorted_by_date(merge.merged(a, b, names=["", "B"])).collect()
    assert [r["id"] for r in out] == ["new", "old", "tie", "none"] and out[0]["source_title"] == "B"
    assert [r["id"] for r in merge.sorted_by_date(merge.merged(a, b), 2).collect()] == ["new", "old"]


def test_health_streaks(spark):
    at = lambda i: datetime(2026, 7, 1) + timedelta(minutes=i)
    log = [("u", "n", i in (1,), False, 200 if i == 1 else 500, 3, "" if i == 1 else f"e{i}", 10 * i + 5, at(i), i) for i in range(4)][:3] + [("v", "", True, True, 304, 2, "", 1, at(0), 0)]
    got = {r["url"]: r for r in health.source_health(spark.createDataFrame(log, "url string, name string, ok boolean, not_modified boolean, status int, entries int, error string, duration_ms long, ts timestamp, pos long")).collect()}
    u = got["u"]
    assert (u["fetches"], u["successes"], u["failures"], u["consecutive_failures"], u["avg_duration_ms"], u["success_rate"], u["last_error"], u["entries"]) == (3, 1, 2, 1, 15, 0.3333, "e2", 3)
    assert (got["v"]["not_modified"], got["v"]["consecutive_failures"], got["v"]["last_error"]) == (1, 0, "")
    assert health.status(False, 2, 2) == ("error", 503) and health.status(True, 1, 2) == ("degraded", 200)


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    day = lambda d: F.lit(datetime(2026, 7, d))
    assert s.get("a") is None and s.stats() == {"live": 0, "records": 0, "garbage": 0, "bytes": 0}
    s.put(entries(spark, entry(0, id="a", title="first", published=datetime(2026, 1, 2)), entry(1, id="a", title="second"), entry(2, id=""), entry(3, id="b")), day(1))
    s.put(entries(spark, entry(0, id="a", title="third"), entry(1, id="c", published=datetime(2026, 1, 3))), day(5))
    assert [(r["id"], r["title"], r["stored_at"].day) for r in s.all().collect()] == [("c", None, 5), ("a", "first", 1), ("b", None, 1)]
    assert s.get("a")["title"] == "first" and s.get("zzz") is None
    s.purge_before(day(5))
    assert [r["id"] for r in s.all().collect()] == ["c"] and s.get("a") is None
    assert tuple(store.stats(s.read()).first()) == (1, 5, 4)
    before = s.stats()["bytes"]
    s.compact()
    assert s.stats() | {"bytes": 0} == {"live": 1, "records": 1, "garbage": 0, "bytes": 0} and 0 < s.stats()["bytes"] < before
    assert len(list((tmp_path / "store/parts").iterdir())) == 1
    again = store.Store(spark, f"file://{tmp_path}/store")
    assert [r["id"] for r in again.all().collect()] == ["c"]


def test_puts_write_only_what_is_new(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    for i in range(4):
        s.put(entries(spark, *(entry(j, id=f"k{j}") for j in range(5 * (i + 1)))), F.lit(datetime(2026, 7, 1)))
    sizes = [spark.read.parquet(f"{s.path}/parts/{x}").count() for x in s.parts()]
    assert sizes == [5, 5, 5, 5]
    with pytest.raises(RuntimeError, match="another writer"):
        s._commit(4, [])


def test_log_replay(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    lines = ['{"v":1,"id":"a","title":"x","published":"0001-01-01T00:00:00Z"}', '{"v":1,"id":"b"}', '{"v":1,"id":"b","del":true}', '{"v":1,"id":"a","title":"y"}']
    path.write_text("\n".join([*lines, '{"v":1,"id":"to']))
    assert [(r["id"], r["title"]) for r in store.replayed(spark, f"file://{path}").collect()] == [("a", "y")]
    more = tmp_path / "more.jsonl"
    more.write_text('{"v":1,"id":"b","title":"back"}\n')
    path.write_text("\n".join(lines) + "\n")
    both = store.replayed(spark.newSession(), f"file://{path}", f"file://{more}").collect()
    assert sorted((r["id"], r["title"]) for r in both) == [("a", "y"), ("b", "back")]
    many = tmp_path / "many.jsonl"
    many.write_text("".join('{"v":1,"id":"k%d","title":"%06d"}\n' % (i % 7, i) for i in range(20_000)))
    split = spark.newSession()
    split.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    assert {r["title"] for r in store.replayed(split, f"file://{many}").collect()} == {f"{i:06}" for i in range(19_993, 20_000)}
    path.write_text("\n".join([lines[0], "{broken", lines[1]]))
    with pytest.raises(ValueError, match="damaged"):
        store.replayed(spark, f"file://{path}")
    path.write_text('{"v":2,"id":"a"}\n')
    with pytest.raises(ValueError, match="version"):
        store.replayed(spark, f"file://{path}")
