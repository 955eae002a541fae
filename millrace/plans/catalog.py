"""Registered queries of the engine, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.dates import parsed_date
from millrace.functions.urls import normalized_url
from millrace.operators import dedup, health, merge, rules, search, store
from millrace.plans.shared import written
from millrace.schema import documents_as_entries, pages_as_entries
from millrace.sources import opml

SNIPPETS = ("shonre +est", 20)
BM25 = {"bm25_terms": ("the shonre onthsh", 50), "bm25_required_excluded": ("tion +est -zue", 50), "bm25_phrase": ('"in est" tion', 50), "saved_search_feed": ("ciónñ +que", 20)}
RULES = """
# German, or a long word in the title, but nothing from source 3 or shouting
include category =~ /^DE$/i
include title ~ [a-z]{12,}
exclude source ~ ^src3\\b
exclude title =~ /^[A-Z ]+$/
"""
#: Seconds after which stored entries go, in the retention query.
RETENTION = "2024-01-29 20:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return documents_as_entries(table(spark, sf_dir, "documents"))


def index(spark, sf_dir):
    return search.indexed(documents(spark, sf_dir), markup=False)


def tokenize_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def index_stats(spark, sf_dir):
    return search.index_stats(index(spark, sf_dir)).select("n_docs", "n_terms", F.round("avg_len", 6).alias("avg_len"))


def postings_topdf(spark, sf_dir):
    found = search.postings(index(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return found.orderBy(F.col("df").desc(), "term").limit(100)


def bm25(name):
    def run(spark, sf_dir):
        query, limit = BM25[name]
        out = search.search(index(spark, sf_dir), query, limit)
        return out.select("id", F.round("score", 6).alias("score"), F.array_join("matched", "|").alias("matched"))

    run.__name__ = name
    return run


def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalized_url(F.col("url")).alias("url"))


def dedup_by_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", normalized_url(F.col("url")).alias("url"))
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def titles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.normalized_title(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


def _pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """One row per row: its class of equal sets and the similar classes; no pairs of copies are formed."""
    rows = written(dedup.classes(sets), "classes")
    found = dedup.similar_pairs(dedup.representatives(sets, rows), threshold)
    ends = found.select(F.col("a").alias("class_id"), F.col("b").alias("other"), "similarity").union(found.select("b", "a", "similarity"))
    per = ends.groupBy("class_id").agg(F.count("*").alias("n_similar"), F.min("other").alias("first_similar"), F.round(F.max("similarity"), 6).alias("best"))
    return rows.join(per, "class_id", "left").select("id", "class_id", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), "first_similar", "best")


def title_pairs(spark, sf_dir):
    words = titles(spark, sf_dir).select(F.col("page_id").alias("id"), F.array_distinct(F.filter(F.split("title", " "), lambda x: x != "")).alias("items"))
    return _pairs(written(words.where(F.size("items") > 0), "titles"), 0.8)


def shingle_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({T.TOKEN})"), F.lit(1))
    sets = docs.select(F.col("doc_id").alias("id"), dedup.shingles(words).alias("items"))
    return _pairs(written(sets, "shingles").where(F.size("items") > 0), 0.8)


def dedup_exact_text(spark, sf_dir):
    out = dedup.exact(documents(spark, sf_dir), "content")
    return out.select("id", "title", "source_title", "seq")


def dedup_full(spark, sf_dir):
    out = dedup.deduplicated(pages_as_entries(table(spark, sf_dir, "pages")), dedup.DedupOptions(0.9, 259_200, 0.8))
    return out.select("id", "link", "title", "seq")


def dedup_documents(spark, sf_dir):
    out = dedup.deduplicated(documents(spark, sf_dir), dedup.DedupOptions(0.9, 259_200, 0.8), markup=False)
    return out.select("id", "title", "source_title", "seq")


def filter_rules(spark, sf_dir):
    return rules.filtered(documents(spark, sf_dir), RULES).select("id", "title", "source_title")


def merge_sorted_topn(spark, sf_dir):
    both = merge.merged(documents(spark, sf_dir), pages_as_entries(table(spark, sf_dir, "pages")), names=["", "crawl"])
    return merge.sorted_by_date(both, 200).select("id", "title", "source_title", F.unix_timestamp("published").alias("published_s"))


def plain_text(spark, sf_dir):
    out = T.plain_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", out.alias("text")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def summaries(spark, sf_dir):
    entries = pages_as_entries(table(spark, sf_dir, "pages"))
    return entries.select("id", T.extracted(F.col("content"), F.col("summary")).alias("x")).select("id", "x.summary", F.col("x.words").alias("words"), "x.reading_minutes")


def snippets(spark, sf_dir):
    return search.hits(documents(spark, sf_dir), *SNIPPETS, markup=False).select("id", F.round("score", 6).alias("score"), "snippet")


def word_reading_stats(spark, sf_dir):
    words = T.count_words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), T.reading_minutes(words).alias("minutes"))


def fetch_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok, same = F.col("event_type") != "error", F.col("event_type") == "view"
    return e.select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("url"), F.concat(F.lit("user "), F.col("user_id")).alias("name"), ok.alias("ok"), same.alias("not_modified"), F.when(~ok, 502).when(same, 304).otherwise(200).alias("status"),
        F.when(ok, F.length("event_type")).otherwise(0).alias("entries"), F.when(ok, "").otherwise("HTTP 502").alias("error"), F.floor("value").cast("long").alias("duration_ms"), "ts", F.col("event_id").alias("pos"),
    )


def source_health(spark, sf_dir):
    h = health.source_health(fetch_log(spark, sf_dir))
    return h.select(*[c for c in h.columns if not c.startswith("last_success") and not c.startswith("last_failure")], F.unix_timestamp("last_success").alias("last_success_s"), F.unix_timestamp("last_failure").alias("last_failure_s"))


def degraded_sources(spark, sf_dir):
    return health.degraded(health.source_health(fetch_log(spark, sf_dir)))


def event_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), (F.col("event_type") == "error").alias("del"), F.col("event_type").alias("title"), F.col("ts").alias("stored_at"), F.col("event_id").alias("pos"))


def store_replay(spark, sf_dir):
    return store.live(event_log(spark, sf_dir)).select("id", "title", F.unix_timestamp("stored_at").alias("stored_s"), "pos")


def store_retention(spark, sf_dir):
    return store.purged(event_log(spark, sf_dir), F.lit(RETENTION).cast("timestamp")).select("id", "v", "del")


def store_put(spark, sf_dir):
    new = documents(spark, sf_dir)
    return store.absent(event_log(spark, sf_dir), new, F.lit(RETENTION).cast("timestamp")).select("id", "title", "seq")


def store_stats(spark, sf_dir):
    return store.stats(event_log(spark, sf_dir))


def entry_ids(spark, sf_dir):
    d = documents(spark, sf_dir)
    raw = F.col("seq").cast("string")
    key = T.entry_id(F.when(F.col("seq") % 3 == 0, F.col("id")).otherwise(""), F.when(F.col("seq") % 3 == 1, F.concat(F.lit("https://d.example/"), "id")).otherwise(""), F.coalesce("title", F.lit("")), raw)
    return d.select("seq", key.alias("entry_id"))


def date_parse(spark, sf_dir):
    """Event times rendered in eight shapes, by the event's number, and read back."""
    shown = lambda pattern, hours=0: F.date_format(F.col("ts") + F.expr(f"make_dt_interval(0, {hours})"), pattern)
    shapes = (
        F.concat(shown("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")), F.concat(shown("yyyy-MM-dd'T'HH:mm:ss", 2), F.lit("+02:00")), shown("MMMM d, yyyy"), shown("MM/dd/yyyy HH:mm:ss"),
        F.concat(shown("dd MMM yy HH:mm", -5), F.lit(" EST")), shown("EEE MMM d HH:mm:ss yyyy"), F.concat(shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25Z")), F.concat(F.lit("about "), shown("HH:mm")),
    )
    raw = F.coalesce(*(F.when(F.col("event_id") % 8 == i, x) for i, x in enumerate(shapes)))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", "raw", F.date_format(parsed_date(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def folder_rollup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    feeds = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("folder"), F.col("n_name").alias("name"), F.concat(F.lit("https://feeds.example/"), F.col("n_nationkey")).alias("url"), F.lit("").alias("site_url"), F.col("n_nationkey").cast("long").alias("pos"))
    return opml.folders(feeds).select("folder", F.size("feeds").cast("long").alias("n_feeds"), F.array_join(F.transform("feeds", lambda x: x["name"]), ",").alias("names"))


def flagship(spark, sf_dir):
    return bm25("bm25_terms")(spark, sf_dir)


PLAIN = (tokenize_terms, index_stats, postings_topdf, *(bm25(n) for n in BM25), normalize_url, dedup_by_url, title_pairs, shingle_pairs, dedup_exact_text, dedup_full, dedup_documents, filter_rules, merge_sorted_topn, plain_text, summaries, snippets, word_reading_stats, source_health, degraded_sources, store_replay, store_retention, store_put, store_stats, entry_ids, date_parse, folder_rollup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in PLAIN} | {"normalize_title": titles}


STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
TOKENS = lambda c: rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{Nd}}]+'), lambda x: x NOT IN {STOP})"
INDEX = rf"""
WITH e AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(text, '') AS body, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents),
f AS (SELECT doc_id, {TOKENS("title")} AS title, {TOKENS("body")} AS body, {TOKENS("source")} AS source, {TOKENS("lang")} AS lang FROM e),
o AS (SELECT doc_id, unnest(title) AS term, 3.0::DOUBLE AS w FROM f UNION ALL SELECT doc_id, unnest(lang), 2.0 FROM f UNION ALL SELECT doc_id, unnest(source), 1.0 FROM f UNION ALL SELECT doc_id, unnest(body), 1.0 FROM f),
p AS (SELECT doc_id, term, sum(w) AS tf FROM o GROUP BY 1, 2),
l AS (SELECT f.doc_id, coalesce(sum(p.tf), 0) AS len FROM f LEFT JOIN p USING (doc_id) GROUP BY 1),
s AS (SELECT count(*) AS n, CASE WHEN avg(len) = 0 THEN 1 ELSE avg(len) END AS avg_len FROM l)
"""


def _snippets_sql() -> str:
    """A window of 200 characters, a third of it before the first hit of a matched term, cut at words."""
    return f"""WITH hits AS ({_bm25_sql(*SNIPPETS)}),
f AS (SELECT id, score, regexp_replace(trim(text), '\\s+', ' ', 'g') AS flat, string_split(h.matched, '|') AS terms FROM hits h JOIN documents d ON CAST(d.doc_id AS VARCHAR) = h.id),
p AS (SELECT *, coalesce(list_min(list_filter(list_transform(terms, lambda m: strpos(lower(flat), m) - 1), lambda i: i >= 0)), 0) AS hit FROM f),
w AS (SELECT *, greatest(0, least(hit - 66, length(flat) - 200)) AS start FROM p),
a AS (SELECT *, substr(flat, CAST(start + 1 AS BIGINT), 200) AS part FROM w),
b AS (SELECT *, CASE WHEN start > 0 AND contains(part, ' ') THEN substr(part, strpos(part, ' ') + 1) ELSE part END AS part2 FROM a),
c AS (SELECT *, CASE WHEN start + 200 < length(flat) AND contains(part2, ' ') THEN regexp_replace(part2, ' [^ ]*$', '') ELSE part2 END AS part3 FROM b)
SELECT id, score, CASE WHEN length(flat) <= 200 THEN flat ELSE CASE WHEN start > 0 THEN '…' ELSE '' END || part3 || CASE WHEN start + 200 < length(flat) THEN '…' ELSE '' END END AS snippet FROM c"""


def _bm25_sql(text: str, limit: int) -> str:
    q = search.parse_query(text)
    terms = ", ".join(f"({i}, '{t.text}')" for i, t in enumerate(q.terms) if not t.negated)
    has = lambda t: f"EXISTS (SELECT 1 FROM p WHERE p.doc_id = f.doc_id AND p.term = '{t}')"
    phrase = lambda p: f"contains(' ' || array_to_string(list_concat(f.title, f.body), ' ') || ' ', ' {p.text} ')"
    conds = [has(t.text) for t in q.terms if t.required] + [f"NOT {has(t.text)}" for t in q.terms if t.negated] + [("NOT " if p.negated else "") + phrase(p) for p in q.phrases]
    wanted = [p for p in q.phrases if not p.negated]
    bonus = "".join(f" UNION ALL SELECT f.doc_id, '{p.text}', {len(p.terms)}::DOUBLE FROM f WHERE {phrase(p)}" for p in wanted)
    return f"""{INDEX},
q(i, term) AS (VALUES {terms}), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
h AS (SELECT p.doc_id, p.term, ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.len / s.avg_len)) AS v
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (doc_id), s{bonus}),
r AS (SELECT h.doc_id, sum(v) AS score, array_to_string(list_sort(list_distinct(list(term))), '|') AS matched FROM h GROUP BY 1)
SELECT CAST(r.doc_id AS VARCHAR) AS id, round(score, 6) AS score, matched FROM r JOIN f USING (doc_id) WHERE {" AND ".join(conds or ["true"])}
ORDER BY r.score DESC, r.doc_id DESC, id LIMIT {limit}"""


URLS = r"""
u AS (SELECT page_id, trim(coalesce(url, '')) AS raw FROM pages),
a AS (SELECT page_id, raw, lower(split_part(raw, '://', 1)) AS scheme, split_part(substr(raw, strpos(raw, '://') + 3), '#', 1) AS rest FROM u WHERE contains(raw, '://')),
b AS (SELECT page_id, CASE scheme WHEN 'http' THEN 'https' ELSE scheme END AS scheme, split_part(rest, '?', 1) AS body, CASE WHEN contains(rest, '?') THEN substr(rest, strpos(rest, '?') + 1) ELSE '' END AS query FROM a),
c AS (SELECT page_id, scheme, query, lower(split_part(body, '/', 1)) AS host, CASE WHEN contains(body, '/') THEN substr(body, strpos(body, '/')) ELSE '' END AS path FROM b),
p AS (SELECT page_id, i, x[1] AS k, array_to_string(x[2:], '=') AS v FROM (SELECT page_id, i, string_split(list_extract(string_split(query, '&'), i), '=') AS x FROM c, range(1, 30) t(i) WHERE i <= len(string_split(query, '&'))) WHERE array_to_string(x, '=') <> ''),
q AS (SELECT page_id, string_agg(replace(url_encode(url_decode(replace(k, '+', ' '))), '%20', '+') || '=' || replace(url_encode(url_decode(replace(v, '+', ' '))), '%20', '+'), '&' ORDER BY k, i) AS query
  FROM p WHERE lower(k) NOT LIKE 'utm\_%' ESCAPE '\' AND lower(k) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'source', 'cmpid', 'at_medium', 'at_campaign') GROUP BY 1),
d AS (SELECT c.page_id, scheme, CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END AS h, CASE WHEN ends_with(path, '/') THEN substr(path, 1, length(path) - 1) ELSE path END AS path, coalesce(q.query, '') AS query FROM c LEFT JOIN q USING (page_id)),
n AS (SELECT page_id, scheme || '://' || regexp_replace(h, ':(443|80)$', '') || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url FROM d UNION ALL SELECT page_id, lower(raw) FROM u WHERE NOT contains(raw, '://'))
"""
DATES = """
WITH e AS (SELECT event_id, ts, event_id % 8 AS shape FROM events)
SELECT event_id, CASE shape WHEN 0 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') WHEN 1 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 2 THEN strftime(ts, '%B %-d, %Y') WHEN 3 THEN strftime(ts, '%m/%d/%Y %H:%M:%S')
  WHEN 4 THEN strftime(ts - INTERVAL 5 HOUR, '%d %b %y %H:%M EST') WHEN 5 THEN strftime(ts, '%a %b %-d %H:%M:%S %Y') WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.25Z') ELSE strftime(ts, 'about %H:%M') END AS raw,
  CASE shape WHEN 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 7 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS utc FROM e
"""
#: Elements that go with their contents, that part paragraphs and that part lines, as far as pages hold them.
PLAIN_TEXT = r"""
x AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<![^>]*>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<nav\b[^>]*>.*?</nav>|<footer\b[^>]*>.*?</footer>', '', 'g') AS s FROM pages),
y AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(s, '</?(p|div|article|h[1-6])\b[^>]*>', chr(2), 'g'), '</?(br|ul|li)\b[^>]*>', chr(1), 'g'), '</?[A-Za-z][^>]*>', '', 'g') AS s FROM x),
z AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(s, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g') AS s FROM y),
t AS (SELECT page_id, trim(regexp_replace(regexp_replace(s, '[ \x01]*\x02[ \x01\x02]*', chr(10) || chr(10), 'g'), ' *\x01[ \x01]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM z)
"""
SUMMARIES = rf"""
WITH {PLAIN_TEXT},
f AS (SELECT page_id, text, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM t),
c AS (SELECT *, substr(flat, 1, 280) AS cut FROM f),
e AS (SELECT *, regexp_extract(cut, '^(.*(?:[!?]|[^0-9]\.))(?: .*)?$', 1) AS sentence, regexp_extract(cut, '^(.*) [^ ]*$', 1) AS head FROM c)
SELECT 'page-' || page_id AS id, CASE WHEN length(flat) <= 280 THEN flat WHEN octet_length(encode(sentence)) - 1 >= 70 THEN sentence ELSE rtrim(CASE WHEN head = '' THEN cut ELSE head END, ',;: ') || '…' END AS summary,
  CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words, CAST(ceil(len(regexp_extract_all(text, '\S+')) / 200) AS BIGINT) AS reading_minutes FROM e
"""
TITLES = r"""
t AS (SELECT page_id, trim(regexp_replace(lower(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'),
  '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&')), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS title FROM pages)
"""


def _pairs_sql(sets: str, threshold: float) -> str:
    """All pairs of distinct sets that share an item."""
    return f"""{sets},
c AS (SELECT id, items, min(id) OVER (PARTITION BY list_sort(items)) AS class_id FROM sets WHERE len(items) > 0),
x AS (SELECT id, len(items) AS n, unnest(items) AS item FROM c WHERE id = class_id),
k AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM x a JOIN x b ON a.item = b.item AND a.id <> b.id GROUP BY 1, 2),
s AS (SELECT a, b, k / (n + m - k) AS similarity FROM k WHERE k / (n + m - k) >= {threshold}),
g AS (SELECT a, count(*) AS n_similar, min(b) AS first_similar, round(max(similarity), 6) AS best FROM s GROUP BY 1)
SELECT id, class_id, CAST(coalesce(n_similar, 0) AS BIGINT) AS n_similar, first_similar, best FROM c LEFT JOIN g ON c.class_id = g.a"""


LOG = """
WITH log AS (SELECT 'user-' || user_id AS url, 'user ' || user_id AS name, event_type <> 'error' AS ok, event_type = 'view' AS same, CASE event_type WHEN 'error' THEN 502 WHEN 'view' THEN 304 ELSE 200 END AS status,
  CASE WHEN event_type <> 'error' THEN length(event_type) ELSE 0 END AS entries, CAST(floor(value) AS BIGINT) AS ms, ts, event_id AS pos FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, pos) AS rn FROM log),
o AS (SELECT url, max(rn) FILTER (ok) AS last_ok FROM r GROUP BY 1),
h AS (SELECT url, arg_max(name, rn) AS name, count(*) AS fetches, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, count(*) FILTER (same) AS not_modified,
  count(*) FILTER (NOT ok AND (last_ok IS NULL OR rn > last_ok)) AS consecutive_failures, arg_max(status, rn) AS last_status, arg_max(ms, rn) AS last_duration_ms, CAST(sum(ms) // count(*) AS BIGINT) AS avg_duration_ms,
  floor(count(*) FILTER (ok) / count(*) * 10000 + 0.5) / 10000 AS success_rate, CAST(coalesce(arg_max(entries, rn) FILTER (ok), 0) AS INTEGER) AS entries, CASE WHEN arg_max(ok, rn) THEN '' ELSE 'HTTP 502' END AS last_error,
  CAST(floor(epoch(max(ts) FILTER (ok))) AS BIGINT) AS last_success_s, CAST(floor(epoch(max(ts) FILTER (NOT ok))) AS BIGINT) AS last_failure_s FROM r JOIN o USING (url) GROUP BY 1)
"""
STORE = """
WITH log AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type = 'error' AS gone, event_type AS title, ts, event_id AS pos FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS rn FROM log) WHERE rn = 1)
"""


def oracle_sql() -> dict[str, str]:
    docs = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
    title = "string_split(text, chr(10))[1]"
    return {
        "tokenize_terms": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM (SELECT doc_id, {TOKENS('text')} AS t FROM ({docs}))",
        "index_stats": f"{INDEX} SELECT n AS n_docs, (SELECT count(DISTINCT term) FROM p) AS n_terms, round(avg_len, 6) AS avg_len FROM s",
        "postings_topdf": f"{INDEX} SELECT term, count(*) AS df, sum(tf) AS tf FROM p GROUP BY 1 ORDER BY df DESC, term LIMIT 100",
        **{n: _bm25_sql(*x) for n, x in BM25.items()},
        "plain_text": f"WITH {PLAIN_TEXT} SELECT page_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS sha256 FROM t",
        "summaries": SUMMARIES,
        "snippets": _snippets_sql(),
        "normalize_url": f"WITH {URLS} SELECT page_id, url FROM n",
        "dedup_by_url": f"WITH {URLS} SELECT url, min(page_id) AS page_id, count(*) AS n FROM n GROUP BY 1",
        "normalize_title": f"WITH {TITLES} SELECT page_id, title FROM t",
        "title_pairs": _pairs_sql(f"WITH {TITLES}, sets AS (SELECT page_id AS id, list_distinct(list_filter(string_split(title, ' '), lambda x: x <> '')) AS items FROM t)", 0.8),
        "shingle_pairs": _pairs_sql(
            rf"WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{Nd}}]+') AS w FROM documents), "
            "sets AS (SELECT id, list_distinct(list_transform(range(1, greatest(2, CAST(len(w) AS BIGINT) - 2)), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS items FROM w WHERE len(w) > 0)",
            0.8,
        ),
        "dedup_exact_text": f"SELECT CAST(doc_id AS VARCHAR) AS id, {title} AS title, source AS source_title, doc_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
        "filter_rules": f"SELECT CAST(doc_id AS VARCHAR) AS id, title, source AS source_title FROM (SELECT *, {title} AS title FROM documents) WHERE (regexp_matches(lang, '(?i)^DE$') OR regexp_matches(title, '[a-z]{{12,}}')) AND NOT regexp_matches(source || ' ', '^src3\\b') AND NOT regexp_matches(title, '^[A-Z ]+$')",
        "merge_sorted_topn": f"SELECT id, title, source_title, published_s FROM (SELECT CAST(doc_id AS VARCHAR) AS id, {title} AS title, source AS source_title, 1704067200 + 60 * doc_id AS published_s, 0 AS s, doc_id AS seq FROM documents UNION ALL SELECT 'page-' || page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1), 'crawl', NULL, 1, page_id FROM pages) ORDER BY published_s DESC NULLS LAST, s, seq LIMIT 200",
        "word_reading_stats": rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words, CAST(ceil(len(regexp_extract_all(text, '\S+')) / 200) AS BIGINT) AS minutes FROM ({docs})",
        "source_health": f"{LOG} SELECT * FROM h",
        "degraded_sources": f"{LOG} SELECT count(*) FILTER (consecutive_failures > 0) AS degraded, count(*) AS sources FROM h",
        "store_replay": f"{STORE} SELECT id, title, CAST(floor(epoch(ts)) AS BIGINT) AS stored_s, pos FROM last WHERE NOT gone",
        "store_retention": f"{STORE} SELECT id, 1 AS v, true AS del FROM last WHERE NOT gone AND ts < TIMESTAMP '{RETENTION}'",
        "store_put": f"{STORE} SELECT CAST(doc_id AS VARCHAR) AS id, {title} AS title, doc_id AS seq FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT id FROM last WHERE NOT gone)",
        "store_stats": f"{STORE} SELECT (SELECT count(*) FROM last WHERE NOT gone) AS live, count(*) AS records, count(*) - (SELECT count(*) FROM last WHERE NOT gone) AS garbage FROM log",
        "entry_ids": f"SELECT doc_id AS seq, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN 'https://d.example/' || doc_id ELSE 'urn:entry:' || substr(sha256({title} || chr(0) || doc_id), 1, 32) END AS entry_id FROM ({docs})",
        "date_parse": DATES,
        "folder_rollup": "SELECT r_name AS folder, count(*) AS n_feeds, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    }
