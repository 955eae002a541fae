"""The registered queries of this subpackage, thin digests of their operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, lines, mixing, quality, sharding, simhash, suffix, tokens, warc
from ._common import table


def tokenizer_path() -> str:
    """The default tokenizer file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    out = sharding.histogram_sharded(docs.withColumn("text_crc32", digest))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, root = warc.archived(table(spark, sf_dir, "pages"), min_payload=0)
    found = warc.read_records(index, root)
    return found.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.scored(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.tokenized(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return book.select("doc_id", *measures, quality.rejected(quality.BASE).alias("base_failed"), (~quality.rejected(quality.V1)).alias("kept"), F.col("failed").alias("failed_bits"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OPERATORS = (op1_simhash_dedup, op2_suffix_dedup, op3_histogram_sharding, op4_line_dedup, op5_warc, op6_source_mixing, op7_hmm_scoring, op8_token_output, op9_quality_rules, op10_decontamination)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform(range(0, 5), lambda b: CAST(substr(bits, CAST(5 * i + b + 1 AS BIGINT), 1) AS BIGINT) * (16 >> CAST(b AS BIGINT)))) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id = m.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = m.top THEN NULL ELSE m.top END AS refers_to
FROM (SELECT *, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p) p JOIN m USING (html)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) AS i FROM d WHERE len(w) >= 8)),
twin AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twin, range(0, 8) t(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
  + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits FROM f
"""

OP10 = r"""
WITH d AS (SELECT doc_id, @words AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, @words AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, CAST(greatest(2, len(w) - 11) AS BIGINT))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
h AS (SELECT doc_id, i, s.m, item FROM (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM s) s JOIN p USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, m FROM h), range(0, 13) t(k) WHERE k < m GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)
""".replace("@words", r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": OP5, "op9_quality_rules": OP9, "op10_decontamination": OP10}
