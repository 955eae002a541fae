"""The pipeline against a plain version of its stages, and the registered SQL against DuckDB."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import catalog, quality
from millrace.llm._common import written

from .fixtures import SCHEMA, clashing, documents
from .test_operators import brute_components, brute_hits, brute_measures, texts_of, whole_ids


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf_dir), name.replace(" ", "-")))
    assert all(x.columns == docs.columns for x in seen[:-1])
    rows = [texts_of(x) for x in seen[:-1]]
    judged = {d: (m := brute_measures(t)) and not (m[0] < 20 or 100 * m[4] > 30 * m[0] or 10 * m[2] > m[0]) for d, t in rows[0]}
    assert {d for d, _ in rows[1]} <= {d for d, ok in judged.items() if ok} and len(rows[1]) >= 0.5 * len(rows[0])
    assert sorted(d for d, _ in rows[2]) == sorted({c for _, _, c in brute_components(rows[1])})
    dirty = {x[0] for x in brute_hits(rows[2], bench) if x[2]}
    assert sorted(d for d, _ in rows[3]) == sorted({d for d, _ in rows[2]} - dirty)
    assert {d for d, _ in rows[4]} <= {d for d, _ in rows[3]} and len(rows[4]) >= len(rows[3]) and max(Counter(d for d, _ in rows[4]).values()) <= 2
    ids = whole_ids([t for _, t in rows[4]])
    assert sorted((r["doc_id"], r["n_tokens"]) for r in seen[-1].collect()) == sorted((d, len(i)) for (d, _), i in zip(rows[4], ids, strict=True))
    assert corpus_pipeline.run(spark, sf_dir).count() == len(ids)


def test_stages_take_awkward_rows(spark, sf_dir):
    docs = clashing(spark.createDataFrame(documents(), SCHEMA))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.format("noop").mode("overwrite").save()
        stage(spark, docs.limit(0), sf_dir).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    with duckdb.connect() as con:
        for t in ("documents", "pages", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.sql(catalog.oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    good = docs.join(labels, "doc_id", "left_semi")
    assert quality.accepted(good).count() >= 0.95 * good.count()
