"""Every registered query runs, and agrees with its SQL in DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from millrace.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if sql := catalog.oracle_sql().get(name):
        with duckdb.connect() as con:
            for p in Path(sf_dir).glob("*.parquet"):
                con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
            want = con.sql(sql)
            assert sorted(df.columns) == sorted(want.columns)
            assert Counter(tuple(r[c] for c in want.columns) for r in rows) == Counter(want.fetchall())


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
