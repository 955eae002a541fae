"""The entry relation and its adapters from tables of documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = ("id", "id_source", "title", "link", "content", "summary", "author")
ENTRY = T.StructType(
    [T.StructField(c, T.StringType()) for c in _STRINGS]
    + [T.StructField("published", T.TimestampType()), T.StructField("updated", T.TimestampType()), T.StructField("published_raw", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType()))]
    + [T.StructField("source_title", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("seq", T.LongType())]
)


def entry_date() -> Column:
    """published, else updated."""
    return F.coalesce("published", "updated")


def as_entries(df: DataFrame) -> DataFrame:
    """Casts and completes a DataFrame to the entry schema; missing columns become null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY.fields))


def documents_as_entries(docs: DataFrame) -> DataFrame:
    start = F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("doc_id"))
    return as_entries(
        docs.select(
            F.col("doc_id").cast("string").alias("id"), F.lit("guid").alias("id_source"), F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("content"), F.col("source").alias("source_title"), F.array("lang").alias("categories"), start.alias("published"), F.col("doc_id").alias("seq"),
        )
    )


def pages_as_entries(pages: DataFrame) -> DataFrame:
    return as_entries(
        pages.select(
            F.concat(F.lit("page-"), F.col("page_id")).alias("id"), F.lit("guid").alias("id_source"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
            F.col("url").alias("link"), F.col("html").alias("content"), F.col("page_id").alias("seq"),
        )
    )
