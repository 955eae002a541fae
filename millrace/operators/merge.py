"""Merging, ordering and truncating entries of several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.dedup import DedupOptions, deduplicated
from millrace.operators.rules import Rule, filtered
from millrace.schema import as_entries, entry_date


def merged(*sources: DataFrame, names: list[str] | None = None) -> DataFrame:
    """UNION ALL in source order: seq orders by source, then by the source's own seq (below 2^52, 2048 parts at most).

    A configured name replaces the source's title where it is not empty.
    """
    if len(sources) > 2048:
        raise ValueError("merge at most 2048 parts at once")
    parts = []
    for i, df in enumerate(map(as_entries, sources)):
        name = F.nullif(F.lit((names or [""] * len(sources))[i]), F.lit(""))
        parts.append(df.withColumns({"source_title": F.coalesce(name, "source_title"), "seq": F.lit(i).cast("long") * (1 << 52) + F.col("seq")}))
    return reduce(DataFrame.unionByName, parts)


def newest_first() -> list[Column]:
    return [entry_date().desc_nulls_last(), F.col("seq").asc()]


def sorted_by_date(entries: DataFrame, limit: int = 0) -> DataFrame:
    """Newest first, undated last, stable; a limit needs no full sort."""
    out = entries.orderBy(*newest_first())
    return out.limit(limit) if limit > 0 else out


def refreshed(entries: DataFrame, options: DedupOptions = DedupOptions(), rules: str | list[Rule] = (), max_items: int = 200, markup: bool = True) -> DataFrame:
    """One refresh: resolve, filter (after, since a filled field can change a match), sort, truncate."""
    return sorted_by_date(filtered(deduplicated(entries, options, markup), rules or []), max_items)


def newest_date(entries: DataFrame) -> DataFrame:
    return entries.agg(F.max(entry_date()).alias("newest"))
