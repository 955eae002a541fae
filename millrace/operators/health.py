"""Per-source health from a fetch log, as one aggregation without self joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round4(x: Column) -> Column:
    """To four places, halves up, for numbers that are not negative."""
    return F.floor(x * 10000 + 0.5) / 10000


def source_health(log: DataFrame, order: tuple[str, ...] = ("ts", "pos")) -> DataFrame:
    """One row a url of ``log(url, name, ok, not_modified, status, entries, error, duration_ms, ts, ...)``.

    The streak of failures counts those after the last success: the maxima of a partial aggregate
    by time give every last value, and failures are counted per time in the same pass.
    """
    at = F.struct(*order)
    last = lambda c, cond=None: F.max_by(F.when(cond, F.col(c)) if cond is not None else F.col(c), F.when(cond, at) if cond is not None else at)
    ok = F.col("ok")
    last_ok = log.where(ok).groupBy("url").agg(F.max(at).alias("last_ok"))
    joined = log.join(last_ok, "url", "left")
    out = joined.groupBy("url").agg(
        last("name", F.coalesce(F.col("name"), F.lit("")) != "").alias("name"),
        F.count("*").alias("fetches"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.count_if(ok & F.col("not_modified")).alias("not_modified"),
        F.count_if(~ok & (F.col("last_ok").isNull() | (at > F.col("last_ok")))).alias("consecutive_failures"),
        last("status").alias("last_status"), last("duration_ms").alias("last_duration_ms"), F.sum("duration_ms").alias("total_ms"),
        last("entries", ok).alias("entries"), F.max(F.when(ok, F.col("ts"))).alias("last_success"), F.max(F.when(~ok, F.col("ts"))).alias("last_failure"),
        last("error").alias("error"), last("ok").alias("ended_ok"),
    )
    return out.select(
        "url", "name", "fetches", "successes", "failures", "not_modified", "consecutive_failures", "last_status", "last_duration_ms",
        F.floor(F.col("total_ms") / F.col("fetches")).cast("long").alias("avg_duration_ms"), round4(F.col("successes") / F.col("fetches")).alias("success_rate"),
        F.coalesce("entries", F.lit(0)).alias("entries"), "last_success", "last_failure", F.when(F.col("ended_ok"), "").otherwise(F.col("error")).alias("last_error"),
    )


def degraded(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if(F.col("consecutive_failures") > 0).alias("degraded"), F.count("*").alias("sources"))


def status(snapshot_exists: bool, failed: int, sources: int) -> tuple[str, int]:
    """The health endpoint's word and code."""
    if not snapshot_exists:
        return ("error" if failed and failed == sources else "starting"), 503
    return ("degraded" if failed else "ok"), 200
