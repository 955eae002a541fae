"""Refresh as a stream: new documents in, resolved entries out, and a store that keeps first arrivals."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.dedup import DedupOptions
from millrace.operators.merge import refreshed
from millrace.operators.store import Store
from millrace.plans.shared import dropped
from millrace.schema import as_entries
from millrace.sources import feeds, fetch
from millrace.sources.config import Config


class Snapshots:
    """The entries of the last refresh that had any good source; a total failure keeps the one before."""

    def __init__(self, options: DedupOptions = DedupOptions(), rules: str = "", max_items: int = 200) -> None:
        self.options, self.rules, self.max_items = options, rules, max_items
        self.current: list | None = None

    def swap(self, documents: DataFrame) -> bool:
        return self.swap_parsed(feeds.parsed(documents))

    def swap_parsed(self, rows: DataFrame) -> bool:
        """A snapshot of what ``feeds.parsed`` gave, unless every document failed."""
        if not rows.where("item_pos = -1 and error is null").limit(1).count():
            return False
        self.current = refreshed(feeds.entries_of(rows), self.options, self.rules, self.max_items).collect()
        return True


FETCH_LOG = "url string, name string, ok boolean, not_modified boolean, status int, entries int, error string, duration_ms long, ts timestamp, pos long"


class Refresher:
    """Refreshes of all configured sources: conditional fetches, parsing, the fetch log, a snapshot and the store.

    Below ``path``: one folder of documents a refresh (the last two stay, they are the cache of
    validators and bodies), and the fetch log, to which each refresh appends a row a source.
    """

    def __init__(self, spark: SparkSession, config: Config, path: str, store: Store | None = None) -> None:
        self.spark, self.config, self.path, self.store = spark, config, path.rstrip("/"), store
        self.snapshots = Snapshots(config.dedup(), "\n".join(config.filters), config.max_items)
        self.refreshes, self.ok, self.failed, self.error = 0, 0, 0, ""
        self._cache: DataFrame | None = None
        self._old: list[str] = []

    def fetch_log(self) -> DataFrame:
        if not self.refreshes:
            return self.spark.createDataFrame([], FETCH_LOG)
        return self.spark.read.schema(FETCH_LOG).parquet(f"{self.path}/fetch-log")

    def _sources(self) -> list[dict]:
        known = {} if self._cache is None else {r["url"]: r for r in self._cache.select("url", "etag", "last_modified").collect()}
        own = lambda u: {k: known[u][k] or "" for k in ("etag", "last_modified")} if u in known else {}
        return [f | own(f["url"]) for f in self.config.feeds]

    def refresh(self) -> bool:
        """Whether any source was good; otherwise the snapshot before stays."""
        c = self.config
        results = fetch.fetched(self.spark, self._sources(), c.timeout, c.host_interval, c.workers, c.user_agent)
        folder = f"{self.path}/documents/{uuid.uuid4().hex}"
        results.write.parquet(f"{folder}/fetched")
        results = self.spark.read.schema(fetch.SCHEMA).parquet(f"{folder}/fetched")
        if self._cache is not None:
            results = fetch.with_cache(results, self._cache)
        else:
            results = fetch.with_cache(results, results.where("false"))
        results.write.parquet(f"{folder}/documents")
        documents = self.spark.read.schema(fetch.SCHEMA).parquet(f"{folder}/documents")
        feeds.parsed(documents).write.parquet(f"{folder}/parsed")
        rows = self.spark.read.parquet(f"{folder}/parsed")
        log = feeds.statuses(documents, rows).withColumn("ts", F.current_timestamp())
        log.select(*(F.col(x.split()[0]) for x in FETCH_LOG.split(", "))).write.mode("append").parquet(f"{self.path}/fetch-log")
        good, bad = log.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
        self.refreshes, self.ok, self.failed = self.refreshes + 1, good, bad
        self.error = "" if good else f"all {bad} sources failed"
        # Documents of this refresh, and of earlier ones where a source failed now.
        fresh = documents.where("body is not null and error is null").select("url", "etag", "last_modified", "body")
        kept = fresh if self._cache is None else fresh.unionByName(self._cache.join(fresh.select("url"), "url", "left_anti"))
        kept.write.parquet(f"{folder}/cache")
        self._cache = self.spark.read.parquet(f"{folder}/cache")
        swapped = self.snapshots.swap_parsed(rows)
        if swapped and self.store is not None:
            self.store.put(feeds.entries_of(rows))
        self._old.append(folder)
        dropped(self.spark, *self._old[:-2])
        self._old = self._old[-2:]
        return swapped

    def run(self, times: int = 0, stop: threading.Event | None = None) -> None:
        """Refreshes now and then every ``config.refresh`` seconds; once where that is 0."""
        stop = stop or threading.Event()
        while True:
            self.refresh()
            times -= 1
            if not self.config.refresh or times == 0 or stop.wait(self.config.refresh):
                return


def refresh_stream(documents: DataFrame, snapshots: Snapshots, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of ``documents`` is one refresh; trigger as in ``writeStream.trigger``."""
    return documents.writeStream.foreachBatch(lambda df, _: snapshots.swap(df) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def store_stream(entries_: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Inserts entries whose id is absent, batch by batch; replays of a batch change nothing."""
    return entries_.writeStream.foreachBatch(lambda df, _: store.put(as_entries(df))).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_seen(entries_: DataFrame, delay: str | None = None) -> DataFrame:
    """A stream of the first entry of each id; with ``delay`` ids are forgotten after the watermark."""
    if delay is None:
        return entries_.dropDuplicates(["id"])
    return entries_.withWatermark("published", delay).dropDuplicatesWithinWatermark(["id"])


def every(seconds: float, refresh: Callable[[], None]) -> dict:
    """Trigger arguments of a refresh interval; 0 means once."""
    return {"processingTime": f"{seconds} seconds"} if seconds > 0 else {"availableNow": True}


def retained(log: DataFrame, seconds: int, now) -> DataFrame:
    return log if seconds <= 0 else log.where(F.col("stored_at") >= now - F.make_dt_interval(secs=F.lit(seconds)))
