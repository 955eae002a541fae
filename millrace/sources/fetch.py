"""Fetching documents over HTTP: a Python data source of at most ``workers`` partitions, errors as rows.

All sources of a host are in one partition, which keeps the interval between two requests to it and
turns to its other hosts meanwhile.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.sources.feeds import MOST_BYTES

SCHEMA = "source_pos long, url string, final_url string, name string, status int, not_modified boolean, etag string, last_modified string, body binary, error string, duration_ms long"
AGENT = "millrace/1"
ACCEPT = "application/rss+xml, application/atom+xml, application/xml;q=0.9, text/xml;q=0.8, */*;q=0.5"


def fetch(url: str, timeout: float = 20.0, etag: str = "", last_modified: str = "", agent: str = AGENT) -> dict:
    """One conditional GET: status, validators and body, or an error; never raises."""
    head = {"User-Agent": agent or AGENT, "Accept": ACCEPT} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": last_modified} if last_modified else {})
    out = {"final_url": url, "status": None, "not_modified": False, "etag": etag, "last_modified": last_modified, "body": None, "error": None}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=timeout) as r:
            body = r.read(MOST_BYTES + 1)
            out |= {"status": r.status, "final_url": r.url, "etag": r.headers.get("ETag", ""), "last_modified": r.headers.get("Last-Modified", "")}
            out |= {"error": "document is too large"} if len(body) > MOST_BYTES else {"body": body}
    except urllib.error.HTTPError as e:
        fresh = e.code == 304 and bool(etag or last_modified)
        out |= {"status": e.code, "not_modified": fresh, "error": None if fresh else f"HTTP {e.code}"}
    except (OSError, ValueError) as e:
        out["error"] = str(e)
    return out


class _Hosts(InputPartition):
    def __init__(self, hosts: list[list[dict]]) -> None:
        self.hosts = hosts


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.sources, self.agent = json.loads(options["sources"]), options.get("userAgent", "")
        self.timeout, self.interval, self.workers = float(options.get("timeout", 20)), float(options.get("hostInterval", 1)), int(options.get("workers", 8))

    def partitions(self):
        by_host: dict[str, list[dict]] = {}
        for i, s in enumerate(self.sources):
            by_host.setdefault(urlsplit(s["url"]).netloc, []).append(s | {"source_pos": i})
        hosts = sorted(by_host.values(), key=len, reverse=True)
        n = min(len(hosts), self.workers if self.workers > 0 else 8)
        return [_Hosts(hosts[i::n]) for i in range(n)]

    def read(self, partition):
        free = [0.0] * len(partition.hosts)
        queues = [list(reversed(x)) for x in partition.hosts]
        while any(queues):
            i = min((i for i, q in enumerate(queues) if q), key=lambda i: free[i])
            time.sleep(max(0.0, free[i] - time.monotonic()))
            s, start = queues[i].pop(), time.monotonic()
            got = fetch(s["url"], self.timeout, s.get("etag", ""), s.get("last_modified", ""), self.agent)
            free[i] = time.monotonic() + self.interval
            yield (s["source_pos"], s["url"], got["final_url"], s.get("name", ""), got["status"], got["not_modified"], got["etag"], got["last_modified"], got["body"], got["error"], int((time.monotonic() - start) * 1000))


class FeedDataSource(DataSource):
    """``spark.read.format("feeds").option("sources", json)``: tasks by host."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetched(spark: SparkSession, sources: list[dict], timeout: float = 20, host_interval: float = 1, workers: int = 8, user_agent: str = "") -> DataFrame:
    """One row a source; read it once, since each read fetches again."""
    spark.dataSource.register(FeedDataSource)
    options = {"sources": json.dumps(sources), "timeout": str(timeout), "hostInterval": str(host_interval), "workers": str(workers), "userAgent": user_agent}
    return spark.read.format("feeds").options(**options).load()


def with_cache(results: DataFrame, previous: DataFrame) -> DataFrame:
    """``results`` with the bodies of unmodified documents from ``previous(url, body)``; one that has none there is an error."""
    old = previous.groupBy("url").agg(F.first("body", ignorenulls=True).alias("old"))
    joined = results.join(old, "url", "left")
    body = F.coalesce("body", F.when(F.col("not_modified"), F.col("old")))
    error = F.when(F.col("not_modified") & body.isNull(), "not modified, but nothing is cached").otherwise(F.col("error"))
    return joined.select(*(body.alias(c) if c == "body" else error.alias(c) if c == "error" else F.col(c) for c in results.columns))
