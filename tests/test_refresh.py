"""Fetching over HTTP, refreshes with a cache, and the command line, against a local server."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from millrace import __main__ as cli
from millrace.operators.store import Store
from millrace.sources import config, fetch
from millrace.streaming.refresh import Refresher
from millrace.streaming.service import Service


def rss(title, *items):
    body = "".join(f"<item><title>{t}</title><link>/{t}</link><guid isPermaLink='false'>{t}</guid></item>" for t in items)
    return f"<rss><channel><title>{title}</title>{body}</channel></rss>".encode()


@pytest.fixture()
def site():
    state = {"/a": rss("A", "apple", "pear"), "/b": rss("B", "plum"), "seen": [], "down": set()}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            state["seen"].append((self.path, time.monotonic(), dict(self.headers)))
            tag = f'"{self.path}"'
            if self.path in state["down"]:
                self.send_error(503)
            elif self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/deep/feed")
                self.end_headers()
            elif self.path == "/blank304" or self.headers.get("If-None-Match") == tag:
                self.send_response(304)
                self.end_headers()
            else:
                body = state.get(self.path, rss("D", "deep"))
                self.send_response(200)
                self.send_header("ETag", tag)
                self.end_headers()
                self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}"
    yield state
    server.shutdown()


def test_fetch(site):
    got = fetch.fetch(site["url"] + "/moved", agent="tester/2")
    assert got["status"] == 200 and got["final_url"].endswith("/deep/feed") and b"deep" in got["body"]
    assert {h["User-Agent"] for _, _, h in site["seen"]} == {"tester/2"}
    assert fetch.fetch(site["url"] + "/a", etag='"/a"') | {"error": None} == fetch.fetch(site["url"] + "/a", etag='"/a"') and fetch.fetch(site["url"] + "/a", etag='"/a"')["not_modified"]
    assert fetch.fetch(site["url"] + "/blank304")["error"] == "HTTP 304"
    assert fetch.fetch("http://127.0.0.1:1/")["error"] and fetch.fetch("nonsense")["error"]


def test_partitions_are_workers_and_keep_hosts_together():
    sources = [{"url": f"http://h{i % 5}.example/{i}"} for i in range(12)]
    reader = fetch._Reader({"sources": json.dumps(sources), "workers": "3"})
    parts = reader.partitions()
    assert len(parts) == 3
    hosts = [{s["url"].split("/")[2] for s in h} for p in parts for h in p.hosts]
    assert all(len(x) == 1 for x in hosts) and len(hosts) == 5
    assert len(fetch._Reader({"sources": json.dumps(sources), "workers": "0"}).partitions()) == 5


def test_host_interval(site):
    sources = [{"url": site["url"] + f"/{i}"} for i in range(3)]
    reader = fetch._Reader({"sources": json.dumps(sources), "hostInterval": "0.2"})
    rows = list(reader.read(reader.partitions()[0]))
    times = [t for _, t, _ in site["seen"]]
    assert len(rows) == 3 and all(b - a >= 0.19 for a, b in zip(times, times[1:], strict=False))


def titles(refresher):
    return {(e["title"], e["source_title"]) for e in refresher.snapshots.current}


def test_refreshes_share_a_cache_a_log_and_a_store(spark, site, tmp_path):
    feeds = [{"url": site["url"] + "/a", "name": "Orchard"}, {"url": site["url"] + "/b", "name": ""}]
    c = config.checked(config.Config(feeds=feeds, host_interval=0.0, title_threshold=0.0))
    store = Store(spark, f"file://{tmp_path}/store")
    r = Refresher(spark, c, f"file://{tmp_path}/state", store)
    assert r.refresh() and (r.refreshes, r.ok, r.failed) == (1, 2, 0)
    want = {("apple", "Orchard"), ("pear", "Orchard"), ("plum", "B")}
    assert titles(r) == want
    # Both answer 304 now, and their entries stay.
    assert r.refresh() and titles(r) == want and (r.ok, r.failed) == (2, 0)
    assert [h.get("If-None-Match") for _, _, h in site["seen"]].count(None) == 2
    site["down"].add("/b")
    assert r.refresh() and titles(r) == {x for x in want if x[1] == "Orchard"} and (r.ok, r.failed) == (1, 1)
    site["down"].add("/a")
    assert not r.refresh() and r.error == "all 2 sources failed" and len(r.snapshots.current) == 2
    site["down"].clear()
    # The cache outlives failures.
    assert r.refresh() and titles(r) == want
    assert store.read().count() == 3
    health = {x["url"].rsplit("/")[-1]: x for x in Service.of(r)._sources()}
    assert (health["a"]["fetches"], health["a"]["failures"], health["a"]["not_modified"], health["a"]["entries"], health["a"]["name"]) == (5, 1, 3, 2, "Orchard")
    counts = json.loads(Service.of(r).answer("GET", "/metrics").body)
    assert counts["refreshes"] == 5 and counts["degraded"] == 0
    assert len(list((tmp_path / "state/documents").iterdir())) == 2


def test_unmodified_without_a_cached_body_is_an_error(spark, site):
    rows = fetch.fetched(spark, [{"url": site["url"] + "/a", "etag": '"/a"'}], host_interval=0)
    got = fetch.with_cache(rows, spark.createDataFrame([], "url string, body binary")).first()
    assert got["not_modified"] and got["error"] == "not modified, but nothing is cached"


def test_self_links(spark, site, tmp_path):
    c = config.checked(config.Config(feeds=[{"url": site["url"] + "/a", "name": ""}], self_link="https://m.example/feeds/all.xml", searches=[config.SavedSearch("fruit", "apple")], host_interval=0.0))
    s = Service.of(Refresher(spark, c, f"file://{tmp_path}"))
    assert 'href="https://m.example/feeds/all.xml"' in s.answer("GET", "/feed.xml").body
    assert 'href="https://m.example/saved/fruit.atom"' in s.answer("GET", "/saved/fruit.atom").body
    assert s.answer("GET", "/saved/fruit").headers["Content-Type"].startswith("application/rss+xml")


def run(capsys, *argv):
    code = cli.main(list(argv))
    out = capsys.readouterr()
    return code, out.out, out.err


def test_command_line(spark, site, tmp_path, capsys):
    path = tmp_path / "feeds.yaml"
    path.write_text(f"title: All\nhost_interval: 0\nfeeds:\n  - url: {site['url']}/a\n    name: \"Or: chard\"\n")
    assert run(capsys, "version")[1].startswith("millrace ")
    code, out, _ = run(capsys, "search", "--config", str(path), "--format", "json", "apple")
    assert code == 0 and [x["title"] for x in json.loads(out)["results"]] == ["apple"]
    assert "matches: 1" in run(capsys, "search", "pear", "--config", str(path))[1]
    assert run(capsys, "search", "--config", str(path), "the")[0] == 1
    assert "entries: 1" in run(capsys, "fetch", site["url"] + "/a", "--limit", "1")[1]
    assert run(capsys, "fetch", "--format", "atom", site["url"] + "/a")[1].count("<entry>") == 2
    assert run(capsys, "fetch", "ftp://x/")[0] == 1 and run(capsys, "fetch", "http://127.0.0.1:1/")[0] == 1
    code, out, _ = run(capsys, "opml", "export", "--config", str(path))
    (tmp_path / "list.opml").write_text(out)
    assert code == 0 and "Or: chard" in out
    code, out, _ = run(capsys, "opml", "import", "--title", "Mine: all", str(tmp_path / "list.opml"))
    assert config.load(out).title == "Mine: all" and config.load(out).feeds == [{"url": site["url"] + "/a", "name": "Or: chard"}]
    assert run(capsys, "opml", "import", "--folder", "none", str(tmp_path / "list.opml"))[0] == 1
    assert run(capsys, "search", "--config", str(tmp_path / "absent.yaml"), "x")[0] == 1
