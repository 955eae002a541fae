"""Documents, subscription lists, configuration, renderings and refreshes."""

import json
from datetime import datetime

import pytest

from millrace.operators.dedup import DedupOptions
from millrace.sources import config, feeds, opml, render
from millrace.streaming.refresh import Snapshots, refresh_stream

RSS = b"""<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>Blog</title><link>https://blog.example/</link>
<atom:link rel="hub" href="https://hub.example/"/><atom:link rel="self" href="https://blog.example/rss"/>
<item><title>One &amp; two&nbsp;</title><link>/one</link><guid isPermaLink="false">g1</guid><pubDate>Mon, 02 Jan 2006 15:04:05 -0700</pubDate><description>short</description><content:encoded><![CDATA[<p>long</p>]]></content:encoded><dc:creator>Ann</dc:creator><category>go</category><category>x</category></item>
<item><title>Two</title><link>https://blog.example/two</link></item>
<item><title>Three</title><pubDate>soon</pubDate></item>
<item><title>Four</title><guid>https://blog.example/four</guid></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom" xml:base="https://a.example/"><title>A</title><author><name>Root</name></author>
<entry><id>urn:1</id><title type="html">&lt;b&gt;Bold&lt;/b&gt;</title><link rel="alternate" href="one"/><updated>2026-07-01T00:00:00Z</updated><summary>s</summary><category term="t" label="L"/></entry>
<entry><title type="xhtml"><div>x <b>y</b></div></title><link href="https://a.example/two"/><published>2026-07-02T00:00:00Z</published><content>c</content><author><name>Bob</name></author></entry></feed>"""


def test_rss():
    kind, feed, items = feeds.parsed_document(RSS, "https://blog.example/feed")
    assert kind == "rss" and feed == {"source_title": "Blog", "hubs": ["https://hub.example/"], "self_link": "https://blog.example/rss"}
    one, two, three, four = items
    assert (one["id"], one["id_source"], one["title"], one["link"], one["content"], one["summary"], one["author"], one["categories"]) == ("g1", "guid", "One & two", "https://blog.example/one", "<p>long</p>", "short", "Ann", ["go", "x"])
    assert (two["id"], two["id_source"]) == ("https://blog.example/two", "link")
    assert three["id_source"] == "hash" and three["published_raw"] == "soon"
    assert (four["link"], four["id_source"]) == ("https://blog.example/four", "guid")


def test_atom():
    kind, _, (one, two) = feeds.parsed_document(ATOM)
    assert kind == "atom"
    assert (one["id"], one["title"], one["link"], one["author"], one["categories"], one["content"]) == ("urn:1", "<b>Bold</b>", "https://a.example/one", "Root", ["L"], "s")
    assert (two["id"], two["author"], two["title"]) == ("https://a.example/two", "Bob", "<div>x <b>y</b></div>")


@pytest.mark.parametrize("body", [b"", b"  \n", b"<rss>", b"<html></html>", b"not xml", b"<rdf/>", b'<?xml version="1.0" encoding="koi8-r"?><rss><channel/></rss>'])
def test_bad_documents(body):
    with pytest.raises(ValueError):
        feeds.parsed_document(body)


def test_charsets():
    body = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><title>café “x”</title></channel></rss>'.encode("cp1252")
    assert feeds.parsed_document(body)[1]["source_title"] == "café “x”"
    assert feeds.parsed_document(b"\xef\xbb\xbf" + RSS)[0] == "rss"


def documents(spark):
    return spark.createDataFrame([(0, "https://blog.example/feed", 200, RSS), (1, "https://a.example/feed", None, ATOM), (2, "https://bad.example/", 502, b"oops")], "source_pos long, url string, status int, body binary")


def test_entries_and_errors(spark):
    got = feeds.entries(documents(spark)).orderBy("seq").collect()
    assert [r["title"] for r in got][:2] == ["One & two", "Two"] and len(got) == 6
    assert got[0]["published"] == datetime(2006, 1, 2, 22, 4, 5)
    assert [r["error"] for r in feeds.parsed(documents(spark)).where("error is not null").collect()] == ["HTTP 502"]


def test_refresh_stream(spark, tmp_path):
    documents(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    snapshots = Snapshots(DedupOptions(), "exclude title ~ ^Four", 3)
    stream = spark.readStream.schema(documents(spark).schema).parquet(f"{tmp_path}/in")
    refresh_stream(stream, snapshots, f"{tmp_path}/cp").awaitTermination()
    assert [r["title"] for r in snapshots.current] == ["<div>x <b>y</b></div>", "<b>Bold</b>", "One & two"]
    assert not snapshots.swap(documents(spark).where("status = 502")) and len(snapshots.current) == 3


def test_renderings_parse_again(spark):
    rows = feeds.entries(documents(spark)).orderBy("seq").collect()
    meta = render.Meta("All", "https://all.example/", "d", "https://all.example/rss", datetime(2026, 7, 3))
    for f in (render.rss, render.atom):
        again = feeds.parsed_document(f(meta, rows).encode())[2]
        assert [r["title"] for r in again] == [r["title"] for r in rows] and [r["content"] for r in again][0] == "<p>long</p>"
    out = json.loads(render.json_feed(meta, rows))
    assert out["items"][0]["authors"] == [{"name": "Ann"}] and out["items"][0]["summary"] == "short" and "summary" not in out["items"][4]


def test_http_validators():
    assert render.etag_matches('W/"a", "b"', '"a"') and render.etag_matches("*", '"x"') and not render.etag_matches('"c"', '"a"')
    assert render.not_modified('"a"', datetime(2026, 1, 1), "", datetime(2026, 1, 2)) and not render.not_modified('"a"', datetime(2026, 1, 1), '"b"', datetime(2026, 1, 2))
    assert [render.page_limit(x) for x in (None, "", "x", "0", "-1", "7", "999")] == [20, 20, 20, 20, 20, 7, 200]


OPML = b"""<opml version="2.0"><body><outline text="News"><outline text="Deep"><outline type="rss" title="A" text="a" xmlUrl="https://a.example/"/></outline><outline text="B" xmlUrl="https://b.example/" htmlUrl="https://b.example/site"/></outline><outline text="Again" xmlUrl="https://a.example/"/><outline text="Top" xmlUrl="ftp://t.example/"/></body></opml>"""


def test_opml(spark):
    got = opml.parse(OPML)
    assert [(x["name"], x["folder"]) for x in got] == [("A", "News/Deep"), ("B", "News"), ("Top", "")]
    df = opml.read(spark, OPML)
    assert [x["name"] for x in opml.in_folder(df, "News").collect()] == ["A", "B"]
    assert opml.parse(opml.write(df).encode()) == got
    assert "# skipped: ftp://t.example/" in opml.as_config(got)
    for bad in (b"<rss/>", b"<opml><body/></opml>"):
        with pytest.raises(ValueError):
            opml.parse(bad)


YAML = """
title: "Mine"  # quoted
refresh: 1h30m
title_threshold: 0.8
filters:
  - exclude title ~ ^Ad
searches:
  - name: go
    query: +go -rust
    limit: 5
feeds:
  - https://a.example/
  - url: https://b.example/
    name: B
"""


def test_config():
    c = config.load(YAML)
    assert (c.title, c.refresh, c.title_threshold, c.filters, c.searches[0].limit, c.feeds[1]) == ("Mine", 5400.0, 0.8, ["exclude title ~ ^Ad"], 5, {"url": "https://b.example/", "name": "B"})
    assert config.load('{"feeds": ["https://a.example/"], "timeout": "5"}').timeout == 5.0
    assert [config.duration(x) for x in ("", "90", "1m30s", "250ms", 3)] == [0, 90, 90, 0.25, 3]


def test_quotes_and_comments():
    feeds = "feeds:\n  - https://a.example/#part # the first\n"
    read = lambda v: config.load(f"title: {v}\n{feeds}").title
    assert [read(v) for v in (r'"a \"b\" c"', '"caf\u00e9\\tx"', r'"back\\slash"', "'it''s'", "plain # note", "'#1' # note", '""')] == ['a "b" c', "caf\u00e9\tx", "back\\slash", "it''s", "plain", "#1", ""]
    c = config.load("self_link: https://m.example/feed.xml\naddr: ':9'\nuser_agent: \"me/1 (+https://m.example)\"\nworkers:\nmax_items: 5\n" + feeds)
    assert (c.self_link, c.addr, c.user_agent, c.workers, c.max_items, c.feeds[0]["url"]) == ("https://m.example/feed.xml", ":9", "me/1 (+https://m.example)", 8, 5, "https://a.example/#part")


FAULTS = ("[]", "- a\n- b\n", '{"feeds": 3}', '{"feeds": [3]}', '{"feeds": [{"url": "https://a/", "nme": "x"}]}', '{"searches": ["x"], "feeds": ["https://a/"]}', '{"searches": [{"name": "a", "query": "b", "limt": 1}], "feeds": ["https://a/"]}', '{"title": 3, "feeds": ["https://a/"]}', '{"max_items": 1.5, "feeds": ["https://a/"]}', '{"workers": "many", "feeds": ["https://a/"]}', '{"refresh": [], "feeds": ["https://a/"]}', '{"feeds": ["https://a/"]', "title: \"open\nfeeds:\n  - https://a/\n", 'title: "')


@pytest.mark.parametrize("text", FAULTS)
def test_faults_are_config_errors(text):
    with pytest.raises(config.ConfigError):
        config.load(text)


@pytest.mark.parametrize("text", ["feeds:\n", "feeds:\n  - ftp://x/\n", "feeds:\n  - https://a/\n  - https://a/\n", "nope: 1\n", "feeds:\n\t- https://a/\n", "title: a\ntitle: b\n", "feeds:\n  - https://a/\nfilters:\n  - bad rule here x\n", "feeds:\n  - https://a/\ntitle_threshold: 2\n", "feeds:\n  - https://a/\nrefresh: soon\n"])
def test_bad_config(text):
    with pytest.raises(config.ConfigError):
        config.load(text)
