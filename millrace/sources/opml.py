"""Subscription lists in OPML: read to rows, written from rows."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.feeds import Node, parsed_xml


def parse(body: bytes) -> list[dict]:
    """name, url, site_url and folder of each feed, the first of each url; folders are outline paths."""
    root = parsed_xml(body)
    if root.name.lower() != "opml":
        raise ValueError("not an OPML document")
    out, seen = [], set()

    def walk(node: Node, folder: str) -> None:
        for o in node.children("outline"):
            a = {k.lower(): v.strip() for k, v in o.attrs.items()}
            url, label = a.get("xmlurl", ""), a.get("title") or a.get("text", "")
            if url and url not in seen:
                seen.add(url)
                out.append({"name": label, "url": url, "site_url": a.get("htmlurl", ""), "folder": folder})
            inner = f"{folder}/{label}" if folder and label else label or folder
            walk(o, inner if not url and o.children("outline") else folder)

    walk(root.last("body") or root, "")
    if not out:
        raise ValueError("no feeds in the document")
    return out


def read(spark: SparkSession, body: bytes) -> DataFrame:
    rows = [x | {"pos": i} for i, x in enumerate(parse(body))]
    return spark.createDataFrame(rows, "name string, url string, site_url string, folder string, pos long")


def in_folder(feeds: DataFrame, folder: str) -> DataFrame:
    return feeds.where((F.col("folder") == folder) | F.col("folder").startswith(folder + "/"))


def folders(feeds: DataFrame) -> DataFrame:
    """One row a folder with its feeds in order, folders by first place."""
    return feeds.groupBy("folder").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "name", "url", "site_url"))).alias("feeds"))


def rendered(groups, title: str = "Subscriptions") -> str:
    """OPML of folders in order, each with ``folder`` and its ``feeds``."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<opml version="2.0">', f"<head><title>{escape(title)}</title></head>", "<body>"]
    for f in groups:
        lines = []
        for x in f.feeds:
            label, site = quoteattr(x["name"] or x["url"]), f" htmlUrl={quoteattr(x['site_url'])}" if x["site_url"] else ""
            lines.append(f'<outline type="rss" text={label} title={label} xmlUrl={quoteattr(x["url"])}{site}/>')
        out += [f"<outline text={quoteattr(f.folder)}>", *lines, "</outline>"] if f.folder else lines
    return "\n".join([*out, "</body>", "</opml>", ""])


def write(feeds: DataFrame, title: str = "Subscriptions") -> str:
    return rendered(folders(feeds).orderBy("first").collect(), title)


def _quoted(s: str) -> str:
    """A YAML scalar that the configuration reads back as it is."""
    if s and s == s.strip() and not any(c in s for c in ":#\"'\n\t"):
        return s
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ").replace("\t", " ") + '"'


def as_config(feeds: list[dict], title: str = "") -> str:
    """The feeds as YAML for the configuration; what is not http(s) becomes a comment."""
    out = [*([f"title: {_quoted(title)}"] if title else []), "feeds:"]
    for f in feeds:
        if not f["url"].startswith(("http://", "https://")):
            out.append(f"  # skipped: {f['url']}")
            continue
        out += [f"  - url: {_quoted(f['url'])}", *([f"    name: {_quoted(f['name'])}"] if f["name"] else [])]
    return "\n".join(out) + "\n"
