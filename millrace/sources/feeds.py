"""RSS 2.0 and Atom 1.0 documents as entries: an Arrow pass over document bodies, errors as rows."""

from __future__ import annotations

import hashlib
import re
from html.entities import name2codepoint
from urllib.parse import urljoin
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import parsed_date
from millrace.functions.text import strip_tags
from millrace.schema import as_entries

MOST_BYTES = 16 << 20
COLUMNS = ("id", "id_source", "title", "link", "content", "summary", "author", "published_raw", "updated_raw", "source_title", "source_url")
SCHEMA = pa.schema([("source_pos", pa.int64()), ("item_pos", pa.int64()), ("error", pa.string()), ("format", pa.string()), *((c, pa.string()) for c in COLUMNS), ("categories", pa.list_(pa.string())), ("hubs", pa.list_(pa.string())), ("self_link", pa.string())])


class Node:
    """An element: its local name, namespace, attributes, text and children."""

    def __init__(self, name: str, space: str, attrs: dict[str, str]) -> None:
        self.name, self.space, self.attrs = name, space, attrs
        self.parts: list[str | Node] = []

    def children(self, *names: str) -> list[Node]:
        return [c for c in self.parts if isinstance(c, Node) and c.name in names]

    def last(self, *names: str) -> Node | None:
        return (self.children(*names) or [None])[-1]

    def text(self) -> str:
        return "".join(c for c in self.parts if isinstance(c, str))

    def of(self, *names: str) -> str:
        node = self.last(*names)
        return node.text().strip() if node else ""

    def markup(self) -> str:
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        out = []
        for c in self.parts:
            if isinstance(c, str):
                out.append(esc(c))
            else:
                attrs = "".join(f' {k}="{esc(v)}"' for k, v in c.attrs.items() if not k.startswith("xml:base"))
                out.append(f"<{c.name}{attrs}>{c.markup()}</{c.name}>")
        return "".join(out)


def decoded(body: bytes) -> str:
    """The text of a document by its declared charset; Latin-1 is read as Windows-1252, as browsers do."""
    declared = re.match(rb"\s*<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", body)
    name = declared[1].decode().lower() if declared else "utf-8"
    if name in ("utf-8", "utf8", "us-ascii", "ascii"):
        return body.decode("utf-8", "replace")
    if name in ("iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252"):
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in body) if any(0x80 <= b < 0xA0 for b in body) else body.decode("latin-1")
    raise ValueError(f"unsupported charset {name}")


def parsed_xml(body: bytes) -> Node:
    text = decoded(body.strip(b"\xef\xbb\xbf \t\r\n").lstrip(b"\xef\xbb\xbf")).lstrip("﻿ \t\r\n")
    if not text:
        raise ValueError("empty document")
    named = lambda m: f"&#{name2codepoint[m[1]]};" if m[1] in name2codepoint and m[1] not in ("amp", "lt", "gt", "quot", "apos") else m[0]
    sections = re.split(r"(<!\[CDATA\[.*?\]\]>)", text, flags=re.S)
    text = "".join(s if s.startswith("<![CDATA[") else re.sub("&([A-Za-z][A-Za-z0-9]*);", named, s) for s in sections)
    root, stack = None, []
    parser = expat.ParserCreate("utf-8", namespace_separator=" ")

    def split(name: str) -> tuple[str, str]:
        space, _, local = name.rpartition(" ")
        return local, space

    def start(name, attrs):
        nonlocal root
        local, space = split(name)
        own = {("xml:" if " " in k and "XML/1998" in k else "") + split(k)[0]: v for k, v in attrs.items()}
        node = Node(local, space, own)
        if stack:
            stack[-1].parts.append(node)
        else:
            root = node
        stack.append(node)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = lambda s: stack[-1].parts.append(s) if stack else None
    parser.buffer_text = True
    parser.Parse(re.sub(r"^<\?xml[^>]*\?>", "", text).encode(), True)
    return root


def resolved(base: str, ref: str) -> str:
    try:
        return urljoin(base, ref) if base and ref else ref
    except ValueError:
        return ref


def identity(guid: str, link: str, title: str, raw_date: str) -> tuple[str, str]:
    if guid:
        return guid, "guid"
    if link:
        return link, "link"
    return "urn:entry:" + hashlib.sha256(f"{strip_tags(title)}\0{raw_date}".encode()).hexdigest()[:32], "hash"


def _links(node: Node) -> tuple[list[str], str]:
    hubs, own = [], ""
    for link in node.children("link"):
        rel, href = link.attrs.get("rel", "").strip().lower(), link.attrs.get("href", "").strip()
        if rel == "hub" and href and href not in hubs:
            hubs.append(href)
        elif rel == "self" and href and not own:
            own = href
    return hubs, own


def rss_entries(root: Node, url: str) -> tuple[dict, list[dict]]:
    channel = root.last("channel")
    if channel is None:
        raise ValueError("no channel")
    plain = [c.text().strip() for c in channel.children("link") if c.text().strip()]
    base = plain[-1] if plain else url
    hubs, own = _links(channel)
    feed = {"source_title": channel.of("title"), "hubs": hubs, "self_link": own}
    out = []
    for item in channel.children("item"):
        at = resolved(base, item.attrs.get("xml:base", "")) or base
        guid_node = item.last("guid")
        guid = guid_node.text().strip() if guid_node else ""
        link = resolved(at, item.of("link"))
        permanent = guid_node is not None and guid_node.attrs.get("isPermaLink", "").lower() != "false"
        if not link and permanent and guid.startswith(("http://", "https://")):
            link = guid
        title, summary = item.of("title"), item.of("description")
        encoded = next((c.text().strip() for c in reversed(item.children("encoded")) if c.text().strip()), "")
        creator = next((c.text().strip() for c in item.children("creator") if c.text().strip()), "")
        raw = item.of("pubDate") or item.of("date")
        key, kind = identity(guid, link, title, raw)
        out.append({"id": key, "id_source": kind, "title": title, "link": link, "content": encoded or summary, "summary": summary, "author": creator or item.of("author"), "published_raw": raw, "updated_raw": raw, "categories": [c.text().strip() for c in item.children("category") if c.text().strip()]})
    return feed, out


def atom_entries(root: Node, url: str) -> tuple[dict, list[dict]]:
    base = resolved(url, root.attrs.get("xml:base", "")) or url

    def construct(node: Node | None) -> str:
        if node is None:
            return ""
        return (node.markup() if node.attrs.get("type") == "xhtml" else node.text()).strip()

    def link_of(node: Node, at: str) -> str:
        links = [(x.attrs.get("rel", ""), x.attrs.get("href", "").strip()) for x in node.children("link") if x.attrs.get("href", "").strip()]
        best = next((h for r, h in links if r == "alternate"), None) or next((h for r, h in links if not r), None) or (links[0][1] if links else "")
        return resolved(at, best)

    hubs, own = _links(root)
    feed = {"source_title": construct(root.last("title")), "hubs": hubs, "self_link": own}
    out = []
    for entry in root.children("entry"):
        at = resolved(base, entry.attrs.get("xml:base", "")) or base
        link, title, summary = link_of(entry, at), construct(entry.last("title")), construct(entry.last("summary"))
        published = entry.of("published") or entry.of("issued") or entry.of("updated")
        updated = entry.of("updated") or entry.of("modified") or published
        author = next((n for a in [*entry.children("author"), *root.children("author")] if (n := a.of("name") or a.of("email"))), "")
        cats = [c.attrs.get("label") or c.attrs.get("term", "") for c in entry.children("category")]
        key, kind = identity(entry.of("id"), link, title, published)
        out.append({"id": key, "id_source": kind, "title": title, "link": link, "content": construct(entry.last("content")) or summary, "summary": summary, "author": author, "published_raw": published, "updated_raw": updated, "categories": [c for c in cats if c]})
    return feed, out


def parsed_document(body: bytes, url: str = "") -> tuple[str, dict, list[dict]]:
    """(format, feed, entries) of one document; raises ValueError with the reason."""
    if len(body) > MOST_BYTES:
        raise ValueError("document is too large")
    try:
        root = parsed_xml(body)
    except expat.ExpatError as e:
        raise ValueError(f"malformed XML: {e}") from e
    kind = root.name.lower()
    if kind == "rss":
        return "rss", *rss_entries(root, url)
    if kind == "feed":
        return "atom", *atom_entries(root, url)
    raise ValueError(f"unknown format {root.name}")


def _read(x: dict) -> list[dict]:
    """A head row of one document, with its error if it has one, and a row an item."""
    head = {"item_pos": -1, "source_url": x["url"], "source_pos": x["source_pos"]}
    try:
        if x.get("error"):
            raise ValueError(x["error"])
        # An unmodified document comes with its cached body.
        if x.get("status") is not None and not 200 <= x["status"] < 300 and not (x["status"] == 304 and x["body"]):
            raise ValueError(f"HTTP {x['status']}")
        kind, feed, found = parsed_document(x["body"] or b"", x.get("final_url") or x["url"] or "")
    except ValueError as e:
        return [head | {"error": str(e)}]
    if x.get("name"):
        feed = feed | {"source_title": x["name"]}
    return [head | {"format": kind} | feed, *(head | {"format": kind} | e | {"item_pos": i} | feed for i, e in enumerate(found))]


def _documents(rows):
    for batch in rows:
        # Bodies are large: one document at a time is turned into Python values.
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_pylist(_read(batch.slice(i, 1).to_pylist()[0]), SCHEMA)


OPTIONAL = ("final_url", "name", "error")


def parsed(documents: DataFrame) -> DataFrame:
    """Of ``documents(source_pos, url, status, body)``: a head row each (item_pos -1, error if it failed) and a row an item.

    A column ``name`` replaces the title of the source where it is not empty, ``final_url`` is what
    relative links refer to, and ``error`` that of a failed fetch.
    """
    fields = ", ".join(f"{f.name} {'array<string>' if pa.types.is_list(f.type) else 'long' if f.type == pa.int64() else 'string'}" for f in SCHEMA)
    more = [c for c in OPTIONAL if c in documents.columns]
    return documents.select("source_pos", "url", "status", "body", *more).mapInArrow(_documents, fields)


def entries_of(rows: DataFrame) -> DataFrame:
    """The entries among the rows of ``parsed``; seq follows source order, then item order."""
    items = rows.where("item_pos >= 0")
    seq = F.col("source_pos") * (1 << 32) + F.col("item_pos")
    published = parsed_date(F.col("published_raw"))
    return as_entries(items.withColumns({"published": published, "updated": F.coalesce(parsed_date(F.col("updated_raw")), published), "seq": seq}))


def entries(documents: DataFrame) -> DataFrame:
    """The entries of all documents."""
    return entries_of(parsed(documents))


def statuses(results: DataFrame, rows: DataFrame) -> DataFrame:
    """The fetch log of one refresh: a row a source of ``results``, with what ``parsed`` made of it."""
    per = rows.groupBy("source_pos").agg(F.count_if(F.col("item_pos") >= 0).alias("entries"), F.max("error").alias("error"))
    found = results.select("source_pos", "url", "name", "not_modified", "status", "duration_ms").join(per, "source_pos", "left")
    return found.select("url", "name", F.col("error").isNull().alias("ok"), "not_modified", "status", F.coalesce("entries", F.lit(0)).cast("int").alias("entries"), F.coalesce("error", F.lit("")).alias("error"), "duration_ms", F.col("source_pos").alias("pos"))
