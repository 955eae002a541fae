"""RSS, Atom and JSON Feed of at most ``max_items`` collected entries, and HTTP validators."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import format_datetime
from xml.sax.saxutils import escape, quoteattr


@dataclass(frozen=True)
class Meta:
    title: str = ""
    link: str = ""
    description: str = ""
    self_link: str = ""
    updated: datetime | None = None


def _utc(x: datetime) -> datetime:
    return x.replace(tzinfo=UTC) if x.tzinfo is None else x.astimezone(UTC)


def rfc3339(x: datetime) -> str:
    return _utc(x).strftime("%Y-%m-%dT%H:%M:%SZ")


def _date(e) -> datetime | None:
    return e["published"] or e["updated"]


def _cdata(s: str) -> str:
    return "<![CDATA[" + s.replace("]]>", "]]]]><![CDATA[>") + "]]>"


def _tag(name: str, value: str | None, attrs: str = "") -> str:
    return f"<{name}{attrs}>{escape(value)}</{name}>" if value else ""


def rss(meta: Meta, entries) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>', f"<title>{escape(meta.title)}</title>", f"<link>{escape(meta.link)}</link>", f"<description>{escape(meta.description)}</description>"]
    if meta.self_link:
        out.append(f'<atom:link rel="self" type="application/rss+xml" href={quoteattr(meta.self_link)}/>')
    if meta.updated:
        out.append(_tag("lastBuildDate", format_datetime(_utc(meta.updated))))
    for e in entries:
        body = next((x for x in (e["content"], e["summary"]) if x and x.strip()), "")
        out += ["<item>", _tag("title", e["title"]), _tag("link", e["link"]), _tag("guid", e["id"], f' isPermaLink="{str(e["id_source"] == "link").lower()}"')]
        out += [_tag("pubDate", format_datetime(_utc(_date(e)))) if _date(e) else "", _tag("dc:creator", e["author"]), f"<description>{_cdata(body)}</description>" if body else ""]
        out += [*(_tag("category", c) for c in e["categories"] or ()), f"<source url={quoteattr(e['source_url'] or '')}>{escape(e['source_title'])}</source>" if e["source_title"] else "", "</item>"]
    return "\n".join(x for x in [*out, "</channel></rss>", ""] if x or x == "")


def atom(meta: Meta, entries) -> str:
    own = meta.self_link or meta.link or "urn:feed:" + hashlib.sha256(meta.title.encode()).hexdigest()[:32]
    stamp = meta.updated or datetime(1970, 1, 1, tzinfo=UTC)
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<feed xmlns="http://www.w3.org/2005/Atom">', f"<title>{escape(meta.title)}</title>", f"<id>{escape(own)}</id>", f"<updated>{rfc3339(stamp)}</updated>"]
    out += [f"<link href={quoteattr(meta.link)}/>" if meta.link else "", f'<link rel="self" href={quoteattr(meta.self_link)}/>' if meta.self_link else "", _tag("subtitle", meta.description)]
    for e in entries:
        out += ["<entry>", f"<title>{escape(e['title'] or '')}</title>", f"<id>{escape(e['id'] or '')}</id>", f"<link href={quoteattr(e['link'])}/>" if e["link"] else "", f"<updated>{rfc3339(e['updated'] or e['published'] or stamp)}</updated>"]
        out += [f"<published>{rfc3339(e['published'])}</published>" if e["published"] else "", f"<author>{_tag('name', e['author'])}</author>" if e["author"] else "", *(f"<category term={quoteattr(c)}/>" for c in e["categories"] or ())]
        out += [f'<summary type="html">{_cdata(e["summary"])}</summary>' if e["summary"] else "", f'<content type="html">{_cdata(e["content"])}</content>' if e["content"] else "", "</entry>"]
    return "\n".join(x for x in [*out, "</feed>"] if x) + "\n"


def json_feed(meta: Meta, entries) -> str:
    items = []
    for e in entries:
        html = next((x for x in (e["content"], e["summary"]) if x and x.strip()), "")
        item = {"id": e["id"], "url": e["link"], "title": e["title"], "content_html": html, "summary": e["summary"] if e["summary"] and e["summary"] != html else None, "date_published": rfc3339(e["published"]) if e["published"] else None, "date_modified": rfc3339(e["updated"]) if e["updated"] else None, "authors": [{"name": e["author"]}] if e["author"] else None, "tags": list(e["categories"] or []) or None}
        items.append({k: v for k, v in item.items() if v is not None and (v != "" or k in ("id", "content_html"))})
    feed = {"version": "https://jsonfeed.org/version/1.1", "title": meta.title, "home_page_url": meta.link, "feed_url": meta.self_link, "description": meta.description}
    return json.dumps({k: v for k, v in feed.items() if v} | {"items": items}, ensure_ascii=False)


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()[:16]


def etag_matches(header: str, etag: str) -> bool:
    """Whether an If-None-Match header names ``etag``, weakly, in any case or by *; an empty tag matches nothing."""
    bare = lambda x: x.strip().removeprefix("W/").lower()
    return bool(etag) and any(x.strip() == "*" or bare(x) == bare(etag) for x in header.split(","))


def not_modified(etag: str, modified: datetime | None, if_none_match: str = "", if_modified_since: datetime | None = None) -> bool:
    """If-None-Match decides where it is given."""
    if if_none_match:
        return etag_matches(if_none_match, etag)
    return bool(if_modified_since and modified and _utc(modified).replace(microsecond=0) <= _utc(if_modified_since))


def page_limit(text: str | None, default: int = 20, most: int = 200) -> int:
    try:
        n = int(text or "")
    except ValueError:
        return default
    return min(n, most) if n > 0 else default
