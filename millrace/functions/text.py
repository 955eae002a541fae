"""Text functions: native columns where the semantics allow, Arrow UDFs for character state machines."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from html.entities import name2codepoint

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Words that are not indexed.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with")
# Elements whose contents are dropped, elements without an end, and those that break a line or a paragraph.
DROPPED = frozenset("script style noscript template nav footer header aside form button select textarea iframe object embed svg math".split())
VOID = frozenset("br hr img meta link input source col area base wbr param track embed".split())
PARAGRAPH = frozenset("p div blockquote section article pre figure h1 h2 h3 h4 h5 h6".split())
LINE = frozenset("br ul ol li dl dt dd table tr figcaption hr".split())
SUMMARY_LENGTH, WORDS_A_MINUTE, SNIPPET_WIDTH = 280, 200, 200
TOKEN = r"[\p{L}\p{Nd}]+"
_ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]{1,31}));")


def _entity(m: re.Match) -> str:
    code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else name2codepoint.get(m[3], 0)
    return chr(code) if 0 < code <= 0x10FFFF else m[0]


def decode_entities(text: str) -> str:
    """One pass over character references; unknown or impossible ones stay."""
    return _ENTITY.sub(_entity, text) if "&" in text else text


def strip_tags(text: str) -> str:
    """Tags become spaces, then references are decoded, then white space collapses."""
    return " ".join(decode_entities(re.sub("<[^>]*>", " ", text)).split())


def first_full(*columns: str | Column) -> Column:
    """The first value that is more than white space, as it is; else empty."""
    full = [F.when(F.coalesce(c, F.lit("")).rlike(r"(?U)\S"), c) for c in (F.col(x) if isinstance(x, str) else x for x in columns)]
    return F.coalesce(*full, F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), lambda x: ~x.isin(*STOP_WORDS))


def tokenize(text: str) -> list[str]:
    out, word = [], []
    for c in [*text, " "]:
        if c.isalpha() or c.isdecimal():
            word.append(c.lower())
        elif word:
            out.append("".join(word))
            word = []
    return [w for w in out if w not in STOP_WORDS]


#: Bytes of text that a worker takes from its batch at a time.
PIECE = 1 << 20


def pieces(text: pa.Array):
    """Lists of the texts of a batch, null as empty, of about ``PIECE`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield [x or "" for x in text.slice(at, to - at).to_pylist()]
        at = to


def mapped(f: Callable, text: pa.Array, out: pa.DataType) -> pa.Array:
    """``f`` of each text of a batch; only one piece of it is held in Python objects."""
    done = [pa.array([f(x) for x in piece], out) for piece in pieces(text)]
    return pa.concat_arrays(done) if done else pa.array([], out)


@F.arrow_udf(StringType())
def stripped(text: pa.Array) -> pa.Array:
    return mapped(strip_tags, text, pa.string())


def normalized_title(title: Column, markup: bool = True) -> Column:
    """Lower-case words of a title; without ``markup`` it holds no tags or references and stays native."""
    plain = stripped(title) if markup else F.coalesce(title, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{Nd}]+", " "))


def normalize_title(title: str) -> str:
    words = "".join(c if c.isalpha() or c.isdecimal() else " " for c in strip_tags(title).lower())
    return " ".join(words.split())


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets in arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both))


def set_similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def content_words(body: str) -> list[str]:
    """Lower-case words outside tags.

    A bare ampersand swallows what follows until white space, a semicolon or more than 12
    characters, as a reference would; what is pending at the end is lost.
    """
    out, word, in_tag, ref = [], [], False, None

    def feed(text: str) -> None:
        nonlocal word
        for c in text:
            if c.isalpha() or c.isdecimal():
                word.append(c.lower())
            elif word:
                out.append("".join(word))
                word = []

    for c in body:
        if in_tag:
            in_tag = c != ">"
        elif c == "<":
            in_tag = True
            feed(" ")
        elif ref is not None:
            ref += c
            if c == ";":
                feed(decode_entities(ref))
                ref = None
            elif c.isspace() or len(ref.encode()) > 13:
                feed(" ")
                ref = None
        elif c == "&":
            ref = "&"
        else:
            feed(c)
    feed(" ")
    return out


def shingle_set(words: list[str], width: int = 4) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _tag(text: str, at: int) -> tuple[int, str, bool, bool] | None:
    """Of the tag at ``at``: (end, name, closing, self-closed); None where it is no tag."""
    m = re.compile(r"</?([A-Za-z][^\s/>]*)").match(text, at)
    if not m:
        return None
    i, quote = m.end(), ""
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            break
        i += 1
    name = m[1].lower().rpartition(":")[2]
    return min(i + 1, len(text)), name, text[at + 1] == "/", text[i - 1 : i] == "/"


def plain(html: str) -> str:
    """Readable text of markup: dropped elements go with their contents, blocks become breaks."""
    out: list[str] = []
    breaks, space, depth, drop, at, n = 0, False, 0, "", 0, len(html)

    def write(text: str) -> None:
        nonlocal breaks, space
        for piece in re.split(r"(\s+)", text):
            if not piece:
                continue
            if piece.isspace():
                space = True
                continue
            if out:
                out.append("\n" * breaks if breaks else " " if space else "")
            out.append(piece)
            breaks, space = 0, False

    while at < n:
        lt = html.find("<", at)
        end = n if lt < 0 else lt
        if not drop:
            write(decode_entities(html[at:end]))
        if lt < 0:
            break
        at = lt
        if html.startswith("<!--", at):
            close = html.find("-->", at + 4)
            at = n if close < 0 else close + 3
        elif html.startswith("<![CDATA[", at):
            close = html.find("]]>", at)
            if not drop:
                write(html[at + 9 : n if close < 0 else close])
            at = n if close < 0 else close + 3
        elif html.startswith(("<!", "<?"), at):
            close = html.find(">", at)
            at = n if close < 0 else close + 1
        elif tag := _tag(html, at):
            at, name, closing, alone = tag
            if drop:
                depth += (name == drop) * (-1 if closing else 1)
                drop = drop if depth else ""
            elif name in DROPPED and not closing:
                drop, depth = name, 1
            if not drop and name not in DROPPED:
                breaks = max(breaks, 2 if name in PARAGRAPH else 1 if name in LINE else 0)
        elif html.startswith("</", at):
            close = html.find(">", at)
            at = n if close < 0 else close + 1
        else:
            if not drop:
                write("<")
            at += 1
    return "".join(out)


def summarize(text: str, most: int = SUMMARY_LENGTH) -> str:
    """At most ``most`` characters: up to the last sentence end past a quarter, else the last word and an ellipsis."""
    text = " ".join(text.split())
    if len(text) <= most or most <= 0:
        return text if most > 0 else ""
    cut = text[:most]
    ends = [i for i, c in enumerate(cut) if c in ".!?" and (i + 1 == len(cut) or cut[i + 1] == " ") and not (c == "." and i and cut[i - 1].isdigit())]
    if ends and len(cut[: ends[-1]].encode()) >= most // 4:
        return cut[: ends[-1] + 1]
    head = cut.rpartition(" ")[0] or cut
    return head.rstrip(",;: ") + "\u2026"


def snippet(text: str, matched: list[str], width: int = SNIPPET_WIDTH) -> str:
    """A window around the first hit of any matched term, cut at words."""
    flat = " ".join(text.split())
    if len(flat) <= width:
        return flat
    low = flat.lower() if len(flat.lower()) == len(flat) else flat
    hits = [i for m in matched if m and (i := low.find(m)) >= 0]
    start = max(0, min(min(hits, default=0) - width // 3, len(flat) - width))
    part = flat[start : start + width]
    if start and " " in part:
        part = part.partition(" ")[2]
    if start + width < len(flat) and " " in part:
        part = part.rpartition(" ")[0]
    return ("\u2026" if start else "") + part + ("\u2026" if start + width < len(flat) else "")


@F.arrow_udf(StringType())
def plain_text(html: pa.Array) -> pa.Array:
    return mapped(plain, html, pa.string())


@F.arrow_udf(StringType())
def summary_text(text: pa.Array) -> pa.Array:
    return mapped(summarize, text, pa.string())


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("summary", StringType())]))
def readable(html: pa.Array) -> pa.Array:
    """Plain text and its summary."""

    def both(x: str) -> dict:
        text = plain(x)
        return {"text": text, "summary": summarize(text)}

    return mapped(both, html, pa.struct([("text", pa.string()), ("summary", pa.string())]))


@F.pandas_udf(StringType())
def snippet_text(text: pd.Series, matched: pd.Series) -> pd.Series:
    return pd.Series([snippet(t or "", [] if m is None else list(m)) for t, m in zip(text, matched, strict=True)])


@F.arrow_udf(ArrayType(StringType()))
def body_words(body: pa.Array) -> pa.Array:
    return mapped(content_words, body, pa.list_(pa.string()))


def count_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))).cast("long")


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.ceil(words / WORDS_A_MINUTE).cast("long"))


def minutes(words: int) -> int:
    return max(0, math.ceil(words / WORDS_A_MINUTE))


def entry_id(guid: Column, link: Column, title: Column, raw_date: Column, prefix: str = "urn:entry:") -> Column:
    """guid, else link, else a hash of title and date."""
    digest = F.substring(F.sha2(F.concat(title, F.lit("\0"), raw_date), 256), 1, 32)
    return F.coalesce(F.when(F.trim(guid) != "", F.trim(guid)), F.when(F.trim(link) != "", F.trim(link)), F.concat(F.lit(prefix), digest))


def extracted(content: Column, summary: Column) -> Column:
    """text, summary, words and reading minutes of an entry."""
    both = readable(first_full(content, summary))
    text = both["text"]
    words = count_words(text)
    return F.struct(text.alias("text"), both["summary"].alias("summary"), words.alias("words"), reading_minutes(words).alias("reading_minutes"))
