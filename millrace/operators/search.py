"""Full-text search: an inverted index as tables, BM25 with required, excluded and phrase constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import first_full, plain_text, snippet_text, tokenize, tokens
from millrace.schema import entry_date

K1, B = 1.2, 0.75
# What an occurrence counts in each field.
BOOSTS = {"title": 3.0, "category": 2.0, "author": 1.5, "source": 1.0, "body": 1.0}


@dataclass(frozen=True)
class Term:
    text: str
    required: bool = False
    negated: bool = False


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    negated: bool = False

    @property
    def text(self) -> str:
        return " ".join(self.terms)


@dataclass(frozen=True)
class Query:
    terms: tuple[Term, ...] = ()
    phrases: tuple[Phrase, ...] = field(default=())

    def __bool__(self) -> bool:
        return bool(self.terms or self.phrases)

    def __str__(self) -> str:
        sign = lambda t: "-" if t.negated else "+" if getattr(t, "required", False) else ""
        return " ".join([sign(t) + t.text for t in self.terms] + [f'{sign(p)}"{p.text}"' for p in self.phrases])


def parse_query(text: str) -> Query:
    """Words, +required, -excluded, "phrases" and -"excluded phrases"."""
    terms, phrases, at = [], [], 0
    while at < len(text):
        if text[at] in " \t\n\r":
            at += 1
            continue
        sign = text[at] if text[at] in "+-" else ""
        at += len(sign)
        if at < len(text) and text[at] == '"':
            end = text.find('"', at + 1)
            end = len(text) if end < 0 else end
            words = tokenize(text[at + 1 : end])
            at = end + 1
            if len(words) == 1:
                terms.append(Term(words[0], negated=sign == "-"))
            elif words:
                phrases.append(Phrase(tuple(words), sign == "-"))
        else:
            end = at
            while end < len(text) and text[end] not in " \t\n\r":
                end += 1
            terms += [Term(w, sign == "+", sign == "-") for w in tokenize(text[at:end])]
            at = end
    return Query(tuple(terms), tuple(phrases))


def indexed(entries: DataFrame, markup: bool = True) -> DataFrame:
    """(seq, id, date, toks, haystack): weighted tokens of each entry and the text that phrases search."""
    body = first_full("content", "summary")
    body = plain_text(body) if markup else body
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = {"title": empty("title"), "category": F.coalesce(F.array_join("categories", " "), F.lit("")), "author": empty("author"), "source": empty("source_title"), "body": body}
    split = entries.select("seq", "id", entry_date().alias("date"), *(tokens(c).alias(n) for n, c in fields.items()))
    weighted = F.concat(*(_weighted(n, w) for n, w in BOOSTS.items()))
    spaced = F.concat(F.lit(" "), F.array_join(F.concat("title", "body"), " "), F.lit(" "))
    return split.select("seq", "id", "date", weighted.alias("toks"), spaced.alias("haystack"))


def _weighted(name: str, weight: float):
    return F.transform(F.col(name), lambda x: F.struct(x.alias("term"), F.lit(weight).alias("w")))


def postings(index: DataFrame) -> DataFrame:
    """(term, seq, tf): weighted occurrences, combined before the shuffle."""
    return index.select("seq", F.explode_outer("toks").alias("t")).where("t is not null").groupBy("seq", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))


def index_stats(index: DataFrame) -> DataFrame:
    """n_docs, n_terms and avg_len of an index."""
    length = F.aggregate("toks", F.lit(0.0), lambda a, x: a + x["w"])
    docs = index.agg(F.count("*").alias("n_docs"), F.avg(length).alias("avg"))
    terms = postings(index).agg(F.count_distinct("term").alias("n_terms"))
    return docs.crossJoin(terms).select("n_docs", "n_terms", F.when(F.coalesce("avg", F.lit(0.0)) == 0, 1.0).otherwise(F.col("avg")).alias("avg_len"))


def search(index: DataFrame, query: Query | str, limit: int = 0) -> DataFrame:
    """seq, id, date, score and matched of the hits, best first: score, date, then id.

    One scan scores every entry against the few terms of the query, so no postings are shuffled:
    the only exchange is one row of statistics, and a limit keeps the best rows of each task.
    """
    query = parse_query(query) if isinstance(query, str) else query
    positive = [t.text for t in query.terms if not t.negated]
    wanted = [p for p in query.phrases if not p.negated]
    names = list(dict.fromkeys(t.text for t in query.terms))
    length = F.aggregate("toks", F.lit(0.0), lambda a, x: a + x["w"])

    def tf(term):
        return F.aggregate(F.filter("toks", lambda x: x["term"] == term), F.lit(0.0), lambda a, x: a + x["w"])

    facts = index.select("seq", "id", "date", length.alias("len"), *(tf(n).alias(f"tf{i}") for i, n in enumerate(names)), *(F.col("haystack").contains(f" {p.text} ").alias(f"p{i}") for i, p in enumerate(query.phrases)))
    stats = facts.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(names))))
    rows = facts.crossJoin(F.broadcast(stats))
    avg = F.when(F.col("avg") == 0, 1.0).otherwise(F.col("avg"))
    score, matched, some = F.lit(0.0), [], F.lit(False)
    for t in positive:
        i = names.index(t)
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / avg))).otherwise(0.0)
        matched.append(F.when(f > 0, F.lit(t)))
        some = some | (f > 0)
    for i, p in enumerate(query.phrases):
        if p in wanted:
            score = score + F.when(F.col(f"p{i}"), float(len(p.terms))).otherwise(0.0)
            matched.append(F.when(F.col(f"p{i}"), F.lit(p.text)))
            some = some | F.col(f"p{i}")
    keep = some
    for t in query.terms:
        f = F.col(f"tf{names.index(t.text)}")
        keep = keep & (f > 0) if t.required else keep & (f == 0) if t.negated else keep
    for i, p in enumerate(query.phrases):
        keep = keep & (~F.col(f"p{i}") if p.negated else F.col(f"p{i}"))
    names_ = F.array_sort(F.array_distinct(F.array_compact(F.array(*matched)))) if matched else F.array().cast("array<string>")
    out = rows.where(keep).select("seq", "id", "date", score.alias("score"), names_.alias("matched"))
    out = out.orderBy(F.col("score").desc(), F.col("date").desc_nulls_last(), "id")
    return out.limit(limit) if limit > 0 else out


def hits(entries: DataFrame, query: Query | str, limit: int = 0, markup: bool = True) -> DataFrame:
    """Entries that match, with score, matched and a snippet."""
    found = search(indexed(entries, markup), query, limit)
    body = plain_text(first_full("content", "summary")) if markup else first_full("content", "summary")
    joined = entries.drop("id").join(found, "seq")
    return joined.withColumn("snippet", snippet_text(body, F.col("matched"))).orderBy(F.col("score").desc(), F.col("date").desc_nulls_last(), "id")
