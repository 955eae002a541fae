"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once a document: the ledger holds its measurements and one failure bit a
rule.  A policy is a named, versioned mask of the bits that reject; verdicts, comparisons of policy
versions and ablations are bitwise operations on the ledger and never read the texts again.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words.  Rows are judged one by one,
so repeated rows get equal verdicts; texts of any length are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, free_names, let, native_words, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements is true."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """The rules that reject, by name, under a version."""

    version: str
    rules: tuple[str, ...]


#: The order fixes the bits; new rules go to the end, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
#: The default policy.
V1 = Policy("v1", tuple(r.name for r in RULES))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words of an array inside windows of ``width`` words (a power of two) that occur twice or more in it.

    Windows are compared by their 64-bit hashes.  Most texts have no repeats and stop at the count
    of distinct ones; else hashes are sorted with their places and neighbours compared.
    """
    zero = F.lit(0).cast("long")

    def joined(hashes, step):
        return let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))

    def hashes(w):
        # Hashes of 2, 4, ... words, each of two halves: a window costs log2(width) hashes of two values.
        done = w
        for b in range(width.bit_length() - 1):
            done = joined(done, 1 << b)
        return let(done, lambda h: F.slice(h, 1, F.size(h) - width + 1))

    def places(h):
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(t):
            # A place repeats if a neighbour in the sorted order has the same hash.
            same = lambda x, k: F.coalesce(F.get(t, k)["h"] == x["h"], F.lit(False))
            marked = F.transform(t, lambda x, k: F.struct(x["i"].alias("i"), (same(x, k - 1) | same(x, k + 1)).alias("twin")))
            return F.sort_array(F.transform(F.filter(marked, lambda x: x["twin"]), lambda x: x["i"]))

        return let(tagged, twins)

    def covered(p):
        steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.try_element_at(p, k + 2) - x, F.lit(width))))
        return F.aggregate(steps, zero, lambda a, x: a + x)

    def counted(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(places(h), covered))

    return F.when(F.size(words) < width + 1, zero).otherwise(let(words, lambda w: let(hashes(w), counted)))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements; its own columns of their names are replaced, all others stay."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"))
    words = lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("rep"))
    l, w = free_names(docs, "__l", "__w")
    out = docs.withColumns({l: let(lines, both), w: let(native_words(text), words)})
    return out.withColumns(
        {
            "n_words": F.col(f"{w}.n"),
            "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.col(f"{l}.n"),
            "n_dup_lines": F.col(f"{l}.dup"),
            "n_repeat_words": F.col(f"{w}.rep"),
        }
    ).drop(l, w)


def mask(policy: Policy, rules=RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(n) for n in policy.rules)


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with the measurements and failed, the bits of the rules that fail; no rule runs twice."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules")
    bits = [F.when(F.expr(r.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs).withColumn("failed", failed)


def rejected(policy: Policy, rules=RULES) -> Column:
    """Whether ``policy`` rejects a ledger row."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) != 0


def judged(book: DataFrame, *policies: Policy, rules=RULES) -> DataFrame:
    """A ledger with one verdict column kept_<version> a policy."""
    return book.withColumns({f"kept_{p.version}": ~rejected(p, rules) for p in policies})


def ablation(book: DataFrame, policy: Policy, rules=RULES) -> DataFrame:
    """Per rule of ``policy``: rows that fail it, fail only it, and are kept if it is left out.

    Rows are first counted by their failure bits (at most 2^rules groups, combined before the
    shuffle), and all figures come from those counts.
    """
    whole = mask(policy, rules)
    names = [r.name for r in rules]
    counts = book.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in policy.rules)))
    rows = counts.select("bits", "n", listed.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rows.groupBy("rule").agg(total(hit).alias("fails"), total(hit & rest).alias("fails_only_it"), total(rest).alias("kept_without"))


def accepted(docs: DataFrame, policy: Policy = V1) -> DataFrame:
    """The rows that ``policy`` keeps, with the columns of ``docs``."""
    book = ledger(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text")))
    return book.where(~rejected(policy)).select("__row.*")
