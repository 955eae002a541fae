"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents() -> list[tuple]:
    a, b, c = prose(1, 120), prose(2, 200), prose(3, 60)
    words = b.split(" ")
    near = " ".join([*words[:100], "changed", *words[101:]])
    texts = [a, a, b, near, a.upper(), None, "", "   \n\t ", "one two three", "one two three", c + "\n" + c, c + "\nshort\n" + a, prose(4, 20_000), "ä ö ü 漢字 😀 " + b[:300], "aaaa" * 200, "line one here\n" * 40, "x" * 5000, "# * $ % & | < >", c[:150] + " " + a[:250]]
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", i) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, a, None, None, None), (None, "nobody knows this one text", None, "s1", None), (7, "a second text with the id seven", "en", "s2", 1)]
    return rows


CLASHING = ["size", "shard", "slot", "fp", "h", "c", "d", "t", "p", "g", "row", "key", "block", "n", "failed", "n_words", "kept", "ordinal", "part", "component", "target", "line", "spans", "items", "place", "copies", "copy", "__row", "__key", "__copy", "__h", "__d", "__part", "__n", "__f", "__t", "__gone", "__l", "__w", "__text", "__rows", "text_hash", "keys", "marks", "mark"]


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({x: F.lit(i) for i, x in enumerate(CLASHING)})
