"""The engine's text functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.functions import text

FUNCTIONS = {
    "html_to_text": text.plain_text,
    "summarize_text": text.summary_text,
    "text_snippet": text.snippet_text,
    "strip_markup": text.stripped,
    "body_words": text.body_words,
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql``: their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return list(FUNCTIONS)
