"""Dates of feeds, as text to UTC timestamps, in native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone abbreviations and their offsets in hours.
ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
    "BST": 1, "IST": 1, "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "JST": 9, "KST": 9, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
}
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
TIME = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:\.\d+)?)?"
DAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
#: Shapes of a date, its groups for year, month, day, hour, minute and second (0: none).
SHAPES = (
    (rf"^(\d{{4}})-(\d\d)-(\d\d)(?:[T ]{TIME})?$", (1, 2, 3, 4, 5, 6)),
    (rf"^(\d\d)/(\d\d)/(\d{{4}})(?: {TIME})?$", (3, 1, 2, 4, 5, 6)),
    (rf"^(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}|\d\d) {TIME}$", (3, 2, 1, 4, 5, 6)),
    (rf"^([A-Za-z]{{3,9}}) (\d{{1,2}}), (\d{{4}})(?: {TIME})?$", (3, 1, 2, 4, 5, 6)),
    (rf"^([A-Za-z]{{3}}) (\d{{1,2}}) {TIME} (?:[+-]\d\d:?\d\d )?(\d{{4}})$", (6, 1, 2, 3, 4, 5)),
)


def cleaned_date(raw: Column) -> Column:
    """White space collapsed, a last bracket dropped, UT and a lone Z spelled as usual."""
    x = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s*\([^)]*\)\s*$", "")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(x, " UT$", " UTC"), " Z$", "Z")


def parsed_date(raw: Column) -> Column:
    """The UTC time of a feed's date; null where no known shape fits. Unknown zone names count as UTC."""
    x = F.regexp_replace(cleaned_date(raw), DAY, "")
    numeric = F.regexp_extract(x, r"(?:[\s\d])([+-]\d\d:?\d\d)(?: \d{4})?$", 1)
    numeric = F.when(x.rlike(r"\d:\d\d|\d [+-]"), numeric).otherwise("")
    named = F.upper(F.regexp_extract(x, r"(?i)\d\s?([a-z]{1,5})$", 1))
    body = F.regexp_replace(x, r"\s?[+-]\d\d:?\d\d$", "")
    body = F.trim(F.regexp_replace(F.when(numeric != "", body).otherwise(x), r"(?i)(?<=\d)\s?[a-z]{1,5}$", ""))
    hours = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in ZONES.items() for v in kv)), named), F.lit(0))
    digits = F.regexp_replace(numeric, "[+:-]", "")
    offset = F.when(numeric != "", F.when(numeric.startswith("-"), -1).otherwise(1) * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60)).otherwise(hours * 3600)
    found = []
    for shape, groups in SHAPES:
        year, month, day, hour, minute, second = (F.regexp_extract(body, shape, g) for g in groups)
        year = F.when(F.length(year) == 2, F.concat(F.when(year >= "69", "19").otherwise("20"), year)).otherwise(year)
        number = ((F.position(F.initcap(F.substring(month, 1, 3)), F.lit(MONTHS)) + 2) / 3).cast("int").cast("string") if "A-Za-z" in shape else month
        pad = lambda c: F.lpad(F.when(c == "", "0").otherwise(c), 2, "0")
        text = F.concat_ws(" ", F.concat_ws("-", year, pad(number), pad(day)), F.concat_ws(":", pad(hour), pad(minute), pad(second)))
        found.append(F.when(body.rlike(shape), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))))
    at = F.coalesce(*found)
    return F.timestamp_seconds(F.unix_timestamp(at) - offset)
