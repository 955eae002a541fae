"""Scalar functions against their expected values."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.dates import parsed_date
from millrace.functions.urls import normalized_url

URLS = [
    ("HTTPS://WWW.Shop.test:443/Aisle/9/?b=7&a=2&utm_source=mail#top", "https://shop.test/Aisle/9?a=2&b=7"), ("http://www.www.shop.test", "https://www.shop.test"), ("http://shop.test:80", "https://shop.test"), ("http://shop.test:8080/", "https://shop.test:8080"),
    ("https://u:p@shop.test/x", "https://u:p@shop.test/x"), ("https://u:p@shop.test", "https://shop.test"), ("ftp://shop.test:443/x/", "ftp://shop.test:443/x"), ("https://shop.test/?REF=9&Fbclid=1&q", "https://shop.test?q="),
    ("https://shop.test/s?q=two words&n=%7euser*", "https://shop.test/s?n=~user%2A&q=two+words"), ("https://shop.test/s?b=1;c&a=%zz&k=1+2", "https://shop.test/s?k=1+2"), ("https://shop.test/s?k=2&k=1&j=%c3%a4", "https://shop.test/s?j=%C3%A4&k=2&k=1"), ("https://shop.test/s?a;b", "https://shop.test/s?a;b"),
    ("  Shop Talk ", "shop talk"), ("mailto:Me@shop.test", "mailto:me@shop.test"), (" ", ""), (None, ""),
]


def dates():
    """Every shape of a date that feeds use, for one moment: 7 May 2019, 09:03:05 UTC."""
    zones = {"": 0, " +0200": 2, " GMT": 0, " EST": -5, " CEST": 2, " -0930": -9.5, " UT": 0, " XYZ": 0}
    for zone, hours in zones.items():
        at = datetime(2019, 5, 7, 9, 3, 5) + timedelta(hours=hours)
        for seconds in (True, False):
            want = datetime(2019, 5, 7, 9, 3, 5 if seconds else 0)
            clock = at.strftime("%H:%M:%S" if seconds else "%H:%M")
            for day in (f"{at.day:02}", f"{at.day}"):
                yield f"Tue, {day} May 2019 {clock}{zone}", want
                yield f"{day} May 2019 {clock}{zone}", want
            if zone:
                yield f"{at.day:02} May 19 {clock}{zone}", want
                yield f"Tue, {at.day:02} May 19 {clock}{zone}", want
            yield at.strftime("%Y-%m-%d ") + clock + zone, want
    for seconds in (":05", ":05.25", ""):
        want = datetime(2019, 5, 7, 9, 3, 5 if seconds else 0)
        for text in ("2019-05-07T09:03@Z", "2019-05-07T09:03@", "2019-05-07T11:03@+02:00", "2019-05-07T02:03@-0700", "2019-05-07T09:03@ Z"):
            yield text.replace("@", seconds), want
    midnight, full = datetime(2019, 5, 7), datetime(2019, 5, 7, 9, 3, 5)
    yield from ((x, midnight) for x in ("2019-05-07", "05/07/2019", "May 7, 2019", "  May   7,\t2019 "))
    yield from ((x, full) for x in ("05/07/2019 09:03:05", "May 7, 2019 11:03:05 CEST", "Tue May 7 09:03:05 2019", "Tue May 07 11:03:05 +0200 2019", "Tue, 07 May 2019 09:03:05 GMT (Greenwich)", "07 may 2019 09:03:05 gmt"))
    yield "01 Feb 68 10:00 GMT", datetime(2068, 2, 1, 10)
    yield "01 Feb 69 10:00 GMT", datetime(1969, 2, 1, 10)
    yield from ((x, None) for x in ("", " ", "in May", "7/5/19", "30 Feb 2019 10:00:00 GMT", "2019-05-07T25:00:00Z", "May 2019", None))


PLAIN = [
    ("soup &amp; bread", "soup & bread"), ("<div>First <i>course</i></div>", "First course"), ("<p>na&iuml;ve</p>", "naïve"), ("A<style>i{x:y}</style>B", "AB"), ("<header>Menu</header><h2>Soup</h2><aside>ad</aside>", "Soup"), ("<form><form>x</form>y</form>z", "z"),
    ("kept<svg><path>lost", "kept"), ("soup<br/>bread", "soup\nbread"), ("<h1>Soup</h1>hot<h2>Bread</h2>", "Soup\n\nhot\n\nBread"), ("<dl><dt>k<dd>v</dl>", "k\nv"), ("s<!-- <p> -->oup", "soup"), ("<![CDATA[1 < 2]]> yes", "1 < 2 yes"), ("<?xml version='1'?>soup", "soup"),
    ("<b title='a>b'>bold</b>", "bold"), ("2 < 3 > 1", "2 < 3 > 1"), ("<a:div>one</a:div><a:div>two</a:div>", "one\n\ntwo"), ("\t soup \n\n hot ", "soup hot"), ("", ""), ("<p> </p>", ""), ("soup<hr>bread", "soup\nbread"), ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>", "12\n3"),
]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_urls(spark):
    assert column(spark, [a for a, _ in URLS], normalized_url) == [b for _, b in URLS]


def test_dates(spark):
    cases = list(dates())
    got = column(spark, [a for a, _ in cases], parsed_date)
    assert [(a, g and g.replace(microsecond=0)) for (a, _), g in zip(cases, got, strict=True)] == cases


@pytest.mark.parametrize("html, want", PLAIN)
def test_plain(html, want):
    assert T.plain(html) == want


@pytest.mark.parametrize("text", ["<em", "x<", "<p title=", "<p title='", "y</", "<!-", "<!--z", "<![CDA", "<![CDATA[w", "<style>", "<nav><nav", "&amp", "&#x", "&#1114112;"])
def test_markup_that_ends_early(text):
    assert "\0" not in T.plain(text) and len(T.plain(text)) <= len(text)


def test_words(spark):
    texts = ["An Apple2 pie, and 3.14 slices of IT", "", None, "ÄÖ über 漢字 x²"]
    assert T.tokenize(texts[0]) == ["apple2", "pie", "3", "14", "slices"]
    assert column(spark, texts, lambda c: T.tokens(F.coalesce(c, F.lit("")))) == [T.tokenize(t or "") for t in texts]
    heads = ["  <em>Soup</em> no. 7: HOT! ", None, "--"]
    assert [T.normalize_title(t or "") for t in heads] == ["soup no 7 hot", "", ""]
    assert column(spark, heads, T.normalized_title) == ["soup no 7 hot", "", ""]
    assert T.content_words("<p>R&D lab</p> x&y") == ["r", "lab", "x"]
    assert T.content_words("cr&egrave;me <i>br&ucirc;l&eacute;e</i>") == ["crème", "brûlée"]
    assert T.decode_entities("&quot;&#66;&#x43;&odd;&#0;&quot;") == '"BC&odd;&#0;"'
    assert T.strip_tags("one<hr>&lt;two&gt;") == "one <two>"


def test_summaries():
    assert T.summarize("brief", 60) == "brief"
    assert T.summarize("Soup is hot today. Bread comes with it as long as there is some left.", 40) == "Soup is hot today."
    assert T.summarize("It costs 3. 50 pieces are left and nobody knows who wants them", 34) == "It costs 3. 50 pieces are left…"
    assert T.summarize("soup and bread and cheese, then coffee and cake", 30) == "soup and bread and cheese…"
    assert [T.minutes(n) for n in (-1, 0, 1, 200, 201)] == [0, 0, 1, 1, 2]
    long = "before " * 50 + "soup " + "after " * 70
    cut = T.snippet(long, ["soup"])
    assert "soup" in cut and cut[0] == cut[-1] == "…" and len(cut) <= 202
    assert T.snippet("tiny", ["q"]) == "tiny"


def test_functions_in_sql(spark):
    from millrace.functions import sql

    assert set(sql.register(spark)) == set(sql.FUNCTIONS)
    row = spark.sql("SELECT html_to_text('<p>a</p><p>b</p>') AS t, summarize_text('x y') AS s, body_words('<b>One</b> two') AS w, strip_markup('<i>z</i>') AS m, text_snippet('soup', array('soup')) AS n").first()
    assert tuple(row) == ("a\n\nb", "x y", ["one", "two"], "z", "soup")
