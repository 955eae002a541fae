"""URL canonicalisation in native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that name a campaign, not a document.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_name", "utm_reader", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source", "cmpid", "at_medium", "at_campaign")
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _escaped(x: Column) -> Column:
    """Percent-escapes as in a query: a space is +, letters, digits and -_.~ stay."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column) -> Column:
    """Pairs by key, in their order within a key, with canonical escapes; malformed and campaign pairs go.

    A query without any well-formed pair stays as it is.
    """
    key = lambda p: F.try_url_decode(F.substring_index(p, "=", 1))
    value = lambda p: F.try_url_decode(F.when(p.contains("="), F.substr(p, F.locate("=", p) + 1)).otherwise(""))
    whole = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.contains(";"))
    read = F.transform(whole, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), value(p).alias("v")))
    fit = F.filter(read, lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    kept = F.array_sort(F.filter(fit, lambda x: ~F.lower(x["k"]).isin(*TRACKING)))
    text = F.array_join(F.transform(kept, lambda x: F.concat(_escaped(x["k"]), F.lit("="), _escaped(x["v"]))), "&")
    return F.when(F.size(fit) == 0, query).otherwise(text)


def normalized_url(url: Column) -> Column:
    """https for http, lower-case host without www. and default port, no fragment, campaign keys or last slash, keys sorted."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(raw, PARTS, i)
    scheme = F.regexp_replace(F.lower(part(1)), "^http$", "https")
    host = F.regexp_replace(F.lower(part(3)), r"^www\.", "")
    host = F.when(scheme == "https", F.regexp_replace(host, ":(443|80)$", "")).otherwise(host)
    path = F.regexp_replace(part(4), "/$", "")
    query = canonical_query(part(5))
    user = F.when(part(2) != "", F.concat(part(2), F.lit("@"))).otherwise("")
    bare = F.concat(scheme, F.lit("://"), host)
    full = F.concat(scheme, F.lit("://"), user, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    known = F.when((path == "") & (query == ""), bare).otherwise(full)
    return F.when(raw.rlike(PARTS), known).otherwise(F.lower(raw))
