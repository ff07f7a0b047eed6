"""Firm-name hygiene as column expressions. Null and blank names are ""."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.functions import rules
from firmlake.functions.urls import canonical_url, has_any, is_rejected_url, let, once, url_domain

LONGEST = 120
TAIL = r"(?i)\s*[-–|]\s*(team|portfolio|about|investors?|partners?|news|blog).*$"


def firm_name(name: Column) -> Column:
    """Trimmed, single-spaced, without outer quotes and punctuation and without a ``- team`` style tail."""
    n = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " ")
    n = F.regexp_replace(n, "^[ \"'.,;:-]+|[ \"'.,;:-]+$", "")
    return F.substring(F.regexp_replace(n, TAIL, ""), 1, LONGEST)


def _keyed(low: Column) -> Column:
    k = F.regexp_replace(low, "(?i)" + rules.LEGAL_WORDS, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(k, r"(?i)[^a-z0-9\s&\-\.']", ""), r"\s+", " "))


def firm_key(name: Column) -> Column:
    """Key for finding duplicates: lower case, legal words and odd characters dropped; may be empty."""
    return _keyed(F.lower(firm_name(name)))


@once
def name_reject_reason(name: Column, exact=rules.REJECTED_NAMES, parts=rules.REJECTED_NAME_PARTS) -> Column:
    """missing, short, brand, brand_part, url, long, list_title, no_letter or ok."""
    return let(firm_name(name), lambda n: let(F.lower(n), lambda low: (
        F.when(F.coalesce(name, F.lit("")) == "", "missing").when(F.length(n) < 2, "short").when(low.isin([x.lower() for x in exact]), "brand")
        .when(has_any(low, parts), "brand_part").when(low.rlike(r"https?://|www\.|\.com\b|\.org\b|\.io\b"), "url")
        .when(F.length(n) > 80, "long").when(low.rlike(r"\b(top|best|list of|how to|what is|guide to)\b"), "list_title")
        .when(~n.rlike("[a-zA-Z]"), "no_letter").otherwise("ok")
    )))


def brand_keys(exact=rules.REJECTED_NAMES) -> list[str]:
    """Keys of the rejected brands, worked out as ``firm_key`` would."""
    import re

    out = set()
    for n in exact:
        k = re.sub(rules.LEGAL_WORDS, " ", n.strip(" \"'.,;:-").lower(), flags=re.I)
        out.add(re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s&\-\.']", "", k)).strip())
    return sorted(out)


def matches_source(name: Column, source_url: Column, website: Column) -> Column:
    """False when a name is that of a publisher, or stands on an article page of an unrelated domain."""
    link = F.when(F.coalesce(source_url, F.lit("")) != "", source_url).otherwise(F.coalesce(website, F.lit("")))
    return let(firm_key(name), lambda key: let(link, lambda x: let(url_domain(x), lambda domain: _related(key, x, domain))))


def _related(key: Column, link: Column, domain: Column) -> Column:
    base = F.lower(F.split(domain, r"\.")[0])
    path = F.lower(F.regexp_extract(link, r"^https?://[^/?#]*([^?#]*)", 1))
    base_key = firm_key(F.replace(base, F.lit("-"), F.lit(" ")))
    related = let(base_key, lambda b: (b == "") | key.contains(b) | b.contains(key) | (F.split(key, " ")[0] == b))
    return (
        F.when(domain == "", True).when(is_rejected_url(link), False).when(key == "", False).when(key.isin(brand_keys()), False)
        .when(has_any(key, rules.REJECTED_NAME_PARTS), False).when(base.isin(list(rules.PUBLISHERS)), False)
        .when(has_any(path, rules.ARTICLE_PATHS) & ~related, False).otherwise(True)
    )


def resolved_website(website: Column, source_url: Column) -> Column:
    """The canonical website if it is not rejected, else the site of the source, else ""."""
    def chosen(w: Column, s: Column) -> Column:
        site = F.concat(F.lit("https://"), F.regexp_extract(s, r"^https://([^/?#]*)", 1))
        return F.when((w != "") & ~is_rejected_url(w), w).when((s != "") & ~is_rejected_url(s), site).otherwise(F.lit(""))

    return let(canonical_url(website), lambda w: let(canonical_url(source_url), lambda s: chosen(w, s)))


def resolver_name(text: Column) -> Column:
    """Name as pairwise resolution compares it."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for word in ("capital", "ventures", "venture partners", "partners", "vc", ",", "."):
        out = F.replace(out, F.lit(word), F.lit(""))
    return F.trim(F.replace(out, F.lit("-"), F.lit(" ")))


def name_hygiene(df: DataFrame, column: str) -> DataFrame:
    n = F.col(column)
    return df.withColumns({"firm_name_norm": firm_name(n), "firm_key": firm_key(n), "name_reason": name_reject_reason(n)})
