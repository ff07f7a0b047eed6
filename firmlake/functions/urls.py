"""URL hygiene as column expressions.

A canonical URL has scheme https, a lower-case host without one leading ``www.``, no closing slashes, no fragment and
no path parameters; path and query keep their case. Blank and null URLs are "".
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.functions import rules

HTTP = r"^https?://"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it; keeps nested rules small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(rule: Callable[..., Column]) -> Callable[..., Column]:
    """A rule whose first argument is worked out once."""
    @wraps(rule)
    def bound(value: Column, *args, **kwargs) -> Column:
        return let(value, lambda x: rule(x, *args, **kwargs))

    return bound


def stripped(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", "")


def _path(url: Column) -> Column:
    """Path of an http(s) URL; parameters of its last segment are no part of it."""
    return F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")


def canonical_url(url: Column) -> Column:
    return let(stripped(url), lambda u: F.when(u == "", F.lit("")).otherwise(_canonical(F.regexp_replace(u, "^(?!https?://)", "https://"))))


@once
def _canonical(full: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(full, r"^https?://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(_path(full), "/+$", "")
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    return F.concat(F.lit("https://"), host, path, F.regexp_replace(query, "^(?=.)", "?"))


def url_domain(url: Column) -> Column:
    """Host of the canonical URL; port and user information stay."""
    return F.regexp_replace(F.regexp_extract(canonical_url(url), r"^https://([^/?#]*)", 1), r"^www\.", "")


@once
def url_base(url: Column) -> Column:
    """``https://host`` of the canonical URL, "" if there is no host."""
    return F.regexp_replace(F.regexp_extract(canonical_url(url), r"^https://([^/?#]*)", 1), "^(?=.)", "https://")


@once
def raw_base(url: Column) -> Column:
    """``scheme://host`` of the trimmed URL as it stands, host in lower case; "" if there is none."""
    scheme = F.lower(F.regexp_extract(stripped(url), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(stripped(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host)).otherwise(F.lit(""))


def any_pattern(words) -> str:
    """A pattern that finds any of some literal texts."""
    return "|".join(re.escape(w) for w in words)


def has_any(text: Column, words) -> Column:
    """Whether a text holds any of ``words``: one scan and one copy of the expression, however many words."""
    return text.rlike(any_pattern(words)) if words else F.lit(False)


@once
def url_reject_reason(url: Column, domains=rules.REJECTED_DOMAINS, paths=rules.REJECTED_PATHS, endings=rules.REJECTED_ENDINGS, mode: str = "substring") -> Column:
    """blank, scheme, no_domain, blocked_domain, blocked_path, blocked_type or ok.

    ``mode``: a blocked domain counts anywhere in the host ("substring"), or only as the host or its parent ("suffix").
    """
    inside = any_pattern(domains) if mode == "substring" else rf"(?:^|\.)(?:{any_pattern(domains)})$"
    return let(F.lower(stripped(url)), lambda low: let(url_domain(url), lambda domain: (
        F.when(low == "", "blank").when(~low.rlike(HTTP), "scheme").when(domain == "", "no_domain").when(domain.rlike(inside), "blocked_domain")
        .when(_path(low).rlike("(?i)" + "|".join(paths)), "blocked_path").when(low.rlike(f"(?:{any_pattern(endings)})$"), "blocked_type").otherwise("ok")
    )))


def is_rejected_url(url: Column, **rules_) -> Column:
    return url_reject_reason(url, **rules_) != "ok"


@once
def is_profile_url(url: Column, signals=rules.PROFILE_SIGNALS) -> Column:
    """Not rejected, and: a telling path, a ``.vc`` host, or at most one slash inside the path."""
    low = F.lower(F.coalesce(url, F.lit("")))
    inner = F.regexp_replace(_path(F.lower(stripped(url))), "^/+|/+$", "")
    telling = has_any(low, signals) | url_domain(url).endswith(".vc")
    return ~is_rejected_url(url) & (telling | (F.regexp_count(inner, F.lit("/")) <= 1))


@once
def is_firm_site(url: Column) -> Column:
    """A crawlable site: not rejected once canonical, with a dotted host that is not this machine."""
    return let(canonical_url(url), lambda c: let(url_domain(c), lambda d: (c != "") & ~is_rejected_url(c) & d.contains(".") & ~d.isin("localhost", "127.0.0.1")))


@once
def path_depth(url: Column) -> Column:
    """0 for a root, else the number of path segments."""
    inner = F.regexp_replace(_path(stripped(url)), "^/+|/+$", "")
    return F.when(inner == "", 0).otherwise(F.regexp_count(inner, F.lit("/")) + 1)


def joined_url(base: Column, link: Column) -> Column:
    """``link`` resolved against ``base``: absolute, //host, /root or relative to the base's last folder."""
    scheme, host = F.regexp_extract(base, r"^(https?)://", 1), F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    folder = F.concat(host, F.when(_path(base) == "", F.lit("/")).otherwise(F.regexp_extract(_path(base), r"^(.*/)", 1)))
    relative = F.regexp_replace(F.regexp_replace(link, r"^(\./)+", ""), r"^\.$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), _without_dots(F.concat(host, link))).otherwise(_without_dots(F.concat(folder, relative)))
    )


def _without_dots(url: Column) -> Column:
    """The path's ``.`` parts go, and each ``..`` takes the part before it along; what would lead above the root goes."""
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    parts = F.split(path, "/")
    start = F.array().cast("array<string>")
    folded = F.aggregate(parts, start, lambda kept, x: F.when(x == ".", kept).when(x == "..", F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)).otherwise(F.concat(kept, F.array(x))))
    ends = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    clean = F.concat(F.regexp_extract(url, r"^(https?://[^/?#]*)", 1), F.array_join(folded, "/"), ends, F.regexp_extract(url, r"([?#].*)$", 1))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), clean).otherwise(url)


def safe_key(value: Column, most: int | None = 120) -> Column:
    out = F.regexp_replace(value, "[^a-zA-Z0-9]", "_")
    return F.substring(out, 1, most) if most else out


def url_hygiene(df: DataFrame, column: str) -> DataFrame:
    """``df`` with canonical, domain, base, reject_reason and profile of a URL column."""
    u = F.col(column)
    return df.withColumns({
        "canonical": canonical_url(u), "domain": url_domain(u), "base": url_base(u), "reject_reason": url_reject_reason(u), "profile": is_profile_url(u),
    })
