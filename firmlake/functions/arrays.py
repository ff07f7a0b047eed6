"""Array and vector expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmlake.functions.urls import let


def keyed_distinct(array: Column, key: Callable[[Column], Column], keep: str = "first") -> Column:
    """One element for each key, where its key first stands: the first one, or ("last") the last one's value."""
    def of(a: Column, keys: Column) -> Column:
        first = F.filter(a, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        if keep == "first":
            return first
        back_keys = F.reverse(keys)
        return let(F.reverse(a), lambda back: F.transform(first, lambda x: F.get(back, F.array_position(back_keys, key(x)).cast("int") - 1)))

    # an array and its keys are worked out once, not again for each element
    return let(array, lambda a: let(F.transform(a, key), lambda keys: of(a, keys)))


def text_key(x: Column) -> Column:
    return F.lower(F.trim(x))


def union_exact(a: Column, b: Column) -> Column:
    """Ordered union without blanks, elements of ``a`` first."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(a, none), F.coalesce(b, none)), lambda x: x.isNotNull() & (F.trim(x) != "")))


def union_any_case(a: Column, b: Column) -> Column:
    """Ordered union that takes spellings of different case as one and keeps the first."""
    none = F.array().cast("array<string>")
    both = F.filter(F.concat(F.coalesce(a, none), F.coalesce(b, none)), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return keyed_distinct(both, text_key)


def fill(a: Column, b: Column) -> Column:
    """``a`` unless it is blank, else ``b``."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero or null vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def embedding_text(*parts: Column) -> Column:
    """Parts joined by single blanks; blank parts keep their blank."""
    cells = [F.coalesce(p, F.lit("")) for p in parts]
    return F.concat(*[c for i, p in enumerate(cells) for c in ((F.lit(" "), p) if i else (p,))])


def profile_text(firm: str = "firm_name", lists: tuple[str, ...] = ("focus_sectors", "investment_stage", "geography")) -> Column:
    """The text of a firm's profile that is embedded when only its focus is known: name and lists."""
    return embedding_text(F.col(firm), *[F.array_join(c, " ") for c in lists])


def resolver_text(firm: str = "firm_name", website: str = "website", lists: tuple[str, ...] = ("focus_sectors", "investment_stage")) -> Column:
    """The text by which two firms are compared: name, website, sectors and stages."""
    return embedding_text(F.col(firm), F.col(website), *[F.array_join(c, " ") for c in lists])
