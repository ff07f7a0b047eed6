"""Parsed records: tolerant JSON, normal forms, taxonomies, recovery of sparse fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.functions import rules
from firmlake.functions.arrays import keyed_distinct, text_key
from firmlake.functions.urls import has_any, let, once

NONE = "array<string>"
LISTS = ("focus_sectors", "investment_stage", "geography")


def json_object(response: Column) -> Column:
    """The first { to the last } of a model's response as a VARIANT, code fences dropped; null if that is no JSON."""
    plain = F.replace(F.replace(response, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return F.try_parse_json(F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit("")))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


@once
def _items(v: Column) -> Column:
    """Elements of a list, or a scalar as the only one."""
    one = F.when(_kind(v) == "STRING", F.array(v))
    return F.coalesce(F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), one, F.array().cast("array<variant>"))


def _text(v: Column, path: str = "$") -> Column:
    return F.trim(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def text_list(v: Column) -> Column:
    """Trimmed non-blank texts of a string or list; an object counts as its name, company, firm or first value."""
    def one(x: Column) -> Column:
        first = F.try_variant_get(F.get(F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), F.lit(0)), "$", "string")
        named = F.coalesce(*[F.nullif(_text(x, f"$.{k}"), F.lit("")) for k in ("name", "company", "firm")], F.trim(first), F.lit(""))
        return F.when(_kind(x).startswith("OBJECT"), named).otherwise(_text(x))

    return F.filter(F.transform(_items(v), one), lambda t: t != "")


def partner_list(v: Column) -> Column:
    def one(x: Column) -> Column:
        return let(_kind(x).startswith("OBJECT"), lambda is_object: cells(x, is_object))

    def cells(x: Column, is_object: Column) -> Column:
        name = F.when(is_object, _text(x, "$.name")).otherwise(_text(x))
        rest = [F.when(is_object, _text(x, f"$.{k}")).otherwise("").alias(k) for k in ("role", "linkedin_url", "twitter_url")]
        return F.struct(name.alias("name"), *rest, F.coalesce(F.when(is_object, F.try_variant_get(x, "$.confidence", "double")), F.lit(0.85)).alias("confidence"))

    return F.transform(F.filter(_items(v), lambda x: _kind(x) != "VOID"), one)


def company_list(v: Column) -> Column:
    def one(x: Column) -> Column:
        return let(_kind(x).startswith("OBJECT"), lambda is_object: cells(x, is_object))

    def cells(x: Column, is_object: Column) -> Column:
        name = F.when(is_object, _text(x, "$.company_name")).otherwise(_text(x))
        return F.struct(name.alias("company_name"), F.when(is_object, _text(x, "$.sector")).otherwise("").alias("sector"))

    return F.filter(F.transform(F.filter(_items(v), lambda x: _kind(x) != "VOID"), one), lambda c: c.company_name != "")


def normalise_records(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of stored responses (source_url, response); rejects hold no JSON object."""
    v = F.col("v")
    field = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    parsed = responses.withColumn("v", json_object(F.col("response")))
    good = parsed.where("v is not null").select(
        "source_url", F.coalesce(F.get(text_list(field("firm_name")), F.lit(0)), F.lit("")).alias("firm_name"), _text(v, "$.website").alias("website"),
        *[F.array_distinct(text_list(field(k))).alias(k) for k in LISTS],
        keyed_distinct(F.filter(partner_list(field("partners")), lambda p: p["name"] != ""), lambda p: text_key(p["name"])).alias("partners"),
        keyed_distinct(company_list(field("portfolio_companies")), lambda c: text_key(c.company_name)).alias("portfolio_companies"),
    )
    return good, parsed.where("v is null").select("source_url", "response", F.lit("no_json_object").alias("reason"))


def _mapped(array: str, names: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    return F.array_distinct(F.transform(array, lambda x: F.coalesce(F.try_element_at(known, F.lower(F.trim(x))), x)))


def taxonomy_first(df: DataFrame) -> DataFrame:
    """Names of sectors, stages and places in their usual form; unknown ones stay; partners filtered by name."""
    out = df.withColumns({c: _mapped(c, m) for c, m in zip(LISTS, (rules.SECTOR_NAMES, rules.STAGE_NAMES, rules.PLACE_NAMES))})
    return out.withColumn("partners", named_partners(F.col("partners"))) if "partners" in df.columns else out


def taxonomy_second(df: DataFrame) -> DataFrame:
    """Stages mapped, unknown ones kept; sectors mapped to one or more, else by a word they hold, else dropped. Sorted."""
    known = F.create_map(*[x for k, v in rules.SECOND_SECTOR_NAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def sectors(x: Column) -> Column:
        k = F.lower(F.trim(x))
        guess = F.when(k.contains("voice"), F.array(F.lit("Voice AI"))).when(k.contains("ai"), F.array(F.lit("Artificial Intelligence")))
        guess = guess.when(k.contains("saas"), F.array(F.lit("SaaS"))).when(k.contains("b2b"), F.array(F.lit("B2B"))).otherwise(F.array().cast(NONE))
        return F.coalesce(F.try_element_at(known, k), guess)

    return df.withColumns({
        "investment_stage": F.array_sort(_mapped("investment_stage", rules.SECOND_STAGE_NAMES)),
        "focus_sectors": F.array_sort(F.array_distinct(F.flatten(F.transform("focus_sectors", sectors)))),
    })


def recover_sparse(df: DataFrame, markdown: str) -> DataFrame:
    """Fills empty sectors, stages and places from words of the page."""
    low = F.lower(F.coalesce(markdown, F.lit("")))

    def found(*options: tuple[tuple[str, ...], tuple[str, ...]]) -> Column:
        parts = [F.when(has_any(low, words), F.array(*map(F.lit, names))).otherwise(F.array().cast(NONE)) for words, names in options]
        return F.concat(*parts)

    fills = {
        "focus_sectors": found(
            (("artificial intelligence", "machine learning", "generative ai", "ai startup"), ("Artificial Intelligence",)),
            (("saas", "enterprise software", "workflow automation"), ("B2B", "SaaS")),
        ),
        "investment_stage": found((("early-stage", "early stage", "seed-stage", "seed investor"), ("Seed",)), (("series a",), ("Series A",))),
        "geography": found((("india",), ("India",)), (("united states", "usa"), ("United States",)), (("europe",), ("Europe",))),
    }
    return df.withColumns({c: F.when(F.size(c) == 0, f).otherwise(F.col(c)) for c, f in fills.items()})


def named_partners(partners: Column) -> Column:
    """Partners whose name is a plain ASCII name of three letters or more and no title or number; the first of each name."""
    def fine(p: Column) -> Column:
        n = F.trim(p.getField("name"))
        plain = n.rlike(r"^[a-zA-Z0-9'\-\.\s]+$") & n.rlike("[a-zA-Z]") & (F.length(n) >= 3)
        return plain & ~n.rlike(r"(?i)^Partner\s+\d+$") & ~F.lower(n).isin(*rules.ROLE_TITLES)

    kept = F.transform(F.filter(partners, fine), lambda p: p.withField("name", F.trim(p.getField("name"))))
    return keyed_distinct(kept, lambda p: F.lower(p.getField("name")))


def real_partners(partners: Column, least: float = 0.7) -> Column:
    """Partners that are people by name and sure enough; a missing confidence counts as 0.85."""
    def named(p: Column) -> Column:
        c = F.coalesce(p.getField("confidence"), F.lit(0.0))
        return p.withField("name", F.trim(F.coalesce(p.getField("name"), F.lit("")))).withField("confidence", F.when(c <= 0, 0.85).otherwise(c))

    def fine(p: Column) -> Column:
        n = p.getField("name")
        person = (F.length(n) >= 4) & ~n.rlike(r"(?i)^Partner\s+\d+$") & ~F.lower(n).isin(*rules.ROLE_TITLES) & n.rlike("[a-zA-Z]")
        return person & (n.rlike(r"\s") | (F.length(n) >= 5)) & (p.getField("confidence") >= least)

    return F.filter(F.transform(partners, named), fine)
