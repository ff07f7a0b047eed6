"""Faceted listings, firm details, counts and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.operators.search import facet_filter


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def paginate(df: DataFrame, page: int, size: int = 15) -> DataFrame:
    """Page ``page``, from 1, of a sorted table."""
    return df.offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 15) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def list_firms(firms: DataFrame, partners: DataFrame, companies: DataFrame, q: str | None = None, sector: str | None = None, stage: str | None = None,
               geography: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of firms, newest first, with the counts of their children; only the page's ids meet the child tables."""
    hits = firms.where(facet_filter(sector, stage, geography))
    if q:
        hits = hits.where(F.col("firm_name").ilike(f"%{q}%"))
    page = hits.drop("embedding").orderBy(F.desc_nulls_last("updated_at"), "firm_name", "id").offset(offset).limit(limit)
    ids = F.broadcast(page.select(F.col("id").alias("firm_id")))  # at most ``limit`` rows
    p = partners.join(ids, "firm_id", "left_semi").groupBy("firm_id").agg(F.count("*").alias("partner_count"))
    c = companies.join(ids, "firm_id", "left_semi").groupBy("firm_id").agg(
        F.count("*").alias("company_count"), F.transform(F.array_sort(F.collect_list(F.struct("id", "company_name"))), lambda x: x.company_name).alias("company_names")
    )
    out = page.join(p, page.id == p.firm_id, "left").drop("firm_id").join(c, page.id == c.firm_id, "left").drop("firm_id")
    return out.withColumns({
        "partner_count": F.coalesce("partner_count", F.lit(0)), "company_count": F.coalesce("company_count", F.lit(0)),
        "company_names": F.coalesce("company_names", F.array().cast("array<string>")), "updated_at": iso_utc(F.col("updated_at")),
    })


def list_children(child: DataFrame, firms: DataFrame, name_col: str, q: str | None = None, firm_id: int | None = None, firm: str | None = None,
                  limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of partners or companies by name, with their firm's name; ``firm`` asks for firms whose name holds it."""
    out = child
    if q:
        out = out.where(F.col(name_col).ilike(f"%{q}%"))
    if firm_id is not None:
        out = out.where(F.col("firm_id") == firm_id)
    names = firms.select(F.col("id").alias("firm_id"), "firm_name")
    if firm:
        out = out.join(names.where(F.col("firm_name").ilike(f"%{firm}%")), "firm_id")
    else:
        out = out.join(names, "firm_id", "left")
    return out.orderBy(name_col, "firm_id", "id").offset(offset).limit(limit)


def nest_children(firms: DataFrame, partners: DataFrame, companies: DataFrame) -> DataFrame:
    """Firms with arrays of their partners and companies; empty arrays where there are none."""
    p = partners.groupBy("firm_id").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("partners"))
    c = companies.groupBy("firm_id").agg(F.array_sort(F.collect_list(F.struct("id", "company_name", "sector"))).alias("companies"))
    out = firms.join(p, firms.id == p.firm_id, "left").drop("firm_id").join(c, firms.id == c.firm_id, "left").drop("firm_id")
    return out.withColumns({k: F.coalesce(k, F.array().cast(out.schema[k].dataType)) for k in ("partners", "companies")})


def firm_detail(firms: DataFrame, partners: DataFrame, companies: DataFrame, id: int) -> DataFrame:
    return nest_children(firms.where(F.col("id") == id), partners.where(F.col("firm_id") == id), companies.where(F.col("firm_id") == id))


def metrics(firms: DataFrame, partners: DataFrame, companies: DataFrame) -> DataFrame:
    """One row of table counts and the newest update."""
    a = firms.agg(F.count("*").alias("firms"), F.max("updated_at").alias("last_updated"))
    return a.crossJoin(partners.agg(F.count("*").alias("partners"))).crossJoin(companies.agg(F.count("*").alias("companies")))  # one row each


def distribution(firms: DataFrame, column: str, top: int) -> DataFrame:
    """The ``top`` most frequent elements of an array column."""
    one = firms.select(F.explode(column).alias("x")).select(F.trim("x").alias("value")).where("value <> ''")
    return one.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as text, for display."""
    return df.withColumns({c: F.array_join(c, ", ") for c in columns})
