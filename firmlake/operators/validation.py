"""Validation of parsed records with reject reasons, and where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.functions.arrays import keyed_distinct
from firmlake.functions.names import firm_name, matches_source, name_reject_reason, resolved_website
from firmlake.functions.urls import canonical_url, is_rejected_url


def sanitise(df: DataFrame) -> DataFrame:
    """Clean fields; of companies of one name the last value stands in the first one's place."""
    out = df.withColumn("firm_name", firm_name(F.col("firm_name"))).withColumn("website", resolved_website(F.col("website"), F.col("source_url")))
    out = out.withColumn("source_url", canonical_url(F.col("source_url")))
    none = F.array().cast("array<string>")
    for c in ("focus_sectors", "investment_stage", "geography"):
        out = out.withColumn(c, F.array_distinct(F.filter(F.transform(F.coalesce(c, none), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
    if "partners" in df.columns:
        out = out.withColumn("partners", F.transform("partners", lambda p: p.withField("confidence", F.coalesce(p.confidence, F.lit(0.85)))))
    if "portfolio_companies" in df.columns:
        named = F.filter(F.transform("portfolio_companies", lambda c: F.struct(F.trim(c.company_name).alias("company_name"), F.trim(F.coalesce(c.sector, F.lit(""))).alias("sector"))), lambda c: c.company_name != "")
        out = out.withColumn("portfolio_companies", keyed_distinct(named, lambda c: F.lower(c.company_name), "last"))
    return out


def record_reason(name: Column, source_url: Column, website: Column) -> Column:
    """missing_firm_name, rejected_firm_name, rejected_source_url, firm_domain_mismatch or ok, for clean fields."""
    some = F.coalesce(source_url, F.lit("")) != ""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "missing_firm_name").when(name_reject_reason(name) != "ok", "rejected_firm_name")
        .when(some & is_rejected_url(source_url), "rejected_source_url").when(some & ~matches_source(name, source_url, website), "firm_domain_mismatch").otherwise("ok")
    )


def validate_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with reason) of sanitised records."""
    out = sanitise(df).withColumn("reason", record_reason(F.col("firm_name"), F.col("source_url"), F.col("website")))
    return out.where("reason = 'ok'").drop("reason"), out.where("reason <> 'ok'")


def without_mocks(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    return df.where(~F.lower(file_name).contains("mock_investor"))


def provenance_reason(records: DataFrame, markdown_files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Adds ``provenance`` to records (file_name, source_url, ingestion_source, raw_markdown_file, raw_metadata_file).

    ``markdown_files`` (file_name) and ``sidecars`` (file_name, url, ingestion_source, valid) list what was stored.
    """
    some = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", F.col(c)).otherwise(other)
    out = records.withColumn("md", some("raw_markdown_file", F.regexp_replace("file_name", r"\.json$", ".md"))).withColumn("js", some("raw_metadata_file", F.col("file_name")))
    files = markdown_files.select(F.col("file_name").alias("md")).distinct().withColumn("has_md", F.lit(True))
    meta = sidecars.select(F.col("file_name").alias("js"), F.trim(F.coalesce("url", F.lit(""))).alias("m_url"), F.col("ingestion_source").alias("m_source"), F.col("valid").alias("m_valid")).withColumn("has_js", F.lit(True))
    out = out.join(files, "md", "left").join(meta, "js", "left")
    url = F.trim(F.coalesce("source_url", F.lit("")))
    reason = (
        F.when((url == "") | is_rejected_url(url), "missing_or_rejected_source_url")
        .when((F.coalesce("ingestion_source", F.lit("")) != "") & (F.col("ingestion_source") != "web_crawl"), "non_web_crawl_source")
        .when(F.col("has_md").isNull(), "missing_raw_markdown_file").when(F.col("has_js").isNull(), "missing_raw_metadata_file")
        .when(~F.col("m_valid"), "invalid_raw_metadata_file").when(F.col("m_url") != url, "source_url_metadata_mismatch")
        .when(F.col("m_source").isNotNull() & (F.col("m_source") != "web_crawl"), "metadata_not_web_crawl").otherwise("ok")
    )
    return out.withColumn("provenance", reason).drop("md", "js", "has_md", "has_js", "m_url", "m_source", "m_valid")
