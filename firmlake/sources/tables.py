"""Schemas, readers and writers of the catalogue's tables, and the views that stand for them over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.functions.urls import safe_key, url_domain
from firmlake.sources.shared import bucketed, durable, place, scratch

_texts = T.ArrayType(T.StringType())
_partner = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "role", "linkedin_url", "twitter_url")] + [T.StructField("confidence", T.DoubleType())])
_company = T.StructType([T.StructField(n, T.StringType()) for n in ("company_name", "sector")])


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_s, _t = T.StringType(), T.TimestampType()
SCHEMAS = {
    "firms": _schema(id=T.LongType(), firm_name=_s, website=_s, source_url=_s, focus_sectors=_texts, investment_stage=_texts, geography=_texts, embedding=T.ArrayType(T.FloatType()), created_at=T.TimestampNTZType(), updated_at=T.TimestampNTZType()),
    "partners": _schema(id=T.LongType(), firm_id=T.LongType(), name=_s, role=_s, linkedin_url=_s, twitter_url=_s),
    "portfolio": _schema(id=T.LongType(), firm_id=T.LongType(), company_name=_s, sector=_s),
    "crawled_urls": _schema(url=_s, discovered_query=_s, crawl_status=_s, markdown_saved=T.BooleanType(), updated_at=_t),
    "crawl_queue": _schema(id=T.LongType(), url=_s, priority_score=T.DoubleType(), discovered_at=_t, status=_s, last_crawled=_t),
    "failed_urls": _schema(id=T.LongType(), url=_s, error_message=_s, retry_count=T.IntegerType(), last_attempt=_t, status=_s),
    "hits": _schema(query=_s, page=T.IntegerType(), rank=T.LongType(), url=_s, title=_s, content=_s),
    "sidecars": _schema(url=_s, ingestion_source=_s, content_type=_s, markdown_length=T.LongType(), collected_at=_s),
    "records": _schema(firm_name=_s, website=_s, source_url=_s, focus_sectors=_texts, investment_stage=_texts, geography=_texts, partners=T.ArrayType(_partner), portfolio_companies=T.ArrayType(_company)),
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of the stored tables, with its schema fixed rather than inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, stem, markdown) of all Markdown files of a folder, one row a file."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return raw.select(F.col("_metadata.file_name").alias("file_name"), F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("stem"), F.col("value").alias("markdown"))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata files by stem; ``valid`` is false where a file is not JSON."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    parsed = F.from_json("value", SCHEMAS["sidecars"], {"mode": "PERMISSIVE"})
    found = raw.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("stem"), parsed.alias("m"), F.try_parse_json("value").isNotNull().alias("valid"))
    return found.select("stem", "m.*", "valid")


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, response): stored model output, one row a file, left as text."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return raw.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("response"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line_no, value): lines in file order, numbered from 0; blank ones count but are left out.

    Spark cuts large files by bytes, and a task reads the lines of a cut in order. Their place in the task numbers them
    inside the cut; how many lines the cuts of a file have is counted in a pass of its own and added up. So no task reads
    more than a cut, and no line is shuffled: the counts are broadcast, one for each cut, of which the driver holds a list
    anyway when it plans the scan. Files must not change in between; a line outside its cut's count is an error.
    """
    raw = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("cut"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    )
    cuts = raw.groupBy("path", "cut").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("path").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    cuts = spark.createDataFrame(cuts.collect(), "path string, cut long, n long, first long, before long")
    inside = F.col("place") - F.col("first")
    known = F.when((inside >= 0) & (inside < F.col("n")), F.col("before") + inside).otherwise(F.raise_error(F.lit("a log file changed while it was read")).cast("long"))
    return raw.join(F.broadcast(cuts), ["path", "cut"]).select("file_name", known.alias("line_no"), "value").where("value <> ''")


def write_new(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), format: str = "parquet") -> None:
    """Writes a new snapshot; never onto a path that is being read."""
    df.write.mode("errorifexists").format(format).partitionBy(*partition_by).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow_items(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    out = li.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return out.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        "o_custkey", "p_partkey", "p_name", "p_type", "s_suppkey", "s_name", "o_orderpriority", "l_shipdate"
    )


ITEMS = ("o_custkey", "p_partkey", "p_name", "p_type", "s_suppkey", "o_orderpriority", "l_shipdate")
#: Lines up to which all joins run in one query: their shuffle files are small.
FEW_LINES = 2_000_000


def stored_items(spark: SparkSession, d: str, columns: tuple[str, ...] = ITEMS, few: int = FEW_LINES) -> DataFrame:
    """``columns`` of ``narrow_items`` as a table in buckets of customers, from which firms, partners and companies are read
    without a shuffle. Names of suppliers are joined where they are shown.

    Of more than ``few`` lines each join is written to a table, so that the shuffle files of only one lie on disk at once.
    """
    path, li = place(spark), table(spark, d, "lineitem")
    kept = durable if li.count() > few else lambda df, at=None: df
    with scratch(spark):
        at = place(spark)
        with scratch(spark):  # lines with their customer go when those with their part stand
            known = li.withColumnRenamed("l_suppkey", "s_suppkey").join(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "left_semi")
            placed = known.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            placed = kept(placed.select("l_partkey", *[c for c in placed.columns if c in columns]))
            named = kept(placed.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(*columns), at)
        return bucketed(named, "o_custkey", path)


def firms(spark: SparkSession, d: str, vectors: bool = True, items: DataFrame | None = None) -> DataFrame:
    """One firm for each customer; vectors are those of ``embeddings``, by number. ``items``: those of ``stored_items``, where they
    stand; without l_shipdate, updated_at is null."""
    items = narrow_items(spark, d) if items is None else items
    stamp = F.max("l_shipdate" if "l_shipdate" in items.columns else F.lit(None).cast("timestamp"))
    facets = items.groupBy("o_custkey").agg(
        F.sort_array(F.collect_set("p_type")).alias("focus_sectors"), F.sort_array(F.collect_set("o_orderpriority")).alias("investment_stage"), stamp.alias("updated_at"),
    )
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.array().cast("array<string>")
    out = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).join(facets, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = out.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("firm_name"),
        F.concat(F.lit("https://www.firm-"), (F.col("c_custkey") % 100).cast("string"), F.lit(".example.com/")).alias("website"),
        F.coalesce("focus_sectors", none).alias("focus_sectors"), F.coalesce("investment_stage", none).alias("investment_stage"),
        F.array("n_name", "r_name").alias("geography"), "updated_at",
    )
    if not vectors:
        return out
    e = table(spark, d, "embeddings")
    n = e.count()
    return out.withColumn("vec_id", F.col("id") % n).join(e.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def resolution_firms(spark: SparkSession, d: str) -> DataFrame:
    """One firm for each customer to find doubles among: made-up names of which two neighbours differ by an ending, sites
    that three share, and the vectors of ``embeddings``, by number."""
    e, k = table(spark, d, "embeddings"), F.col("c_custkey")
    letters = F.translate(F.substring(F.md5(F.floor(k / 2).cast("string")), 1, 18), "0123456789", "ghijklmnop")
    name = F.concat(F.substring(letters, 1, 8), F.lit(" "), F.substring(letters, 9, 10), F.when(k % 2 == 1, "s").otherwise(""))
    site = F.concat(F.lit("https://www."), F.substring(F.md5(F.floor(k / 3).cast("string")), 1, 12), F.lit(".example.com/"))
    firms = table(spark, d, "customer").select(k.alias("id"), name.alias("firm_name"), site.alias("website"), (k % e.count()).alias("vec_id"))
    return firms.join(e.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def partners(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    if items is None:
        found = narrow_items(spark, d).select("o_custkey", "s_suppkey", "s_name")
    else:
        found = items.select("o_custkey", "s_suppkey").distinct().join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return found.select(F.col("o_custkey").alias("firm_id"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).distinct().withColumns({
        "role": F.when(F.col("id") % 3 == 0, "GP").when(F.col("id") % 3 == 1, ""), "linkedin_url": F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://linkedin.com/in/s"), F.col("id").cast("string"))),
        "twitter_url": F.when(F.col("id") % 5 == 0, " ").otherwise(""),
    })


def portfolio(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    return (narrow_items(spark, d) if items is None else items).select(F.col("o_custkey").alias("firm_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("company_name"), F.col("p_type").alias("sector")).distinct()


def hits(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    return table(spark, d, "pages").select((p % 7).alias("query"), (p % 3 + 1).alias("page"), p.alias("rank"), "url")


def failures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.groupBy(F.col("user_id").alias("url")).agg(
        F.count("*").alias("retry_count"), F.max_by("value", F.struct("ts", "event_id")).alias("error_message"), F.max("ts").alias("last_attempt"),
    ).withColumn("status", F.lit("pending"))


def queue(spark: SparkSession, d: str) -> DataFrame:
    last = F.struct("ts", "event_id")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("url")).agg(
        F.max_by("event_type", last).alias("kind"), F.max_by("value", last).alias("priority_score"), F.min("ts").alias("discovered_at"),
    )
    return e.withColumn("status", F.when(F.col("kind") == "purchase", "completed").when(F.col("kind") == "error", "failed").otherwise("pending")).drop("kind")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    return table(spark, d, "events").select(F.col("event_id").alias("line_no"), F.concat(level, F.lit(" user="), F.col("user_id").cast("string")).alias("value"))


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the columns and types of a stored table; columns that it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def raw_pages(pages: DataFrame, collected_at, source: str = "web_crawl", kind: str = "text/markdown") -> DataFrame:
    """Pages (url, markdown) as they are stored: a file-safe name, the text, and the metadata that stands beside it.

    Later steps check the provenance of a record against these columns. Pages without a URL are left out.
    """
    text = F.coalesce("markdown", F.lit(""))
    return pages.where(F.trim(F.coalesce("url", F.lit(""))) != "").select(
        safe_key(F.col("url")).alias("stem"), "url", text.alias("markdown"), F.lit(source).alias("ingestion_source"), F.lit(kind).alias("content_type"),
        F.length(text).cast("long").alias("markdown_length"), collected_at.alias("collected_at"), url_domain(F.col("url")).alias("domain"),
    )


def write_raw_pages(pages: DataFrame, path: str, collected_at) -> None:
    """Stores ``raw_pages`` by source, so that a later batch adds files and rewrites none."""
    raw_pages(pages, collected_at).write.mode("append").partitionBy("ingestion_source").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Parsed records as JSON lines, one folder for each domain of their source."""
    records.withColumn("domain", url_domain(F.col("source_url"))).repartition("domain").write.mode("errorifexists").partitionBy("domain").json(path)


def read_records(spark: SparkSession, path: str, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of stored records, one to a line or to a file: records with their file's name and the types of the
    schema, and for what is no record its file, the reason and the text."""
    raw = spark.read.text(path, wholetext=whole_files).select(F.col("_metadata.file_name").alias("file_name"), "value").where(F.trim("value") != "")
    shape = T.StructType([*SCHEMAS["records"].fields, T.StructField("_bad", T.StringType())])
    read = raw.withColumn("r", F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    reason = F.when(F.try_parse_json("value").isNull(), "not_json").when(F.col("r._bad").isNotNull(), "not_a_record")
    read = read.withColumn("reason", reason)
    good = read.where("reason is null").select("file_name", *[F.col(f"r.{c}").alias(c) for c in SCHEMAS["records"].names])
    return good, read.where("reason is not null").select("file_name", "reason", "value")
