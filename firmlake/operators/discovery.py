"""Discovery: query universe, hits to queue, gates and priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlake.functions import rules
from firmlake.functions.urls import canonical_url, is_firm_site, is_profile_url, is_rejected_url, joined_url, let, once, url_base
from firmlake.operators.running import running_sums


def _list(spark: SparkSession, name: str, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def query_universe(spark: SparkSession) -> DataFrame:
    """Distinct discovery queries longer than 10 characters: six families of short rule lists, crossed."""
    s, g = _list(spark, "s", rules.SECTORS), _list(spark, "g", rules.STAGES)
    p, t, w = _list(spark, "p", rules.PLACES), _list(spark, "t", rules.THEMES), _list(spark, "w", rules.INVESTOR_TERMS)
    families = (
        (s.crossJoin(w), ("{s} {w}",)),
        (s.crossJoin(g), ("{s} {g} investors", "{s} {g} venture capital")),
        (s.crossJoin(p), ("{s} investors in {p}", "{s} venture capital firms in {p}", "{p} {s} startup investors")),
        (t, ("{t} investors", "{t} venture capital firms", "{t} startup investors", "{t} VC funds")),
        (s, rules.SECTOR_QUERIES),
        (s.crossJoin(t), ("{t} {s} investors", "{t} {s} venture capital")),
    )
    out = None
    for rows, templates in families:
        made = rows.select(F.explode(F.array(*[filled(x, rows.columns) for x in templates])).alias("query"))
        out = made if out is None else out.unionByName(made)
    return out.select(clean_query(F.col("query")).alias("query")).where("length(query) > 10").distinct()


def filled(template: str, names: list[str]) -> Column:
    """A template whose {name} parts are columns."""
    out = F.lit(template)
    for n in names:
        out = F.replace(out, F.lit("{" + n + "}"), F.col(n))
    return out


def clean_query(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, r"\s+", " "))


def facet_queries(universe: DataFrame, *facets: str) -> DataFrame:
    """Queries that hold all facets, or all queries when none does. The universe is a short list."""
    hit = F.lit(True)
    for f in facets:
        hit = hit & F.lower("query").contains(f.lower())
    any_hit = F.max(hit.cast("int")).over(Window.partitionBy())
    return universe.withColumn("hit", hit).withColumn("any", any_hit).where((F.col("any") == 0) | F.col("hit")).select("query")


def in_order(queries: DataFrame, most: int | None = None) -> DataFrame:
    """(position, query): the distinct queries in order of their text, from 1; in a trial run only the first ``most``."""
    out = running_sums(queries.select("query").distinct(), {"position": F.lit(1).cast("long")}, [F.col("query")])
    out = out.select((F.col("position") + 1).alias("position"), "query")
    return out if most is None else out.where(F.col("position") <= most)


def expand_themes(themes: DataFrame, expansions: dict[str, tuple[str, ...]] = rules.THEME_EXPANSIONS) -> DataFrame:
    """(theme, expanded): each theme with its synonyms and itself."""
    known = F.create_map(*[x for k, v in expansions.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.coalesce(F.try_element_at(known, F.col("theme")), F.array().cast("array<string>"))
    return themes.select("theme", F.explode(F.array_sort(F.array_distinct(F.concat(F.array("theme"), more)))).alias("expanded"))


def generate_queries(profiles: DataFrame) -> DataFrame:
    """(profile_id, query) by rule for profiles (profile_id, sector, stage, geography, theme; null or blank: not given)."""
    p = profiles.select("profile_id", *[F.trim(F.coalesce(c, F.lit(""))).alias(a) for c, a in (("sector", "s"), ("stage", "g"), ("geography", "p"), ("theme", "t"))])
    terms = list(rules.PROFILE_TERMS)

    def when(need: str, *templates: str) -> Column:
        some = F.array(*[filled(x, ["s", "g", "p", "t"]) for x in templates])
        ok = F.lit(True)
        for n in need:
            ok = ok & (F.col(n) != "")
        return F.when(ok, some).otherwise(F.array().cast("array<string>"))

    made = F.concat(
        when("s", *[f"{{s}} {t}" for t in terms]), when("t", *[f"{{t}} {t}" for t in terms]),
        when("sg", "{s} {g} investors", "{s} {g} venture capital"), when("sp", "{s} investors in {p}", "{p} {s} startup investors"),
        when("tp", "{t} investors in {p}", "{p} {t} startup investors"),
        when("sgp", "{g} {s} venture capital in {p}", "{g} {s} investors in {p}"), when("tg", "{t} {g} investors", "{t} {g} venture capital"),
    )
    known = F.create_map(*[x for k, v in rules.THEME_EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.filter(F.coalesce(F.try_element_at(known, F.col("t")), F.array().cast("array<string>")), lambda e: e != F.col("t"))
    wider = F.flatten(F.transform(more, lambda e: F.concat(
        F.array(*[F.concat(e, F.lit(" " + t)) for t in terms]),
        F.when(F.col("p") != "", F.array(F.concat(e, F.lit(" investors in "), F.col("p")))).otherwise(F.array().cast("array<string>")),
    )))
    every = F.concat(made, F.when(F.col("t") != "", wider).otherwise(F.array().cast("array<string>")))
    chosen = F.when(F.size(every) == 0, F.array(*map(F.lit, rules.FALLBACK_QUERIES))).otherwise(every)
    return p.select("profile_id", F.explode(F.array_distinct(F.transform(chosen, lambda q: F.trim(q)))).alias("query")).where("length(query) > 5")


def first_hit_per_site(hits: DataFrame) -> DataFrame:
    """The first hit of each site over all queries; hits without a site go."""
    w = Window.partitionBy("base_url").orderBy("query", "page", "rank", "url")
    return hits.withColumn("base_url", url_base(F.col("url"))).where("base_url <> ''").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def first_hit_per_url(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("query", "url").orderBy("page", "rank")
    return hits.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def until_nothing_new(hits: DataFrame) -> DataFrame:
    """Hits on the pages of a query before its first page without a URL that is new to the query."""
    w = Window.partitionBy("query", "url").orderBy("page", "rank")
    pages = hits.withColumn("new", (F.row_number().over(w) == 1).cast("int")).groupBy("query", "page").agg(F.sum("new").alias("new"))
    stop = pages.groupBy("query").agg(F.min(F.when(F.col("new") == 0, F.col("page"))).alias("stop"))
    return hits.join(stop, "query").where("stop is null or page < stop").drop("stop")


def relevance(df: DataFrame, confidence: str = "confidence", source_type: str = "source_type") -> DataFrame:
    """Normalised verdict: confidence as a number, is_relevant, tier, known source_type."""
    c = F.coalesce(F.expr(f"try_cast({confidence} as double)"), F.lit(0.0))
    t = F.lower(F.trim(F.coalesce(F.col(source_type).cast("string"), F.lit("investor_mention"))))
    out = df.withColumn("confidence", c).withColumn("source_type", F.when(t.isin(*rules.SOURCE_TYPES, "unknown"), t).otherwise("investor_mention"))
    tier = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").when(F.col("confidence") >= 0.4, "low").otherwise("reject")
    return out.withColumn("is_relevant", F.col("confidence") >= 0.4).withColumn("relevance_tier", tier)


def passes_prefilter(*parts: Column) -> Column:
    """Whether the joined text of a hit holds any word that speaks of investing: plain searches, which end at the first find."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return let(text, lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in rules.PREFILTER_WORDS]))


@once
def gate_reason(url: Column) -> Column:
    """Why a verdict (is_relevant, confidence, source_type) keeps its URL out of the queue, or ok."""
    c, t = F.col("confidence"), F.trim(F.coalesce("source_type", F.lit("unknown")))
    weak = (t == "investor_mention") & (c < rules.MENTION_CONFIDENCE) & ~is_profile_url(url)
    return (
        F.when(is_rejected_url(url), "rejected_url").when(~F.coalesce("is_relevant", F.lit(False)), "not_relevant").when(c < rules.MIN_CONFIDENCE, "low_confidence")
        .when(~t.isin(*rules.SOURCE_TYPES), F.concat(F.lit("source_type_"), t)).when(weak, "mention_not_profile_url").otherwise("ok")
    )


@once
def priority(url: Column, confidence: Column, source_type: Column) -> Column:
    low = F.lower(url)
    words = (("portfolio", 2.0), ("team", 2.0), ("partner", 2.0), ("people", 2.0), ("leadership", 2.0), ("about", 1.5), ("investor", 1.0), (".vc", 1.5))
    out = confidence + F.when(is_profile_url(url), 0.5).otherwise(0.0)
    for w, n in words:
        out = out + F.when(low.contains(w), n).otherwise(0.0)
    return out + F.when(source_type == "investor_profile", 1.0).otherwise(0.0)


def discover(hits: DataFrame, verdicts: DataFrame, crawled: DataFrame, queue: DataFrame, cutoff) -> DataFrame:
    """Hits to new queue rows (url, priority_score, gate_reason): canonical, not rejected, not recent, first of its site,
    judged and scored. Rows with a reason other than ok are kept for the record and are not queued."""
    from firmlake.operators.ledgers import not_recently_crawled

    found = hits.withColumn("url", canonical_url(F.col("url"))).where(~is_rejected_url(F.col("url")))
    firsts = first_hit_per_site(found).select(F.col("base_url").alias("url"), F.col("url").alias("found_url"), "query")
    open_ = not_recently_crawled(firsts, crawled, queue, cutoff)
    judged = relevance(open_.join(verdicts.withColumnRenamed("url", "found_url"), "found_url", "left"))
    return judged.select("url", "found_url", "query", priority(F.col("found_url"), F.col("confidence"), F.col("source_type")).alias("priority_score"), gate_reason(F.col("url")).alias("gate_reason"))


def team_page_candidates(sites: DataFrame, crawled: DataFrame, queue: DataFrame, paths=rules.TEAM_PATHS) -> DataFrame:
    """Team pages of crawlable sites (website) that were neither crawled nor queued."""
    base = sites.where(is_firm_site(F.col("website"))).select(url_base(F.col("website")).alias("base")).distinct()
    pages = base.select(F.explode(F.array(*[F.concat("base", F.lit(p)) for p in paths])).alias("url"))
    return pages.join(crawled.select("url").unionByName(queue.select("url")), "url", "left_anti")


def subpages(sites: DataFrame, column: str, paths=rules.SUBPAGES) -> DataFrame:
    """Fixed subpage URLs of every site, each once."""
    base = F.regexp_replace(F.col(column), "/+$", "")
    return sites.select(F.explode(F.array(*[joined_url(base, F.lit(p)) if p else base for p in paths])).alias("url")).distinct()
