"""Entities: duplicate lookup, pairwise resolution, components, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlake.functions.arrays import cosine, embedding_text, fill, text_key, union_exact
from firmlake.functions.encoders import embed_text
from firmlake.functions.names import firm_key, resolver_name
from firmlake.functions.urls import url_domain
from firmlake.operators.graph import components
from firmlake.operators.similar import indel_ratio, similar_names, similar_vectors
from firmlake.sources.shared import bucketed, durable, tidy

FUZZY, SEMANTIC, COMBINED = 0.88, 0.82, 0.87
SCALARS = ("website", "source_url")
PARTNER_FIELDS, COMPANY_FIELDS = ("role", "linkedin_url", "twitter_url"), ("sector",)
LISTS = ("focus_sectors", "investment_stage", "geography")


def keyed(firms: DataFrame) -> DataFrame:
    """Adds name_key, firm_key and domain, worked out once."""
    return firms.withColumns({"name_key": F.lower("firm_name"), "firm_key": firm_key(F.col("firm_name")), "domain": url_domain(F.col("website"))})


def find_duplicates(incoming: DataFrame, firms: DataFrame) -> DataFrame:
    """Adds duplicate_id and tier to ``incoming`` (seq, firm_name, website, source_url): the smallest id of equal name, else
    of equal key, else of equal domain. The lookup sees the table as it stands, not the rest of the batch."""
    f = keyed(firms.select("id", "firm_name", "website"))
    site = F.when(F.coalesce("website", F.lit("")) != "", F.col("website")).otherwise(F.col("source_url"))
    out = incoming.withColumns({"name_key": F.lower("firm_name"), "firm_key": firm_key(F.col("firm_name")), "domain": url_domain(site)})
    for tier, key in enumerate(("name_key", "firm_key", "domain"), 1):
        ids = f.where(F.col(key) != "").groupBy(key).agg(F.min("id").alias(f"t{tier}"))
        out = out.join(ids, key, "left")
    known = F.coalesce("firm_name", F.lit("")) != ""
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3)
    return out.withColumn("duplicate_id", F.when(known, F.coalesce("t1", "t2", "t3"))).withColumn("tier", F.when(known, tier)).drop("t1", "t2", "t3")


def session_firsts(df: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each firm key; rows with an empty key count as duplicates."""
    w = Window.partitionBy("firm_key").orderBy(order)
    return df.withColumn("firm_key", firm_key(F.col("firm_name"))).where("firm_key <> ''").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def _verdict(df: DataFrame) -> DataFrame:
    """Adds same_entity, confidence, method by fuzzy, semantic and by_domain."""
    out = df.withColumn("combined", 0.4 * F.col("fuzzy") + 0.6 * F.col("semantic"))
    same = F.col("by_domain") | (F.col("fuzzy") >= FUZZY) | (F.col("semantic") >= SEMANTIC) | (F.col("combined") >= COMBINED)
    return out.withColumns({
        "same_entity": same, "confidence": F.when(F.col("by_domain"), 0.99).otherwise(F.round("combined", 4)),
        "method": F.when(F.col("by_domain"), "domain_match").otherwise("hybrid_resolution"),
    }).drop("by_domain", "combined")


def _pair_verdict(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Adds fuzzy, semantic, same_entity, confidence and method to ``pairs`` (a, b) of ``marked`` firms."""
    held = {c: marked.select(F.col("id").alias(c), F.struct("name", "domain", "site", "vector").alias(f"f{c}")) for c in "ab"}
    x, y = F.col("fa"), F.col("fb")
    out = pairs.join(held["a"], "a").join(held["b"], "b").withColumn("fuzzy", indel_ratio(x["name"], y["name"]))
    out = out.withColumn("semantic", F.coalesce(F.nanvl(cosine(x.vector, y.vector), F.lit(0.0)), F.lit(0.0)))
    return _verdict(out.withColumn("by_domain", F.coalesce((x.domain != "") & (x.site == y.site), F.lit(False)))).drop("fa", "fb")


def _marked(firms: DataFrame) -> DataFrame:
    """What resolution needs of each firm: id, fresh, name, domain, site, vector (null where it has no direction)."""
    v, domain = F.col("embedding"), url_domain(F.col("website"))
    fine = F.forall(v, lambda z: z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))) & F.exists(v, lambda z: z != 0)
    fresh = F.col("fresh") if "fresh" in firms.columns else F.lit(True)
    return firms.select(
        "id", fresh.alias("fresh"), F.coalesce(resolver_name(F.col("firm_name")), F.lit("")).alias("name"), F.coalesce(domain, F.lit("")).alias("domain"),
        resolver_name(F.col("website")).alias("site"), F.when(fine, v).alias("vector"),
    )


def _numbered(marked: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The distinct values of a column with numbers (no, <column>, fresh, low: smallest id), and (id, fresh, no)."""
    known = (F.col(column) != "") if column == "name" else F.col(column).isNotNull()
    values = marked.where(known).groupBy(column).agg(F.max("fresh").alias("fresh"), F.min("id").alias("low"))
    # as many files as the session has shuffle partitions: few bytes, but much work for each
    values = values.repartition(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)
    values = durable(values.withColumn("no", F.monotonically_increasing_id()))
    return values, marked.where(known).join(values.select("no", column), column).select("id", "fresh", "no")


def _similar(marked: DataFrame) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """For names and for vectors: distinct values, which firm has which, and the pairs of values that the rule links."""
    out = []
    for column, join, least in (("name", similar_names, FUZZY), ("vector", similar_vectors, SEMANTIC)):
        values, of = _numbered(marked, column)
        out.append((values, of, durable(join(values.select("no", column, "fresh"), least))))
    return out


def _site_pairs(marked: DataFrame, key: str) -> DataFrame:
    x, y = marked.alias("x"), marked.alias("y")
    known = F.col("x.domain") != ""  # of equal sites the smaller id's domain counts
    return x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & known & (F.col("x.id") < F.col("y.id")) & (F.col("x.fresh") | F.col("y.fresh"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def linked_pairs(firms: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of firms that the rule links, and every pair of one domain; with a column ``fresh``, only
    pairs of which one is.

    Equal sites and domains are joined, and so are firms of one name or one vector. Distinct names meet by rare grams and
    distinct vectors by caps (``operators.similar``), so what is compared are mostly pairs that the rule links. COMBINED
    needs no look of its own: what is under FUZZY and under SEMANTIC is under it.
    """
    marked = durable(_marked(firms))
    slim = marked.drop("name", "vector")
    pairs = _site_pairs(slim, "site").unionByName(_site_pairs(slim, "domain"))
    for _, of, alike in _similar(marked):
        x, y = of.alias("x"), of.alias("y")
        new = F.col("x.fresh") | F.col("y.fresh")
        same = x.join(y, (F.col("x.no") == F.col("y.no")) & (F.col("x.id") < F.col("y.id")) & new)
        other = alike.join(x, F.col("a") == F.col("x.no")).join(y, F.col("b") == F.col("y.no")).where((F.col("x.id") != F.col("y.id")) & new)
        for found in (same, other):
            pairs = pairs.unionByName(found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
    return pairs.distinct()


@tidy
def entity_links(firms: DataFrame) -> DataFrame:
    """(a, b): links enough to connect all firms that the rule links, directly or not: every firm with the first one of its
    site, name and vector, and similar names and vectors by their first firms. With a column ``fresh``, links that touch
    a fresh firm or value suffice, since older ones are known. Unlike all pairs these stay about as many as firms."""
    marked = durable(_marked(firms))
    first = marked.where("domain <> ''").groupBy("site").agg(F.min("id").alias("low"))
    out = marked.join(first, "site").where("id > low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    for values, of, alike in _similar(marked):
        low = values.select("no", "low")
        out = out.unionByName(of.join(low, "no").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
        both = alike.join(low.withColumnsRenamed({"no": "a", "low": "x"}), "a").join(low.withColumnsRenamed({"no": "b", "low": "y"}), "b")
        out = out.unionByName(both.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return out.where("a <> b").distinct()


@tidy
def resolve_entities(firms: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, same_entity, confidence, method, fuzzy, semantic) for given pairs of firms, or else for all that the rule
    links and all of one domain."""
    if pairs is None:
        pairs = linked_pairs(firms)
    return _pair_verdict(pairs, _marked(firms))


@tidy
def resolve_classes(firms: DataFrame) -> DataFrame:
    """(a, b, via, same_entity, confidence, method, fuzzy, semantic), a < b: what ``resolve_entities`` finds, without the
    pairs that copies make of one another.

    Firms of one site, domain, name or vector are a class with its smallest id. Rows "same_site", "same_domain", "same_name"
    and "same_vector" in ``via`` name the members b of the class of a; "near_name" and "near_vector" link the classes of a
    and b. ("after_site": b has a site but no domain and is linked with the firms before it that have one.) So a pair of
    firms is linked where they share a class or their classes are linked, and rows are about as many as firms and links
    between different values, where pairs would be the square of a class.
    """
    marked = durable(_marked(firms))
    out = None
    for key, via in (("site", F.when(F.col("domain") != "", "same_site").otherwise("after_site")), ("domain", F.when(F.col("domain") != "", "same_domain"))):
        first = marked.where("domain <> ''").groupBy(key).agg(F.min("id").alias("a"))
        members = marked.select("id", "domain", "site").join(first, key).where("id > a").select("a", F.col("id").alias("b"), via.alias("via"))
        out = members if out is None else out.unionByName(members)
    for kind, (values, of, alike) in zip(("name", "vector"), _similar(marked)):
        low = values.select("no", "low")
        members = of.join(low, "no").where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"), F.lit(f"same_{kind}").alias("via"))
        both = alike.join(low.toDF("a", "x"), "a").join(low.toDF("b", "y"), "b")
        near = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(f"near_{kind}").alias("via"))
        out = out.unionByName(members).unionByName(near)
    pairs = out.groupBy("a", "b").agg(F.array_sort(F.collect_set("via")).alias("via"))
    return _pair_verdict(pairs, marked)


def batch_edges(incoming: DataFrame, key_columns: tuple[str, ...] = ("name_key", "firm_key", "domain")) -> DataFrame:
    """(a, b): each row of a batch with the first row of equal name, key or domain: links enough to connect all."""
    k = incoming.withColumns({"name_key": F.lower("firm_name"), "firm_key": firm_key(F.col("firm_name")), "domain": url_domain(F.col("website"))})
    out = None
    for c in key_columns:
        first = k.where(F.col(c) != "").groupBy(c).agg(F.min("id").alias("b"))
        e = k.join(first, c).where("id <> b").select(F.col("id").alias("a"), "b")
        out = e if out is None else out.unionByName(e)
    return out.distinct()


def entity_components(nodes: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, entity_id): the smallest id that links lead to. Only linked nodes take part in the rounds."""
    linked = components(edges, rounds)
    return nodes.join(linked, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("entity_id"))


@tidy
def extend_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, entity_id) after new ``links`` (a, b) between their ids.

    Only the labels at the ends of links are looked up and connected; the other labels pass by, whatever their number.
    The result is that of all links at once.
    """
    at = labels.select(F.col("id").alias("a"), F.col("entity_id").alias("la"))
    ends = links.select("a", "b").join(at, "a").join(at.withColumnsRenamed({"a": "b", "la": "lb"}), "b").where("la <> lb")
    moved = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).where("node <> component")
    return labels.join(moved, F.col("entity_id") == F.col("node"), "left").select("id", F.coalesce("component", "entity_id").alias("entity_id"))


def resolve_batch(firms: DataFrame, labels: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, touched): the entity of every firm after a ``batch`` of new firms, and the entities that gained a firm or
    were joined, which are those to be merged anew.

    ``firms`` and ``batch`` hold id, firm_name, website and embedding, ``labels`` (id, entity_id) the result so far. Old firms
    are compared with new ones only, never with each other again. One batch after the other gives the same labels as all
    at once.
    """
    columns = ("id", "firm_name", "website", "embedding")
    every = firms.select(*columns, F.lit(False).alias("fresh")).unionByName(batch.select(*columns, F.lit(True).alias("fresh")))
    start = labels.unionByName(batch.select("id", F.col("id").alias("entity_id")))
    new = extend_components(start, entity_links(every))
    changed = new.join(labels.withColumnRenamed("entity_id", "was"), "id", "left").where("was is null or was <> entity_id")
    return new, changed.select("entity_id").distinct()


def _some(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def _children(df: DataFrame, name: str, fills: tuple[str, ...], order: str) -> DataFrame:
    """One row for each firm and lower-case name: the first spelling, and of each other field the first that is not blank."""
    rows = df.withColumn("k", text_key(F.col(name))).where("k <> ''")
    return rows.groupBy("firm_id", "k").agg(
        F.min(order).alias("at"), F.min_by(name, order).alias(name), *[F.min_by(c, F.when(_some(c), F.col(order))).alias(c) for c in fills]
    )


def merge_children(existing: DataFrame, incoming: DataFrame, name: str, fills: tuple[str, ...], order: str = "seq") -> DataFrame:
    """Children (firm_id, <name>, fills) by firm and lower-case name: existing values stay, blank ones are filled.

    Of several rows for one child the first in ``order`` counts, and blanks are filled by the next ones in turn. Adds
    ``is_new`` and ``at``, the place of its first row: existing children stand before new ones.
    """
    def ranked(df: DataFrame, new: bool) -> DataFrame:
        return df.select("firm_id", name, *fills, F.struct(F.lit(new).alias("is_new"), F.col(order).alias("at")).alias("place"))

    # existing rows stand first, so one grouping of all rows does for both sides and for what one fills of the other
    out = _children(ranked(existing, False).unionByName(ranked(incoming, True)), name, fills, "place")
    return out.select("firm_id", name, *fills, F.col("at.is_new").alias("is_new"), F.col("at.at").alias("at"))


def merge_firms(existing: DataFrame, incoming: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """The firm table after an upsert by id: name from the incoming row, arrays united with existing ones first, website
    and source from the incoming row unless blank, created_at kept, updated_at ``now``, and the text to embed anew.

    Of several incoming rows for one id the last in ``order`` counts.
    """
    cols = ("firm_name", *SCALARS, *LISTS)
    new = incoming.groupBy("id").agg(F.max_by(F.struct(*cols), order).alias("n"))
    out = existing.join(new, "id", "full_outer")
    seen = F.col("n").isNotNull()
    return out.select(
        "id", F.when(seen, F.col("n.firm_name")).otherwise(F.col("firm_name")).alias("firm_name"),
        *[fill(F.col(f"n.{c}"), F.col(c)).alias(c) for c in SCALARS], *[union_exact(F.col(c), F.col(f"n.{c}")).alias(c) for c in LISTS],
        F.coalesce("created_at", F.when(seen, now)).alias("created_at"), F.when(seen, now).otherwise(F.col("updated_at")).alias("updated_at"),
    ).withColumn("embedding_text", embedding_text(F.col("firm_name"), F.col("website"), *[F.array_join(c, " ") for c in LISTS]))


def upsert_firms(firms: DataFrame, partners: DataFrame, companies: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(firms, partners, companies) after an upsert of whole records.

    ``incoming`` (id, seq, scalars, lists, partners, portfolio_companies) holds records of known ids. Firms are merged as by
    ``merge_firms``, their children with all fields as by ``merge_children``: role and links of partners and sectors of
    companies stay where they are known and are filled where they are blank. Children keep their id; that of a new one
    is null until it is stored. ``embedding_text`` then names all partners and companies in order, and the vector is made
    anew from it. Children are tables of their own, as they are read for the text and by the caller; they lie in buckets of
    their firm, so their lists need no shuffle, and where what is given lies so too, their merge needs none.
    """
    def given(column: str, name: str, fields: tuple[str, ...]) -> DataFrame:
        held = incoming.schema[column].dataType.elementType.fieldNames()
        cells = [F.col(f"x.{c}").alias(c) if c in held else F.lit(None).cast("string").alias(c) for c in (name, *fields)]
        return incoming.select("id", "seq", F.posexplode(column).alias("p", "x")).select(F.col("id").alias("firm_id"), F.struct("seq", "p").alias("seq"), *cells)

    def known(df: DataFrame, name: str, fields: tuple[str, ...]) -> DataFrame:
        cells = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
        return df.select("firm_id", F.struct(F.col("id").alias("seq"), F.lit(0).alias("p")).alias("seq"), name, *cells)

    def merged_children(stored: DataFrame, column: str, name: str, fields: tuple[str, ...]) -> DataFrame:
        out = merge_children(known(stored, name, fields), given(column, name, fields), name, fields)
        return bucketed(out.withColumn("id", F.when(~F.col("is_new"), F.col("at.seq"))), "firm_id")

    people = merged_children(partners, "partners", "name", PARTNER_FIELDS)
    owned = merged_children(companies, "portfolio_companies", "company_name", COMPANY_FIELDS)

    def listed(df: DataFrame, name: str, out: str) -> DataFrame:
        rows = df.groupBy(F.col("firm_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("is_new", "at", name))).alias(out))
        return rows.select("id", F.col(f"{out}.{name}").alias(out))

    merged = merge_firms(firms, incoming, now).join(listed(people, "name", "names"), "id", "left").join(listed(owned, "company_name", "company_names"), "id", "left")
    text = embedding_text(F.col("firm_name"), F.col("website"), *[F.array_join(c, " ") for c in (*LISTS, "names", "company_names")])
    return embed_text(merged.withColumn("embedding_text", text).drop("names", "company_names"), "embedding_text"), people, owned


def insert_missing_children(existing: DataFrame, incoming: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """``existing`` plus the incoming children whose (firm, lower-case name) it does not hold, each once: the first row in
    ``order``, or else the one whose name comes first."""
    rows = incoming.withColumn("k", text_key(F.col(name)))
    new = rows.groupBy("firm_id", "k").agg(F.min_by(F.struct(*incoming.columns), order or name).alias("x"))
    held = existing.select("firm_id", text_key(F.col(name)).alias("k")).distinct()
    return existing.unionByName(new.join(held, ["firm_id", "k"], "left_anti").select("x.*"), allowMissingColumns=True)


def merge_groups(records: DataFrame) -> DataFrame:
    """One record for each entity_id from records (entity_id, seq, firm, website, lists, partners, portfolio_companies), in
    order of seq: the first non-blank scalar, and unions that take spellings of different case as one.

    Elements are brought together by (entity, list, key) first, so a group's repeats meet in partial sums and the record
    of an entity holds each element once.
    """
    kinds = {c: records.schema[c].dataType.elementType.simpleString() for c in ("partners", "portfolio_companies")}
    shape = f"array<struct<list:string,pos:int,k:string,s:string,p:{kinds['partners']},c:{kinds['portfolio_companies']}>>"

    def elements(column: str, key, slot: str) -> Column:
        values = {z: F.lit(None) for z in "spc"}
        one = lambda x, i: F.struct(F.lit(column).alias("list"), i.alias("pos"), text_key(key(x)).alias("k"), *[(x if z == slot else v).alias(z) for z, v in values.items()])
        return F.transform(F.coalesce(column, F.array().cast(records.schema[column].dataType)), one).cast(shape)

    every = F.concat(*[elements(c, lambda x: x, "s") for c in LISTS], elements("partners", lambda x: x["name"], "p"), elements("portfolio_companies", lambda x: x.company_name, "c"))
    rows = records.select("entity_id", "seq", F.explode(every).alias("x")).where("x.k <> ''").select("entity_id", "seq", "x.*")
    first = rows.groupBy("entity_id", "list", "k").agg(F.min(F.struct("seq", "pos")).alias("at"), F.min_by(F.struct("s", "p", "c"), F.struct("seq", "pos")).alias("v"))

    def united(column: str, slot: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("list") == column, F.struct("at", F.col(f"v.{slot}").alias("v")))), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
        return F.transform(found, lambda x: x["v"]).alias(column)

    lists = first.groupBy("entity_id").agg(*[united(c, "s") for c in LISTS], united("partners", "p"), united("portfolio_companies", "c"))
    scalars = records.groupBy("entity_id").agg(*[F.coalesce(F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("seq"))), F.lit("")).alias(c) for c in ("firm", "website")])
    out = scalars.join(lists, "entity_id", "left")
    return out.select("entity_id", "firm", "website", *[F.coalesce(c, F.array().cast(lists.schema[c].dataType)).alias(c) for c in (*LISTS, "partners", "portfolio_companies")])
