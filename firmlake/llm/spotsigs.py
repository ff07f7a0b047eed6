"""Document fingerprints by spot signatures (operator 2), with DataFrame functions only.

A spot signature is a run of common words, the anchor, with the two content words that follow it, common words in
between left out. A document's fingerprint is the sorted set of its signatures, each as eight hex digits. Signatures
stand at many places, survive edits elsewhere and skip page furniture, which has few common words.

Near pairs are found by joining on signatures within partitions of similar set size: two sets can only be similar if
their sizes are, so each set meets its own partition and the next one; only the rarest signatures of a set are joined,
and a pair is dropped before its sets are compared when its sizes or places rule out the likeness asked for.

Texts without an anchor use all pairs of neighbouring words; texts of one word or none use the whole text, so every
text has a fingerprint and equal texts have equal ones. Null texts count as empty. Repeated rows are documents of
their own; rows of one doc_id stand in the order of their texts. Rows without a doc_id stand outside the order: they have
no next document, so nothing replaces the second half of their text and they are like no next one. Very long texts are
read whole. An empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlake.llm.common import durable, table, tidy

#: Common words of four languages that anchor a signature.
ANCHORS = (
    "a an and are as at be by for from in is it of on that the this to was were with "
    "auf das dem den der des die ein eine ist mit nicht sich und von zu im "
    "au de des du en est et la le les ou par pas pour que qui un une dans sur "
    "al con del el es esta las los no para por se su una y"
).split()
#: Likeness from which two fingerprints are near, in per cent.
PERCENT = 80


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the sorted distinct 32-bit signatures of the column ``text``."""
    # possessive runs: Java matches them in a loop, however many common words follow each other
    anchor = "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    out = df.withColumn("__runs", F.regexp_extract_all(F.concat(plain, F.lit(" ")), F.lit(rf"(?:(?:{anchor}) )*+[^ ]+ |(?:(?:{anchor}) )++"), F.lit(0)))
    out = out.withColumn("__words", F.transform("__runs", lambda t: F.substring_index(F.rtrim(t), " ", -1)))
    places = F.when(F.size("__runs") > 1, F.sequence(F.lit(0), F.size("__runs") - 2)).otherwise(F.array().cast("array<int>"))

    def anchored(i: Column) -> Column:
        run = F.get("__runs", i)
        return F.instr(run, " ") < F.length(run)

    out = out.withColumn("__spots", F.transform(F.filter(places, anchored), lambda i: F.hash(F.get("__runs", i), F.get("__words", i + 1))))
    pairs = F.transform(places, lambda i: F.hash(F.get("__words", i), F.get("__words", i + 1), F.lit("pair")))
    whole = F.array(F.hash(F.coalesce(text, F.lit("")), F.lit("whole")))
    found = F.when(F.size("__spots") > 0, F.col("__spots")).when(F.size("__runs") > 1, pairs).otherwise(whole)
    return out.withColumn(name, F.array_sort(F.array_distinct(found))).drop("__runs", "__words", "__spots")


def as_string(signatures: str) -> Column:
    """Eight hex digits for each signature, one after the other."""
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: str | Column, b: str | Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without comparing them when their sizes keep it below ``least``."""
    m, n = F.size(a), F.size(b)
    same = F.size(F.array_intersect(a, b))
    return F.when(F.least(m, n) < least * F.greatest(m, n), F.lit(0.0)).otherwise(same / (m + n - same))


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Adds next_<column>: that of the next row by doc_id, and for the last row that of the first; null without a doc_id.

    Rows are dealt into ranges of doc_id, and each range borrows the first row of the one behind it, so no task
    sorts more than a range. The driver holds one boundary for each range.
    """
    spark, lost = docs.sparkSession, docs.where("doc_id is null")
    docs = docs.where("doc_id is not null")
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    literal = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<long>")
    at = F.size(F.filter(literal, lambda b: b <= F.col("doc_id")))
    rows = docs.withColumn("__range", at)
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("__range").agg(F.min("doc_id")).collect() if r[1] is not None)
    if not firsts:
        firsts = [(0, 0)]
    lender = [(first, before) for (before, _), (_, first) in pairwise(firsts)] + [(firsts[0][1], firsts[-1][0])]
    own = F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("lent")))
    to = F.element_at(F.create_map(*[F.lit(x).cast(t) for p in lender for x, t in zip(p, ("long", "int"))]), F.col("doc_id"))
    lent = F.when(to.isNotNull(), F.array(F.struct(to.alias("r"), F.lit(1).alias("lent")))).otherwise(F.array().cast("array<struct<r:int,lent:int>>"))
    rows = rows.withColumn("__to", F.explode(F.concat(own, lent))).withColumn("__range", F.col("__to.r")).withColumn("__lent", F.col("__to.lent"))
    order = Window.partitionBy("__range").orderBy("__lent", "doc_id", "text")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where("__lent = 0").drop("__range", "__to", "__lent").unionByName(lost, allowMissingColumns=True)


@tidy
def near_pairs(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, likeness) of all pairs of different fingerprints whose likeness reaches ``percent``; a and b are the
    smallest doc_id of each."""
    prints = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "sigs")
    sets = durable(prints.groupBy("sigs").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    flat = sets.select("rep", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rarity = flat.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("df", "sig"))
    alone = F.col("n") - F.count("*").over(Window.partitionBy("rep"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = flat.join(rarity, "sig").withColumn("place", rank + alone).where(F.col("place") <= most)
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    rare = durable(rare.withColumn("part", step).select("rep", "n", "sig", "place", "part"))
    x = rare.withColumn("part", F.explode(F.array("part", F.col("part") + 1, F.col("part") - 1))).alias("x")
    y = rare.alias("y")
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    fits = (F.col("x.rep") < F.col("y.rep")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    fits = fits & ((100 + percent) * (left + F.least("x.place", "y.place") - 1) >= percent * (F.col("x.n") + F.col("y.n")))
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.part") == F.col("y.part")) & fits).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("sigs").alias("sb")), "b")
    return both.withColumn("likeness", likeness("sa", "sb", percent / 100)).where(F.col("likeness") >= percent / 100).select("a", "b", "likeness")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half is replaced by the start of the next text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_signatures(rows, "text", "sigs"), ["text", "sigs"]).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(coalesce(next_text, ''), cast(n_chars div 2 as int)))")).drop("text", "next_text")
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string("sigs").alias("fingerprint"), as_string("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), F.coalesce(likeness("sigs", "next_sigs"), F.lit(0.0)).alias("near_next"),
    )


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
