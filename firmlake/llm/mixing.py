"""Mixing sources to target weights (operator 13), with DataFrame functions only.

The words of each source form one stream, documents in the order of a hash, cut into blocks of a fixed number of words. A
source's target says how many words the mix takes of it: whole passes over the stream, and for the rest the first
blocks of one more pass in a pseudorandom order, the last one cut. Each pass has an order of its own: a Feistel
network over the two digits of a block's index, which is applied again while it leads out of the range, so it is a
permutation of a source of any size and nothing is sorted or stored. A short block at a stream's end stands last in every pass.

The mix comes in output shards of a fixed number of slots. Every slot of a shard draws a source with the probability of
its share in the mix, so a shard's counts are multinomial; running sums of the counts over shards number the slots of a
source, the number is mapped through the source's permutation, and the slot takes the block of that index. Draws that go
beyond what a source has to give leave their slots out, and what a source has left after the last shard fills closing
shards, so every source's words are its target to the nearest word whatever was drawn. No document is taken more than
three times its size, as no source is.

Sums over shards, over documents and over sources are running sums over ranges (``running_sums``), so a source that
holds most rows is spread over tasks, and nothing passes through the driver but single totals.

Null and empty texts have size 0 and are taken 0 times. Rows that repeat doc_id, source and size stand next to each other
and are rows of their own. A null doc_id is hashed as null; a null source is the last one. A very long text spans many
blocks. If no row has a word all targets are 0; an empty table gives no rows. Only doc_id, text and source are
read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import durable, table, tidy
from firmlake.operators.running import running_sums

#: Words of a block, slots of an output shard, weights of sources in their order, and how often a source may be repeated.
BLOCK, SHARD = 64, 4096
WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the Feistel network (an even number), and how often an index may be led back into its range: few lead out at
#: all, and one in 4 of those again at most, so none is left after these.
FEISTEL, WALKS = 4, 48
#: Slots, or documents, that one task turns into rows.
A_TASK = 50_000


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom permutation of the numbers 0 to ``size`` - 1, picked by ``key``.

    An index is a pair of digits, of which each round adds a hash of the one to the other and swaps them. There are hardly
    more pairs than indexes: about one in a root of ``size`` leads out of the range and is permuted again.
    """
    wide = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    narrow = F.ceil(size / wide).cast("long")

    def shuffled(x: Column) -> Column:
        one, two = F.floor(x / narrow), F.pmod(x, narrow)
        for i in range(FEISTEL):
            one, two = two, F.pmod(one + F.pmod(F.xxhash64(two, F.lit(i), *key), F.lit(1 << 62)), narrow if i % 2 else wide)
        return one * narrow + two

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), shuffled(index), lambda x, _: F.when(x < size, x).otherwise(shuffled(x)))
    once = shuffled(index)
    back = F.when(walked < size, walked).otherwise(F.raise_error(F.lit("an index was not led back into its range")).cast("long"))
    return F.when(size == 1, F.lit(0).cast("long")).when(once < size, once).otherwise(back)


def dealt(rows: DataFrame, many: int, *keys: str) -> DataFrame:
    """Few rows that will become ``many``, spread over as many tasks as those need."""
    return rows.repartition(1 + many // A_TASK, *keys)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, copies): documents of one id, source and size as one row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    return durable(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, number, source_size, target, words): what the mix takes of each source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; none gets more than
    ``repeats`` times its size. Sources are looked at by the share at which they are full: those full before all others
    at the share that is then left keep their limit, and the rest split what remains by weight.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    by = durable(by)
    ranges = 1 + by.count() // A_TASK
    by = running_sums(by, {"number": F.lit(1).cast("long")}, [F.asc_nulls_last("source")], ranges=ranges)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    by = durable(by.withColumn("weight", weight).withColumn("most", repeats * F.col("source_size")))
    whole, heavy = by.agg(F.sum("source_size"), F.sum("weight")).first()
    ranked = running_sums(by, {"full": F.col("most"), "gone": F.col("weight")}, [F.col("most") / F.col("weight"), F.col("number")], ranges=ranges)
    share = (F.lit(whole or 0).cast("double") - F.col("full")) / (F.lit(heavy or 0) - F.col("gone"))
    ranked = durable(ranked.withColumn("share", share))
    left = ranked.where(F.col("most") > F.col("share") * F.col("weight")).agg(F.min_by("share", F.struct(F.col("most") / F.col("weight"), "number"))).first()[0]
    most = F.col("most").cast("double")
    target = most if left is None else F.least(most, F.lit(left) * F.col("weight"))
    out = ranked.select("source", "number", "source_size", target.alias("target"))
    return durable(out.withColumn("words", F.least(F.round("target").cast("long"), repeats * F.col("source_size"))))


def placed(sizes: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(number, doc_id, size, start): where each document begins in the stream of its source; no empty ones."""
    same = sizes["source"].eqNullSafe(sources["source"])
    rows = sizes.where("size > 0").join(sources, same).select("number", "doc_id", "size", "copies", F.xxhash64(F.lit(seed), "doc_id", "size").alias("h"))
    rows = running_sums(rows, {"start": F.col("size") * F.col("copies")}, [F.col("h"), F.col("doc_id"), F.col("size")], ("number",), 1 + sizes.count() // A_TASK)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return rows.select("number", "doc_id", "size", "start", copy.alias("c")).select("number", "doc_id", "size", (F.col("start") + F.col("c") * F.col("size")).alias("start"))


def in_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``placed`` documents by block: (number, block, doc_id, size, start, lo, hi), with the words lo to hi of the block."""
    span = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    rows = dealt(docs, docs.count(), "number", "start").select("*", F.explode(span).alias("block"))
    at = F.col("block") * block
    return rows.select("number", "block", "doc_id", "size", "start", (F.greatest("start", at) - at).alias("lo"), (F.least(F.col("start") + F.col("size"), at + block) - at).alias("hi"))


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, number, j, block, take): the slots of the mix; each takes the first ``take`` words of a block."""
    spark, size, words = sources.sparkSession, F.col("source_size"), F.col("words")
    s = sources.where("words > 0").select("number", "source_size", "words", F.ceil(size / block).alias("blocks"), F.floor(words / size).alias("passes"))
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil((words - F.col("passes") * size) / block))
    ranges = 1 + sources.count() // A_TASK
    s = durable(running_sums(s, {"lo": F.col("slots")}, [F.col("number")], ranges=ranges))
    whole, many = s.agg(F.sum("slots"), F.count("*")).first()
    whole = whole or 0
    # a draw is a number below the sum of all slots; sources are looked up by cells of such numbers
    cell = max(1, whole // max(4096, 4 * many))
    cells = s.select("number", "lo", (F.col("lo") + F.col("slots")).alias("hi")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    drawn = spark.range(whole).select((F.col("id") / shard).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(1, whole))).alias("x"))
    drawn = drawn.withColumn("cell", F.floor(F.col("x") / cell)).join(cells, "cell").where("lo <= x and x < hi")
    counts = drawn.groupBy("shard", "number").agg(F.count("*").alias("n"))
    counts = durable(counts)
    counts = durable(running_sums(counts, {"before": F.col("n")}, [F.col("shard")], ("number",), 1 + counts.count() // A_TASK))
    # what a source has left after the last shard; a source that was never drawn has all left
    total = counts.groupBy("number").agg(F.sum("n").alias("total"))
    rest = s.join(total, "number", "left").select("number", F.coalesce("total", F.lit(0)).alias("before"), (F.col("slots") - F.coalesce("total", F.lit(0))).alias("n")).where("n > 0")
    rest = running_sums(rest, {"at": F.col("n")}, [F.col("number")], ranges=ranges)
    closing = F.lit(-(-whole // shard)) + F.floor((F.col("at") + F.col("i")) / shard)
    one = dealt(counts, whole, "shard", "number").select("shard", "number", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    two = dealt(rest, int(rest.agg(F.sum("n")).first()[0] or 0), "number").select("number", "before", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select(closing.alias("shard"), "number", "before", "i")
    every = one.unionByName(two).select("shard", "number", (F.col("before") + F.col("i")).alias("j")).join(s, "number").where("j < slots")
    pass_, place, full = F.floor(F.col("j") / F.col("blocks")), F.pmod("j", "blocks"), F.floor(size / block)
    at = F.when(place < full, permuted(place, full, F.lit(seed), F.col("number"), pass_)).otherwise(place)
    take = F.least(F.lit(block).cast("long"), size - place * block, words - pass_ * size - place * block)
    return every.select("shard", "number", "j", at.alias("block"), take.alias("take"))


def mixed(docs: DataFrame, sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, number, j, doc_id, size, start, lo, hi): the pieces of ``placed`` documents that the mix takes, slot by
    slot; lo and hi count words in the source's stream."""
    found = slots(sources, block, shard, seed).join(in_blocks(docs, block), ["number", "block"]).where("lo < take")
    at = F.col("block") * block
    return found.select("shard", "number", "j", "doc_id", "size", "start", (at + F.col("lo")).alias("lo"), (at + F.least("hi", "take")).alias("hi"))


@tidy
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source)."""
    sizes = sized(docs)
    sources = targets(sizes, weights, repeats)
    stream = durable(placed(sizes, sources, seed))
    words = mixed(stream, sources, block, shard, seed).groupBy("number", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    full = stream.join(words, ["number", "start"], "left").select("number", "doc_id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    empty = sizes.where("size = 0").withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    empty = empty.join(sources, empty["source"].eqNullSafe(sources["source"])).select("number", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return full.unionByName(empty).join(sources, "number").select("doc_id", "source", "size", "source_size", "target", "taken")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
