"""Near-duplicate documents by an n-gram Jaccard join with PartEnum signatures (operator 7).

A document is the set of its distinct 5-word shingles. Set sizes fall into bands in which similar sets lie at
most one band apart, so each set joins the family of its own band and that of the band below. Two similar sets of a
family differ in at most k elements. The shingle domain is partitioned into more than k parts, and every part is a
subset to enumerate: similar sets agree in all parts but k, so they share a signature, that of a part's elements.

Parts may be empty in both sets, which shows nothing. There are therefore more parts than k + 1, and a set of which
too many parts are empty counts as sparse. Other sets are bound to share several signatures, t, with each similar one,
so they leave out t - 1 of theirs: those of the smallest parts, in one order for all sets, as these are the ones that
dissimilar sets share. The first signature in that order that two similar sets share is left out by neither. Only sparse
sets have other partitions to be found by, and sets that are sparse in all of them, which hardly occurs, share one
signature of their family. So every similar pair shares a signature, at every size, without exception.

Equal sets are collapsed first. Signatures are dealt into buckets by hash, many to a row; a bucket gives its groups
of sets with a common signature, each different group once. Sets of a group are compared with one leader at first.
Of the sets of groups that are then not all linked, the elements that no other such set holds are counted: they bound
what a set can share with any other, and so the sizes of sets that may be similar to it. Sets that have none of
such a size in a group, but for those they are connected with, leave it. What stays gets a few other leaders, round by
round, so a group of near copies never becomes all its pairs, and what no round links any more meets pair by pair, without
the pairs inside a group's largest component. A map of parities of each set bounds the difference of two from below
before their whole sets are compared.

Null or word-free texts have no shingles and link with nothing. Rows that repeat a doc_id count as one document that
has the links of all its rows. Rows without a doc_id link with nothing and have no component. Very long texts are read
whole. An empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import FlatWords, components, distinct, durable, importable, map_rows, mix, packed, releasing, shingle_hashes, table, tidy, unpacked

SHINGLE = 5
PERCENT = 80
#: Rounds of further leaders, and leaders of a group in each.
ROUNDS = 4
LEADERS = 3
#: Share of the pairs with leaders that a round must link for another one to follow.
LEAST_LINKED = 0.05
#: 64-bit words of the parity map of a set.
BITMAP = 32
#: Signatures that one bucket gets on average; bytes of a broadcast.
BUCKET = 1_000_000
BROADCAST_BYTES = 32 << 20
#: Sets of open groups that one task gets on average, without and with their maps; sets of a group that meet in one task.
OPEN_ROWS = 100_000
MAP_ROWS = 20_000
CHUNK = 8_192
#: Pairs of sets that are looked at together.
BLOCK = 500_000
BASE = "doc_id long, t long, n_shingles long, k1 long, k2 long, n_sigs long"


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z is lower-cased, words end at ASCII white space."""
    return distinct(shingle_hashes(FlatWords([text]).h, size))


@lru_cache(100_000)
def band(n: int, percent: int = PERCENT) -> int:
    """Number of the size band of a set of ``n`` elements."""
    i, top = 0, 1
    while n > top:
        i, top = i + 1, (top + 1) * 100 // percent
    return i


@lru_cache(1_000)
def family(i: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(most differing elements, parts, partitions) for pairs whose smaller set is in band ``i``."""
    top = 1
    for _ in range(i):
        top = (top + 1) * 100 // percent
    g = Fraction(percent, 100)
    k = int((1 - g) / (1 + g) * (1 + 1 / g) * top)
    return k, k + 1 + max(2, k // 5), 3 if k < 20 else 2 if k < 100 else 1


@lru_cache(1_000)
def _tags(i: int, r: int, parts: int) -> np.ndarray:
    """Numbers of the parts of one partition of one family, spread out."""
    return mix(np.arange(parts, dtype=np.uint64) + np.uint64(1_000_003 * (i * 16 + r) + 17))


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """PartEnum signatures of one set, for its own band's family and the one below."""
    out = []
    for i in {band(len(s), percent), band(len(s), percent) - 1}:
        if i < 0 or not (k := family(i, percent)[0]):
            continue
        _, parts, repeats = family(i, percent)
        for r in range(repeats):
            h = mix(s ^ np.uint64(0x5851F42D4C957F2D + 2 * r + 1000 * i))
            part = (h % np.uint64(parts)).astype(np.int64)
            sums, held = np.zeros(parts, np.uint64), np.bincount(part, minlength=parts)
            np.add.at(sums, part, mix(h))
            full = held > 0
            sig, spare = mix(sums + _tags(i, r, parts))[full], np.count_nonzero(full) - k - 1
            if spare >= 0:  # shares spare + 1 signatures at least with every similar set
                out.append(sig[np.lexsort((sig, -held[full]))[: k + 1]])
                break
            out.append(sig)
        else:
            out.append(mix(np.array([1_000_003 * (i * 16 + 15) + 5], np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _key(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")


def _described(batches: Iterator[dict], percent: int, size: int) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_shingles", "k1", "k2", "n_sigs", "bits")}
        words = FlatWords(batch["text"])
        for d, i in enumerate(batch["doc_id"]):
            s = distinct(shingle_hashes(words.of(d), size))
            # parities of how many shingles fall on each bit: bits that differ between two sets are shingles that do
            bits = (np.bincount((s % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1).astype(bool)
            k = _key(s)
            for name, value in zip(out, (len(s), int(k[0]), int(k[1]), _most(len(s), percent), np.packbits(bits).view(np.int64))):
                out[name].append(value)
        yield {"doc_id": batch["doc_id"], "t": batch["t"]} | out


@lru_cache(100_000)
def _most(n: int, percent: int) -> int:
    """Signatures of a set of ``n`` elements, but for sparse ones."""
    return sum(f[0] + 1 for i in {band(n, percent), band(n, percent) - 1} if i >= 0 and (f := family(i, percent))[0])


def _dealt(docs: DataFrame, size: int, buckets: int, made: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(bucket, ids, at, sig): what is ``made`` of each set, in buckets; ``at`` is the place of a set in ``ids``."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            words, seen, ids, sigs = FlatWords(batch["text"]), set(), [], []
            for d, i in enumerate(batch["doc_id"]):
                if i is None:
                    continue
                s = distinct(shingle_hashes(words.of(d), size))
                if len(s) and (k := int(_key(s)[0])) not in seen:
                    seen.add(k)
                    ids.append(k)
                    sigs.append(made(s))
            if not sigs:
                continue
            at = np.repeat(np.arange(len(ids)), [len(x) for x in sigs])
            sig = np.concatenate(sigs)
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, at = bucket[order], at[order]
            # sets are numbered anew in each bucket
            new = np.ones(len(order), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (at[1:] != at[:-1])
            which, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(order))
            number = np.cumsum(new) - 1
            number -= np.repeat(number[first], ends - first)
            id_ends = np.cumsum(np.add.reduceat(new, first)) if len(first) else first
            own = packed(np.array(ids, np.int64).view(np.uint64)[at[new]], 8)
            at_bytes, sig_bytes = packed(number.astype(np.uint64), 2), packed(sig[order] >> np.uint64(24), 5)
            yield {
                "bucket": which, "ids": [own[8 * a : 8 * b] for a, b in zip([0, *id_ends.tolist()], id_ends.tolist())],
                "at": [at_bytes[2 * a : 2 * b] for a, b in zip(first.tolist(), ends.tolist())], "sig": [sig_bytes[5 * a : 5 * b] for a, b in zip(first.tolist(), ends.tolist())],
            }

    return map_rows(docs, run, "bucket long, ids binary, at binary, sig binary", 1e6, 50_000)


def _of_bucket(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a set's id and a signature in a bucket, by signature."""
    ids, sigs = [], []
    for own, at, sig in zip(*(rows.column(c).to_pylist() for c in ("ids", "at", "sig"))):
        ids.append(np.frombuffer(own, "<i8")[unpacked(at, 2).astype(np.int64)])
        sigs.append(unpacked(sig, 5))
    ids, sigs = np.concatenate(ids), np.concatenate(sigs)
    order = np.lexsort((ids, sigs))
    ids, sigs = ids[order], sigs[order]
    again = np.zeros(len(ids), bool)
    again[1:] = (sigs[1:] == sigs[:-1]) & (ids[1:] == ids[:-1])
    return ids[~again], sigs[~again]


@releasing
def _own(key: tuple, rows: pa.Table) -> pa.Table:
    """(id, own): how many elements of each set in a bucket no other set there holds."""
    ids, sigs = _of_bucket(rows)
    new = np.concatenate((np.ones(1, bool), sigs[1:] != sigs[:-1], np.ones(1, bool)))
    ids, own = np.unique(ids[new[1:] & new[:-1]], return_counts=True)
    return pa.Table.from_pydict({"id": ids, "own": own}, pa.schema([("id", pa.int64()), ("own", pa.int64())]))


def _open(rows: pa.Table) -> pa.Table:
    """The rows (g, id, component, n, top) of sets that may be similar to one of another component in their group."""
    while True:
        g, component, n, top = (rows.column(c).to_numpy() for c in ("g", "component", "n", "top"))
        _, group = np.unique(g, return_inverse=True)
        _, part = np.unique(np.stack((g, component)), axis=1, return_inverse=True)
        base, low = int(top.max(initial=0)) + 2, rows.column("low").to_numpy()

        def inside(of: np.ndarray) -> np.ndarray:
            at = np.sort(of * base + n)
            return np.searchsorted(at, of * base + top, "right") - np.searchsorted(at, of * base + low)

        kept = (top >= low) & (inside(group) > inside(part.ravel()))
        if kept.all():
            return rows
        rows = rows.filter(pa.array(kept))


def _near(rows: pa.Table, percent: int, leaders: int, seed: int) -> dict[str, np.ndarray]:
    """(a, b): pairs of different components among the sets of one group, or of two of its chunks, that sizes, own elements
    and parity maps leave possible; with few ``leaders`` only, or of all sets (0)."""
    ids, component, n, top, chunk = (rows.column(c).to_numpy() for c in ("id", "component", "n", "top", "chunk"))
    bits = rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP)
    if leaders:
        one = np.argsort(mix(ids.view(np.uint64) + np.uint64(seed)))[:leaders]
    else:
        parts, sizes = np.unique(component, return_counts=True)
        one = np.flatnonzero(component != parts[sizes.argmax()])
    across = len(np.unique(chunk)) > 1
    a, b = [ids[:0]], [ids[:0]]
    step = max(1, BLOCK // len(ids))
    for x in (one[at : at + step, None] for at in range(0, len(one), step)):
        fits = (n <= top[x]) & (n[x] <= top) & (component != component[x])
        if across and not leaders:  # the pairs inside a chunk meet elsewhere
            fits &= chunk != chunk[x]
        i, j = np.nonzero(fits)
        i = x[i, 0]
        for words in (BITMAP // 8, BITMAP // 2, BITMAP):
            differ = np.bitwise_count(bits[i, :words] ^ bits[j, :words]).sum(1, dtype=np.int64)
            likely = (100 + percent) * differ <= (100 - percent) * (n[i] + n[j])
            i, j = i[likely], j[likely]
        a.append(np.minimum(ids[i], ids[j]))
        b.append(np.maximum(ids[i], ids[j]))
    return {"a": np.concatenate(a), "b": np.concatenate(b)}


@releasing
def _groups(key: tuple, rows: pa.Table) -> pa.Table:
    """(g, id, low): the different groups of sets with a common signature in a bucket; ``low`` is a group's leader."""
    ids, sigs = _of_bucket(rows)
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), sigs[1:] != sigs[:-1])))
    size = np.diff(first, append=len(sigs))
    g = mix(np.add.reduceat(mix(ids.view(np.uint64)), first) + size.astype(np.uint64))
    _, one = np.unique(g, return_index=True)
    one = one[size[one] > 1]
    first, size, g = first[one], size[one], g[one].view(np.int64)
    places = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    ids = ids[places]
    leader = np.lexsort((mix(ids.view(np.uint64)), np.repeat(np.arange(len(size)), size)))
    low = ids[leader[np.cumsum(size) - size]] if len(size) else ids
    schema = pa.schema([("g", pa.int64()), ("id", pa.int64()), ("low", pa.int64())])
    return pa.Table.from_pydict({"g": np.repeat(g, size), "id": ids, "low": np.repeat(low, size)}, schema)


def _may_be_similar(x: str, y: str, percent: int) -> Column:
    """Sizes and parity maps of two sets leave the similarity possible: every bit that differs is an element that does.

    The first words of the maps alone rule out most pairs, so they are looked at before the rest.
    """
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    fits = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    for words in (BITMAP // 8, BITMAP // 2, BITMAP):
        differ = sum(F.bit_count(F.get(f"{x}.bits", F.lit(i)).bitwiseXOR(F.get(f"{y}.bits", F.lit(i)))) for i in range(words))
        fits = fits & ((100 + percent) * differ <= (100 - percent) * (a + b))
    return fits


class _Sets:
    """The different sets of a table of documents: their sketches, and whole sets where they are asked for."""

    def __init__(self, docs: DataFrame, base: DataFrame, percent: int, size: int):
        self.docs, self.percent, self.size = docs, percent, size
        full = base.where("n_shingles > 0 and doc_id is not null")
        same = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first(F.struct("doc_id", "t", "bits", "n_shingles")).alias("x"))
        same = same.select("k1", "k2", "rep", F.col("x.doc_id").alias("at_id"), F.col("x.t").alias("at_t"), F.col("x.bits").alias("bits"), F.col("x.n_shingles").alias("n"))
        self.sketch = durable(same)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and bitmaps leave possible."""
        x, y = self.sketch.select("k1", "n", "bits").alias("x"), self.sketch.select("k1", "n", "bits").alias("y")
        both = pairs.join(x, F.col("a") == F.col("x.k1")).join(y, F.col("b") == F.col("y.k1"))
        return both.where(_may_be_similar("x", "y", self.percent)).select("a", "b").distinct()

    def _rows(self, ids: DataFrame) -> DataFrame:
        """One row of the documents for each of the sets (k1)."""
        rows = durable(self.sketch.join(ids, "k1", "left_semi").select(F.col("at_id").alias("doc_id"), F.col("at_t").alias("t")).distinct())
        small = 64 * rows.count() <= BROADCAST_BYTES
        return self.docs.join(F.broadcast(rows) if small else rows, ["doc_id", "t"], "left_semi")

    def tops(self, ids: DataFrame) -> DataFrame:
        """(id, n, low, top): sizes of the sets ``ids`` and bounds of the sizes of those among them that may be similar."""
        open_sets = self.sketch.join(ids.withColumnRenamed("id", "k1"), "k1", "left_semi")
        buckets = int((open_sets.agg(F.sum("n")).first()[0] or 0) // BUCKET + 1)
        dealt = _dealt(self._rows(ids.withColumnRenamed("id", "k1")).select("doc_id", "text"), self.size, buckets, lambda s: s)
        own = dealt.groupBy("bucket").applyInArrow(_own, "id long, own long").groupBy("id").agg(F.sum("own").alias("own"))
        n, p = F.col("n"), self.percent
        share = n - F.coalesce("own", F.lit(0))  # elements that another set can share at most
        low, top = F.expr(f"({p} * n + 99) div 100"), F.least(F.floor((100 + p) * share / p) - n, F.floor(100 * n / p))
        out = open_sets.select(F.col("k1").alias("id"), "n").join(own, "id", "left")
        return durable(out.select("id", "n", low.alias("low"), top.cast("long").alias("top")))

    def near(self, rest: DataFrame, leaders: int, seed: int) -> DataFrame:
        """(a, b): pairs of sets of open groups that may be similar, with leaders or all; large groups meet in chunks."""
        percent = self.percent
        sizes = rest.groupBy("g").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        rows = rest.join(sizes, "g").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
        other = F.array("chunk") if leaders else F.sequence(F.lit(0), F.col("chunks") - 1)
        rows = rows.withColumn("other", F.explode(other)).withColumn("u", F.least("chunk", "other")).withColumn("v", F.greatest("chunk", "other"))
        rows = rows.join(self.sketch.select(F.col("k1").alias("id"), "bits"), "id").select("g", "u", "v", "id", "component", "n", "top", "chunk", "bits")
        tasks = rest.count() // MAP_ROWS + 1

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([(c, "ascending") for c in ("g", "u", "v")])
            place = np.stack([rows.column(c).to_numpy() for c in ("g", "u", "v")])
            first = np.flatnonzero(np.concatenate((np.ones(1, bool), (place[:, 1:] != place[:, :-1]).any(0))))
            found = [_near(rows.slice(at, many), percent, leaders, seed) for at, many in zip(first.tolist(), np.diff(first, append=len(rows)).tolist())]
            pairs = {c: np.concatenate([x[c] for x in found]) for c in "ab"}
            return pa.Table.from_pydict(pairs, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        return rows.groupBy(F.pmod(F.xxhash64("g", "u", "v"), F.lit(tasks))).applyInArrow(run, "a long, b long").distinct()

    @tidy
    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), a table, whose whole sets are similar enough, as a table."""
        size, percent = self.size, self.percent
        if pairs.isEmpty():
            return pairs
        ids = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            for batch in batches:
                words = FlatWords(batch["text"])
                sets = [distinct(shingle_hashes(words.of(d), size)) for d in range(len(batch["text"]))]
                yield {"k1": [int(_key(s)[0]) for s in sets], "w": [s.tobytes() for s in sets]}

        sets = durable(map_rows(self._rows(ids).select("text"), run, "k1 long, w binary").dropDuplicates(["k1", "w"]))

        def compared(batches: Iterator[dict]) -> Iterator[dict]:
            for batch in batches:
                out: dict[str, list] = {"a": [], "b": []}
                for a, b, one, two in zip(batch["a"], batch["b"], batch["wa"], batch["wb"]):
                    both = np.sort(np.concatenate([np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8")]))
                    same = np.count_nonzero(both[1:] == both[:-1])
                    if 100 * same >= percent * (len(both) - same):
                        out["a"].append(a)
                        out["b"].append(b)
                yield out

        one, two = (sets.select(F.col("k1").alias(x), F.col("w").alias(f"w{x}")) for x in "ab")
        return map_rows(pairs.join(one, "a").join(two, "b"), compared, "a long, b long").distinct()


@tidy
def ngram_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    base = durable(map_rows(docs, lambda b: _described(b, percent, size), BASE + ", bits array<long>"))
    sets = _Sets(docs, base, percent, size)
    buckets = int((base.agg(F.sum("n_sigs")).first()[0] or 0) // BUCKET + 1)
    dealt = _dealt(docs, size, buckets, lambda s: signatures(s, percent))
    found = durable(dealt.groupBy("bucket").applyInArrow(_groups, "g long, id long, low long"))
    pairs = found.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    edges = sets.similar(durable(sets.likely(pairs)))

    # sets that one doc_id has in several rows belong together
    numbered = base.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.collect_set("k1").alias("all"))
    edges = edges.unionByName(durable(numbered.where("a < b").select("a", F.explode("all").alias("b")).where("a <> b")))
    linked = components(edges)
    rest, r, tops = found.select("g", "id").distinct(), 0, None
    while True:
        known = rest.select("g", "id").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = known.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("g")
        rest = durable(known.join(mixed, "g", "left_semi").select("g", "id", "component"))
        if (rows := rest.count()) and tops is None:
            tops = sets.tops(rest.select("id").distinct())
        if rows:
            spread = rest.join(tops, "id").groupBy(F.pmod("g", F.lit(rows // OPEN_ROWS + 1)))
            rest = durable(spread.applyInArrow(_open, "id long, g long, component long, n long, low long, top long"))
        if not rows or rest.isEmpty():
            break
        pairs = durable(sets.near(rest, LEADERS if r < rounds else 0, r))
        more = sets.similar(pairs)
        met, new = pairs.count(), more.count()
        if new:
            edges = edges.unionByName(more)
            linked = components(edges)
        if r >= rounds:
            break
        r = r + 1 if new > LEAST_LINKED * met else rounds  # leaders that link little give way to the full comparison
    reps = sets.sketch.select("k1", "k2", "rep").join(linked.select(F.col("node").alias("k1"), "component"), "k1", "left")
    smallest = reps.where("component is not null").groupBy("component").agg(F.min("rep").alias("first"))
    reps = reps.join(smallest, "component", "left").select("k1", "k2", F.coalesce("first", "rep").alias("first"))
    out = base.select("doc_id", "n_shingles", "k1", "k2").join(reps, ["k1", "k2"], "left")
    # a row without shingles stands where the other rows of its doc_id stand, if there are any
    bare = out.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct()
    others = out.where("n_shingles > 0").join(bare, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("first").alias("of_others"))
    out = out.join(others, "doc_id", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id")).otherwise(F.coalesce("of_others", "doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
