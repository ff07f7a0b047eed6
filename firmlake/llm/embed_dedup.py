"""Near-duplicate embeddings by spherical-cap filters (operator 6).

Vectors are rotated at random and split into two blocks. Each block has a code of random unit vectors; every pair of
code words is a filter direction, so a few hundred code words make tens of thousands of directions. A vector is
list-decoded to all directions whose cap holds it: code words of the first block are taken in order of their inner
product, and each is completed by those of the second that still reach the cap. Close vectors share several caps.

Equal vectors are collapsed to one with a count. Members of a filter are dealt into blocks, and pairs of blocks are
multiplied as matrices, so a filter of any size is spread over tasks. A pair counts in the smallest filter that both
have, so no list of pairs is ever written: a block pair gives each vector its number of links there, and edges that
connect what it linked. Pairs of similarity 0.93 share some filter with a probability over 0.999 (see the tests).

Vectors that are null, zero or hold null or non-finite components, and rows without a label or vec_id, link with
nothing. Vectors of different width are not compared. Rows that repeat a vec_id are nodes of their own, with the vector and
label that each has; every distinct vector of a label has a number of its own, and vec_ids come back only at the end. A
null vec_id stays null and is never kept. Of linked vectors the smallest vec_id names the component. An empty table gives
no rows. Only vec_id, label and embedding are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import components, durable, importable, map_rows, table, tidy

COSINE = 0.93
#: Code words of each block at most; directions a vector falls to at least; rows of a block that a task multiplies.
WORDS = 1024
CAPS = 36
#: Lowest useful height of a cap: in few dimensions fewer code words do.
HEIGHT = 0.5
BLOCK = 512
#: Groups up to this size are compared without a matrix product of their own.
SMALL = 16
KEYS = ("label", "width", "cap", "x", "y")
SEED = 20_177
#: Vectors of so few components share one cap: caps are useless there, and blocks of it are compared in full.
FLAT = 4


@lru_cache(16)
def code(width: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """(rotation, code words of both blocks, height of a cap) for vectors of ``width`` components."""
    rng = np.random.default_rng(SEED + width)
    rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
    tail = 0.5 * math.erfc(HEIGHT * math.sqrt(width / 2))
    size = int(min(WORDS, max(16, math.sqrt(CAPS / max(tail, 1e-9)))))
    words = []
    for n in ((width + 1) // 2, width // 2):
        w = rng.normal(size=(size, n))
        words.append(w / np.maximum(1e-12, np.linalg.norm(w, axis=1, keepdims=True)) / np.sqrt(2))
    probe = rng.normal(size=(200, width))
    heights = [np.partition(total.ravel(), -CAPS)[-CAPS] for total in map(np.add.outer, *_products(probe, rotation, words))]
    return rotation, words, float(np.mean(heights))


def _products(x: np.ndarray, rotation: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation
    half = words[0].shape[1]
    return x[:, :half] @ words[0].T, x[:, half:] @ words[1].T


def caps(vectors: np.ndarray) -> list[np.ndarray]:
    """The numbers of all directions whose cap holds each vector; where those are few, its cap is lowered to hold ``CAPS``."""
    if vectors.shape[1] <= FLAT:
        return [np.zeros(1, np.int64)] * len(vectors)
    rotation, words, height = code(vectors.shape[1])
    one, two = _products(vectors, rotation, words)
    size = len(words[0])
    order = np.argsort(-two, axis=1)
    out = []
    for a, b, o in zip(one, two, order):
        reach = np.searchsorted(-b[o], a - height, side="right")
        if reach.sum() < CAPS:
            near = np.argpartition(-a, CAPS - 1)[:CAPS] if size > CAPS else np.arange(size)
            total = a[near][:, None] + b[o[:CAPS]][None, :]
            best = np.argpartition(-total.ravel(), CAPS - 1)[:CAPS]
            out.append(np.sort(near[best // total.shape[1]] * size + o[best % total.shape[1]]))
            continue
        first = np.repeat(np.arange(size), reach)
        rank = np.arange(len(first)) - np.repeat(np.cumsum(reach) - reach, reach)
        out.append(np.sort(first * size + o[rank]))
    return out


def _filtered(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {"rep": [], "filters": []}
        by_width: dict[int, list[int]] = {}
        for k, v in enumerate(batch["v"]):
            by_width.setdefault(len(v), []).append(k)
        for rows in by_width.values():
            for k, f in zip(rows, caps(np.array([batch["v"][k] for k in rows], float))):
                out["rep"].append(batch["rep"][k])
                out["filters"].append(f.astype(np.int32))
        yield out


class _Group:
    """Rows of block pairs as arrays, sorted so that the rows of each pair stand together."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.keys = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in KEYS]
        self.rep, self.copies, self.side = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("rep", "copies", "side"))

    def starts(self) -> np.ndarray:
        n = self.batch.num_rows
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in self.keys])
        return np.flatnonzero(new)

    def vectors(self, a: int, b: int) -> np.ndarray:
        v = self.batch.column(self.batch.schema.get_field_index("v")).slice(a, b - a)
        x = v.flatten().to_numpy().astype(float).reshape(b - a, -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def filters(self, k: int) -> np.ndarray:
        return self.batch.column(self.batch.schema.get_field_index("filters"))[k].values.to_numpy()


def _few(g: _Group, a: int, b: int, sizes: np.ndarray, cosine: float, out: list) -> None:
    """All small groups between two rows: pairs at every distance within a group, all groups at once."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    u, cap = g.vectors(a, b), g.keys[2]
    same_block = (g.keys[3] == g.keys[4])[a:b]
    for apart in range(1, int(sizes.max())):
        i = np.flatnonzero(group[:-apart] == group[apart:])
        i = i[(same_block[i] | (g.side[a + i] != g.side[a + i + apart])) & (g.rep[a + i] != g.rep[a + i + apart])]
        i = i[np.einsum("ij,ij->i", u[i], u[i + apart]) >= cosine]
        for p in (a + i).tolist():
            q = p + apart
            mine = np.intersect1d(g.filters(p), g.filters(q), assume_unique=True)[0] == cap[p]
            r, s = int(g.rep[p]), int(g.rep[q])
            out.append((r, int(g.copies[q]) if mine else 0, min(r, s)))
            out.append((s, int(g.copies[p]) if mine else 0, min(r, s)))


def _many(g: _Group, a: int, b: int, cosine: float, out: list) -> None:
    """One large block pair: a product of matrices, links counted in the smallest common filter."""
    f, same = g.keys[2][a], g.keys[3][a] == g.keys[4][a]
    rows = np.arange(a, b)
    left = rows if same else rows[g.side[a:b] == 0]
    right = left if same else rows[g.side[a:b] == 1]
    if not len(left) or not len(right):
        return
    u = g.vectors(a, b)
    r, s = g.rep[left], g.rep[right]
    near = (u[left - a] @ u[right - a].T >= cosine) & (r[:, None] != s[None, :])
    if not near.any():
        return
    lower = {k: (fs := g.filters(k))[fs < f].tolist() for k in {*left.tolist(), *right.tolist()}}
    number = {z: k for k, z in enumerate({z for fs in lower.values() for z in fs})}
    counted = near
    if number:
        def has(some: np.ndarray) -> np.ndarray:
            m = np.zeros((len(some), len(number)), np.float32)
            for k, row in enumerate(some.tolist()):
                m[k, [number[z] for z in lower[row]]] = 1
            return m

        counted = near & ~(has(left) @ has(right).T > 0.5)
    top = np.iinfo(np.int64).max
    low = np.minimum(r, np.where(near, s[None, :], top).min(1))
    while True:
        other = np.minimum(s, np.where(near, low[:, None], top).min(0))
        again = np.minimum(low, np.where(near, other[None, :], top).min(1))
        if (again == low).all():
            break
        low = again
    out += zip(r.tolist(), (counted @ g.copies[right]).tolist(), low.tolist())
    if not same:
        out += zip(s.tolist(), (g.copies[left] @ counted).tolist(), other.tolist())


def _linked(cosine: float):
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        g = _Group(batch)
        starts = g.starts()
        ends = np.append(starts[1:], batch.num_rows)
        out: list[tuple[int, int, int]] = []
        width, sizes = g.keys[1], ends - starts
        at = 0
        while at < len(starts):
            if sizes[at] > SMALL:
                _many(g, int(starts[at]), int(ends[at]), cosine, out)
                at += 1
                continue
            to = at + 1
            while to < len(starts) and sizes[to] <= SMALL and width[starts[to]] == width[starts[at]]:
                to += 1
            _few(g, int(starts[at]), int(ends[to - 1]), sizes[at:to], cosine, out)
            at = to
        out = [x for x in out if x[1] or x[0] != x[2]]
        return pa.RecordBatch.from_pydict(dict(zip(("rep", "n", "to"), map(list, zip(*out)))) if out else {"rep": [], "n": [], "to": []}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks may straddle batches: rows of the last one wait for the next batch."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0]
            last = int(_Group(joined).starts()[-1])
            if last:
                yield whole(joined.slice(0, last))
            rest = [joined.slice(last)]
        if rest:
            yield whole(rest[0])

    return run


@tidy
def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    importable(vectors.sparkSession)
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda z: z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))) & F.exists(e, lambda z: z != 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"),
        F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)).alias("fine"),
    )
    key = F.when(F.col("fine"), F.sha2(F.to_json(F.struct("label", F.transform("v", lambda z: z.cast("double") + 0.0).alias("v"))), 256))
    rows = rows.withColumn("key", key)
    reps = rows.where("fine").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    reps = durable(reps.withColumn("rep", F.monotonically_increasing_id()))
    capped = map_rows(reps.select("rep", "v"), _filtered, "rep long, filters array<int>")
    capped = durable(reps.select("rep", "label", "copies", "v").join(capped, "rep"))
    members = capped.select("rep", "label", F.size("v").alias("width"), F.explode("filters").alias("cap"))
    sizes = members.groupBy("label", "width", "cap").agg(F.count("*").alias("members")).where("members > 1")
    sizes = sizes.select("label", "width", "cap", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, ["label", "width", "cap"]).withColumn("z", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("z", o).alias("x"), F.greatest("z", o).alias("y"), F.when(F.col("z") <= o, 0).otherwise(1).alias("side")),
    )
    sent = placed.select("rep", "label", "width", "cap", F.explode(pairs).alias("p")).select("rep", "label", "width", "cap", "p.*")
    sent = sent.join(capped.select("rep", "copies", "v", "filters"), "rep")
    dealt = sent.select(*KEYS, "rep", "copies", "side", "v", "filters").repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = durable(dealt.mapInArrow(_linked(cosine), "rep long, n long, to long"))
    links = found.groupBy("rep").agg(F.sum("n").alias("links"))
    linked = components(found.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "rep")
    lows = linked.join(reps.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("least"))
    reps = reps.select("key", "rep", "low", "copies").join(links, "rep", "left").join(linked, "rep", "left").join(lows, "component", "left")
    out = rows.select("vec_id", "key").join(reps, "key", "left").select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "low", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
