"""Clustering of vectors around integer centroids, with ns-bounds (operator 12).

Lloyd's rounds in exact integer arithmetic. Every vector keeps, for each centroid, the squared distance as it was last
worked out and the round in which that was. The history of all centroids is kept (a few kilobytes), so a stored distance
can be loosened by the norm of the centroid's total displacement since that round; the sum of its moves from round to
round, which is never smaller and mostly larger, is not needed. The distance to the own centroid, loosened upwards, is an
upper bound, the others, loosened downwards, are lower bounds. A vector whose upper bound stays below all lower bounds
keeps its centroid unseen. Else its own distance is worked out anew, then exactly those centroids whose lower bound it
still reaches. Bounds are floating point with a margin for rounding; what decides is always the integer distance, and of
equal ones the smaller number of a centroid.

A round reads the vectors with their bounds, writes them with new ones, and adds up only the vectors that changed
centroid, in partial sums by task; the driver sees sums of k times the width. Nothing is grouped by vector, so copies of
one vector spread like others.

Kept are vectors with exactly the given width whose components are finite; others give no row. A scaled component of
2 ** 27 or more in size counts as not finite: its squared distances would not fit a long. Fewer vectors than centroids
give as many centroids; an empty table gives no rows. Rows that repeat a vec_id are vectors of their own (of equal
hashes, the smaller vector starts first); a null vec_id is hashed as no digits and stays null. Sums of distances that do
not fit a long are null. Only vec_id and embedding are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import durable, importable, table, tidy

K, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, 1
#: Scaled components stay below this in size.
LIMIT = 1 << 27
#: Relative and absolute margin of bounds against rounding.
MARGIN = 1e-9
#: Vectors that a task holds as arrays at once.
ROWS = 8192


class Bounds:
    """Squared distances to ``k`` centroids as last worked out, with the round of each, for a batch of vectors."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, squared: np.ndarray, seen: np.ndarray, evaluated: np.ndarray):
        self.x, self.cluster, self.squared, self.seen, self.evaluated = x, cluster, squared, seen, evaluated

    @classmethod
    def fresh(cls, x: np.ndarray, k: int) -> Bounds:
        n = len(x)
        return cls(x, np.full(n, -1, np.int32), np.zeros((n, k), np.int64), np.full((n, k), -1, np.int8), np.zeros(n, np.int64))

    def _exact(self, rows: np.ndarray, columns: np.ndarray, now: int, centroids: np.ndarray) -> None:
        d = self.x[rows] - centroids[columns]
        self.squared[rows, columns] = np.einsum("ij,ij->i", d, d)
        self.seen[rows, columns] = now
        np.add.at(self.evaluated, rows, 1)

    def assign(self, history: np.ndarray) -> None:
        """Moves every vector to the nearest of the last centroids of ``history`` (rounds, k, width)."""
        now, k = len(history) - 1, history.shape[1]
        centroids, every = history[-1], np.arange(k)
        if not len(self.x):
            return
        if now == 0:
            rows = np.arange(len(self.x))
            for c in every:
                self._exact(rows, np.full(len(rows), c), 0, centroids)
            self.cluster[:] = self.squared.argmin(1)
            return
        moved = np.sqrt(((history[-1][None] - history).astype(float) ** 2).sum(2))  # of each centroid since each round
        loose = moved[self.seen, every[None, :]]
        root = np.sqrt(self.squared.astype(float))
        lower = (root - loose) * (1 - MARGIN) - MARGIN
        rows, own = np.arange(len(self.x)), self.cluster
        upper = (root + loose)[rows, own] * (1 + MARGIN) + MARGIN
        lower[rows, own] = np.inf
        failed = np.flatnonzero(lower.min(1) <= upper)
        if not len(failed):
            return
        self._exact(failed, own[failed], now, centroids)
        upper = np.sqrt(self.squared[failed, own[failed]].astype(float)) * (1 + MARGIN) + MARGIN
        i, c = np.nonzero(lower[failed] <= upper[:, None])
        self._exact(failed[i], c, now, centroids)
        known = np.where(self.seen[failed] == now, self.squared[failed], np.iinfo(np.int64).max)
        self.cluster[failed] = known.argmin(1)  # the first of equal ones


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind)


def _rows(array: np.ndarray) -> pa.Array:
    width = array.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, width * (len(array) + 1), width, dtype=np.int32)), pa.array(array.ravel()))


_STATE = "vec_id long, v array<int>, cluster int, was int, squared array<long>, seen array<byte>, evaluated long"


def _round(rows: DataFrame, history: np.ndarray) -> DataFrame:
    """Rows (vec_id, v, and what an earlier round left) with the centroids of ``history`` applied."""
    first, (_, k, width) = len(history) == 1, history.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                x = _matrix(column["v"], width, np.int64)
                if first:
                    state = Bounds.fresh(x, k)
                else:
                    state = Bounds(x, column["cluster"].to_numpy().copy(), _matrix(column["squared"], k, np.int64), _matrix(column["seen"], k, np.int8), column["evaluated"].to_numpy().copy())
                was = state.cluster.copy()
                state.assign(history)
                out = [column["vec_id"], column["v"], pa.array(state.cluster), pa.array(was), _rows(state.squared), _rows(state.seen), pa.array(state.evaluated)]
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", "v", "cluster", "was", "squared", "seen", "evaluated"])

    return rows.mapInArrow(run, _STATE)


def _moves(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, list[list[int]]]:
    """How counts and sums of clusters change by the vectors that changed cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), object)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _matrix(batch.column(0), width, float)
                for column, sign in ((1, 1), (2, -1)):
                    is_in = np.arange(k)[:, None] == batch.column(column).to_numpy()[None, :]
                    count += sign * is_in.sum(1)
                    total += sign * (is_in.astype(float) @ x).astype(np.int64)  # exact: 8192 numbers below 2 ** 27
        if count.any() or total.any():
            rows = [(c, j, str(v)) for c in range(k) for j, v in enumerate([count[c], *total[c]]) if v]
            yield pa.RecordBatch.from_pydict(dict(zip("cjs", map(list, zip(*rows)))), schema=pa.schema([("c", pa.int32()), ("j", pa.int32()), ("s", pa.string())]))

    part = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "c int, j int, s string")
    count, total = np.zeros(k, np.int64), [[0] * width for _ in range(k)]
    for c, j, s in part.groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect():
        if j:
            total[c][j - 1] = int(s)
        else:
            count[c] = int(s)
    return count, total


@tidy
def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, evaluated) for every kept row of ``vectors``
    (vec_id, embedding), whose components count as floor(scale * x).

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:vec_id``; each of ``rounds`` assigns all
    vectors and moves every non-empty centroid to the floor of its mean; then they are assigned once more. ``evaluated``:
    how many distances of the vector were worked out in all.
    """
    importable(vectors.sparkSession)
    if rounds > np.iinfo(np.int8).max:
        raise ValueError("bounds number their rounds by one byte")
    scaled = F.transform("embedding", lambda z: F.floor(z.cast("double") * scale))
    fine = (F.size("embedding") == width) & F.forall("embedding", lambda z: z.isNotNull() & ~F.isnan(z) & (F.abs(z.cast("double") * scale) < LIMIT))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda z: z.cast("int")).alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = [r.v for r in rows.orderBy(digest, "v").limit(k).collect()]
    if not starts:
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, evaluated long")
    k, history = len(starts), np.array([starts], np.int64)
    state, count, total = rows, np.zeros(k, np.int64), [[0] * width for _ in range(k)]
    for _ in range(rounds):
        state = durable(_round(state, history))
        more, sums = _moves(state, k, width)
        count = count + more
        total = [[a + b for a, b in zip(x, y)] for x, y in zip(total, sums)]
        moved = [[a // int(n) for a in t] if n else old for n, t, old in zip(count.tolist(), total, history[-1].tolist())]
        history = np.concatenate((history, np.array([moved], np.int64)))
    state = durable(_round(state, history))
    final = rows.sparkSession.createDataFrame(list(enumerate(history[-1].tolist())), "cluster int, centroid array<long>")
    square = F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a.cast("long") - b) * (a.cast("long") - b)), F.lit(0).cast("long"), lambda s, z: s + z)
    found = state.select("vec_id", "v", "cluster", "evaluated").join(F.broadcast(final), "cluster").withColumn("distance", square).drop("v")
    wide = F.col("distance").cast("decimal(38,0)")
    each = found.groupBy("cluster").agg(F.sum(wide).alias("one"))  # at most k rows
    each = each.crossJoin(F.broadcast(found.agg(F.sum(wide).alias("whole"))))  # one row
    each = each.select("cluster", F.col("one").try_cast("long").alias("cluster_inertia"), F.col("whole").try_cast("long").alias("inertia"))
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "evaluated")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _sql() -> str:
    """All rounds as common table expressions over (vector, component) rows."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda z: floor({SCALE} * z::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z))) = {WIDTH})",
        "flat AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept)",
        f"first AS (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR)) - 1 AS c FROM kept QUALIFY c < {K})",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM first)",
    ]
    for i in range(ROUNDS + 1):
        parts += [
            f"d{i} AS (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM flat JOIN c{i} USING (j) GROUP BY r, c)",
            f"a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)",
        ]
        if i < ROUNDS:
            # floor of a quotient, exactly: less its remainder, brought to 0 or more
            parts.append(f"m{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} JOIN flat USING (r) GROUP BY c, j)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, c{i}.j, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{i} LEFT JOIN m{i} USING (c, j))")
    last = ROUNDS
    parts.append(f"names AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{last} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{last} JOIN kept USING (r) JOIN names USING (c)"""


OP12_SQL = _sql()
