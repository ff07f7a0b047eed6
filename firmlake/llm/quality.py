"""Quality scores by a factorisation machine (operator 4).

Features are hashed words and hashed word shapes, weighted by their frequency, and statistics of the structure and
size of the text. The machine adds to a linear score the interaction of every two features through low-rank factors;
the sum-of-squares identity makes that linear in the number of features of a document.

It is trained in numpy on a bounded sample of labelled rows outside the held-out fold. Null and empty texts have
no words and get a score from their statistics alone. Repeated rows get the same score, and so do ties. A row without
a doc_id is scored and never learned from. Very long texts are read whole. An empty table gives no rows, and without
labelled rows every score is one half. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import FlatWords, bucket, distinct, filtered, map_rows, mix, scratch, table
from firmlake.llm.learning import labelled_sample, sigmoid

#: Buckets of hashed words and shapes, rank of the factors, statistics; labelled rows learned from at most.
BUCKETS = 1 << 14
RANK = 6
STATS = 13
SAMPLE_ROWS = 5_000
THRESHOLD = 0.3
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = 6 if _c >= 128 else 0 if chr(_c).islower() else 1 if chr(_c).isupper() else 2 if chr(_c).isdigit() else 3 if chr(_c).isspace() else 4 if chr(_c) in ".,;:'?-" else 5


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text: words and shapes, weighted by frequency to unit norm, then the statistics."""
    flat = FlatWords(texts)
    buckets = np.concatenate([flat.h % np.uint64(BUCKETS), mix(flat.shapes()) % np.uint64(BUCKETS)]).astype(np.int32)
    size, out = len(flat.h), []
    for i, text in enumerate(texts):
        text = text or ""
        a, b = flat.word_ends[i - 1] if i else 0, flat.word_ends[i]
        at, n = np.unique(np.concatenate([buckets[a:b], buckets[size + a : size + b]]), return_counts=True)
        value = np.log1p(n)
        value = value / max(1e-9, np.sqrt((value * value).sum()))
        raw = text.encode()
        share = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=7) / max(1, len(raw))
        lines, words = text.split("\n"), int(b - a)
        stats = [
            *share, np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5, 1 - len(set(lines)) / len(lines), len(distinct(flat.h[a:b])) / max(1, words),
            n.max() / (2 * words) if words else 0.0, min(20, len(text) / max(1, words)) / 20,
        ]
        out.append((np.concatenate([at, BUCKETS + np.arange(STATS)]).astype(np.int32), np.concatenate([value, stats]).astype(np.float32)))
    return out


class Machine:
    """w0 + w.x + sum over pairs of <v_i, v_j> x_i x_j, the last by half of (sum v x) squared less sum (v x) squared."""

    def __init__(self, bias: float = 0.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.w = bias, np.zeros(BUCKETS + STATS)
        self.v = rng.normal(0, 0.05, (BUCKETS + STATS, RANK))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        s = vx.sum(0)
        return float(self.bias + self.w[at] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.1, decay: float = 1e-5) -> None:
        rng = np.random.default_rng(11)
        gw, gv, g0 = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                at, x, y = rows[r]
                x = x.astype(float)
                v = self.v[at]
                vx = v * x[:, None]
                s = vx.sum(0)
                g = float(sigmoid(self.bias + self.w[at] @ x + 0.5 * (s @ s - (vx * vx).sum()))) - y
                dw, dv = g * x + decay * self.w[at], g * (x[:, None] * s - v * (x * x)[:, None]) + decay * v
                g0 += g * g
                gw[at] += dw * dw
                gv[at] += dv * dv
                self.bias -= rate * g / np.sqrt(g0)
                self.w[at] -= rate * dw / np.sqrt(gw[at])
                self.v[at] -= rate * dv / np.sqrt(gv[at])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """A machine trained on at most ``rows`` labelled rows outside the held-out fold; on none, it scores one half."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = features(batch["text"])
            yield {"doc_id": batch["doc_id"], "y": [int(y) for y in batch["y"]], "at": [a.tobytes() for a, _ in found], "x": [x.tobytes() for _, x in found]}

    with scratch(docs.sparkSession):
        sample = labelled_sample(docs, labels, "quality", rows)
        got = map_rows(sample.select("doc_id", "text", "y"), run, "doc_id long, y int, at binary, x binary").orderBy("doc_id").collect()
    machine = Machine()
    machine.fit([(np.frombuffer(r.at, np.int32), np.frombuffer(r.x, np.float32), r.y) for r in got])
    machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)
    return machine


def score_quality(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = held.value
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "score": sigmoid(np.array([m.score(*x) for x in features(batch["text"])]))}

    got = map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")
    return got.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    return filtered(docs, lambda texts: sigmoid(np.array([held.value.score(*x) for x in features(texts)])) >= threshold)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
