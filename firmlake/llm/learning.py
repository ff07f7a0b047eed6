"""What the classifiers share: the bounded sample of labelled rows, and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.llm.common import bucket, durable


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labelled documents outside the held-out fold, picked by a hash of doc_id.

    The sample is bounded by ``rows`` whatever the corpus holds, so its ids are broadcast to the scan of the texts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (bucket("doc_id", folds) != held_out))
    picked = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return durable(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (bias last) of an L2-penalised logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
