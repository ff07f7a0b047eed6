"""Language identification by averaged hashed subword embeddings and a linear softmax (operator 5).

A text is the average of the embeddings of its words' hashed character n-grams; a linear softmax over languages
reads it. Both are trained together by stochastic gradient descent in numpy on a bounded sample. A part of the
sample that training leaves out sets the temperature of the probabilities and the confidence below which a text is
rejected. Because the model is linear in the n-grams, scoring adds up one short vector for each word.

Null texts and texts without a letter are `und` with score 0 and rejected, as are all texts if no language was
learned. Repeated rows get the same answer; of languages that tie, the first by name wins. A row without a doc_id is
recognised and never learned from. Very long texts are read whole. An empty table gives no rows. Only doc_id, text
and, for learning, lang are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import FlatWords, bucket, durable, filtered, map_rows, mix, scratch, table

#: Hash buckets and width of the embeddings; n-gram lengths; documents learned from at most.
BUCKETS = 1 << 15
WIDTH = 12
GRAMS = (1, 2, 3, 4)
SAMPLE_ROWS = 2_000
#: A text is rejected below the confidence that this share of rightly recognised left-out texts stays under.
REJECT_SHARE = 0.001
UNKNOWN = "und"
_LETTER: np.ndarray | None = None


def grams(words: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of its word) of all n-grams of the runs of letters in ``words``, which stand between marks.

    Each word has a mark before and one behind it; an n-gram may hold a mark only at its ends.
    """
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    code = np.frombuffer(words.encode("utf-32-le"), np.uint32)
    word = (np.cumsum(code == 1) - 1) // 2
    letter = _LETTER[code]
    code = np.where(letter, code, 1).astype(np.uint64)
    buckets, owners = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    h, inner = np.zeros(len(code), np.uint64), np.ones(len(code), bool)
    for n in range(1, max(GRAMS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            h = h[:m] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        if n > 2:
            inner = inner[:m] & letter[n - 2 : n - 2 + m]
        fine = inner[:m] & (letter[:m] | letter[n - 1 :])
        if n in GRAMS:
            buckets.append((mix(h[fine]) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(word[:m][fine])
    return np.concatenate(buckets), np.concatenate(owners)


def marked(words: list[str]) -> str:
    return "".join([f"\x01{w}\x01" for w in words])


@dataclass
class Model:
    """Bucket-by-language logits, their bias, and what calibration found."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], epochs: int = 8, rate: float = 0.5) -> Model:
    """Embeddings and softmax by SGD over (buckets, counts, language) rows; every fifth row only calibrates."""
    rng = np.random.default_rng(5)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (len(languages), WIDTH)), np.zeros(len(languages))
    learn = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 10]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for r in rng.permutation(len(learn)):
            at, n, y = learn[r]
            x = n / n.sum()
            h = x @ e[at]
            z = w @ h + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ w
            w -= step * np.outer(p, h)
            b -= step * 0.1 * p
            e[at] -= step * 20 * x[:, None] * back
    model = Model(languages, (e @ w.T).astype(np.float32), b)
    left_out = [r for i, r in enumerate(rows) if i % 5 == 0] if len(rows) >= 10 else rows
    if left_out:
        means = np.array([(n / n.sum()) @ model.logits[at] for at, n, _ in left_out])
        truth = np.array([y for _, _, y in left_out])
        losses = []
        for t in (grid := np.geomspace(0.05, 20, 60)):
            model.temperature = float(t)
            losses.append(-np.log(np.maximum(model.probabilities(means)[np.arange(len(truth)), truth], 1e-12)).mean())
        model.temperature = float(grid[int(np.argmin(losses))])
        p = model.probabilities(means)
        right = p.max(1)[p.argmax(1) == truth]
        if len(right):
            model.reject_below = float(min(0.5, np.quantile(right, REJECT_SHARE)))
    return model


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, folds: int = 4, held_out: int = 2) -> Model:
    """Learns from at most ``rows`` documents with a language outside the held-out fold, picked by a hash of doc_id."""
    with scratch(docs.sparkSession):
        known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (bucket("doc_id", folds) != held_out))
        ids = known.select(F.col("doc_id").cast("long").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
        sample = durable(known.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]))
        languages = [r.lang for r in sample.select("lang").distinct().orderBy("lang").collect()]
        number = {x: i for i, x in enumerate(languages)}

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            for batch in batches:
                out: dict[str, list] = {"doc_id": [], "y": [], "at": [], "n": []}
                for i, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
                    at, n = np.unique(grams(marked(_lower(text).split()))[0], return_counts=True)
                    if len(at):
                        for k, v in zip(out, (i, number[lang], at.tobytes(), n.astype(np.int32).tobytes())):
                            out[k].append(v)
                yield out

        got = map_rows(sample.select("doc_id", "text", "lang"), run, "doc_id long, y int, at binary, n binary").orderBy("doc_id").collect()
        return train([(np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.int32), r.y) for r in got], languages)


def _lower(text: str | None) -> str:
    return (text or "").lower().replace("\x01", " ")


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, confidence, rejected) of each text: every different word of all texts is looked at once."""
    flat, width = FlatWords([_lower(t) for t in texts]), len(model.languages)
    sums = np.zeros((len(texts), width + 1))
    if len(flat.h) and width:
        _, first, which = np.unique(flat.h, return_index=True, return_inverse=True)
        raw = flat.data.tobytes()
        words = b"".join([b"\x01%b\x01" % raw[a:b] for a, b in zip(flat.start[first].tolist(), flat.end[first].tolist())])
        at, owner = grams(words.decode())
        for k in range(width + 1):
            of_word = np.bincount(owner, model.logits[at, k] if k < width else None, minlength=len(first))
            sums[:, k] = np.bincount(flat.doc, of_word[which], minlength=len(texts))
    out = []
    for s in sums:
        if not s[-1]:
            out.append((UNKNOWN, 0.0, True))
            continue
        p = model.probabilities(s[:-1] / s[-1])
        best = int(p.argmax())
        out.append((model.languages[best], float(p[best]), bool(p[best] < model.reject_below)))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = predict(held.value, batch["text"])
            yield {"doc_id": batch["doc_id"], "lang_pred": [x for x, _, _ in found], "score": [x for _, x, _ in found], "rejected": [x for _, _, x in found]}

    got = map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")
    return got.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda texts: np.array([not rejected for _, _, rejected in predict(held.value, texts)]))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
