"""What several training-data operators share: tables, durable cuts, word hashes, linked components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.operators.graph import components  # noqa: F401  used by the operators from here, as the next ones
from firmlake.sources.shared import durable, scratch, shared_dir, tidy  # noqa: F401

#: Rows up to which an id list is broadcast; longer lists are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch between Spark and Python, where the session leaves it at Spark's default.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: Bytes of rows that a worker looks at together; its arrays take up to fifty times as much.
PIECE = 5e5
#: How Python workers, which outlive their tasks, hand memory back: large arrays at once, Arrow's with the others.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Lets Python workers of a session that was started elsewhere import this package and hand memory back, and keeps
    batches of whole texts small where the session has no setting of its own."""
    for name, value in {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), **MEMORY}.items():
        spark.sparkContext.environment.setdefault(name, value)
    if spark.conf.get(BATCH_SETTING, None) == "67108864b":  # Spark's default
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Hands back what a worker's finished work has left free between small objects, and what is soon made anew."""
    _POWERS.clear()
    pa.system_memory_pool().release_unused()


def releasing(f: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """``f`` for the large groups of ``applyInArrow``: what one of them took is free before the next."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        try:
            return f(key, rows)
        finally:
            release()

    return run


def semi_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``; the ids are broadcast only while they are few."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def bucket(column: str, mod: int) -> F.Column:
    """crc32 of an id as text, modulo ``mod``: how labelled rows are split into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


class Memo:
    """A bounded word memo that survives between tasks of one Python worker.

    Two generations: when the young one is full it becomes the old one, so frequent words stay.
    """

    def __init__(self, make: Callable[[list[str]], list], limit: int = 400_000):
        self.make, self.limit, self.young, self.old = make, limit // 2, {}, {}

    def look(self, words: list) -> list:
        """The value of each word; what is not known yet is made in one go."""
        out = list(map(self.young.get, words))
        if None in out:
            young, old = self.young, self.old
            missing = {w for w, v in zip(words, out) if v is None}
            if len(young) + len(missing) > self.limit:
                self.old, self.young = old, young = young, {}
                missing = set(words)
            fresh = []
            for w in missing:
                v = old.get(w)
                if v is None:
                    fresh.append(w)
                else:
                    young[w] = v
            young.update(zip(fresh, self.make(fresh)))
            out = list(map(young.__getitem__, words))
        return out


_30, _27, _31, _FIRST, _SECOND = map(np.uint64, (30, 27, 31, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit of an array's numbers over the result."""
    h = (h ^ (h >> _30)) * _FIRST
    h = (h ^ (h >> _27)) * _SECOND
    return h ^ (h >> _31)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; a plain sort is faster here than numpy's hash table."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(1, bool), x[1:] != x[:-1]))] if len(x) else x


def packed(x: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of each unsigned number."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpacked(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1)
#: 1 and 2 for letters, others as they are.
_SHAPE = np.where((_LOWER > 97) & (_LOWER <= 123) | (np.arange(256) >= 128), 1, np.arange(256) + 3).astype(np.uint16)
_SHAPE[65:91] = 2
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def _hashed(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of ``code``: differences of running sums of its numbers times powers, divided by the power at
    a span's start, so that they do not depend on where it stands. ``code`` is used up."""
    power, inverse = _powers(len(code))
    with np.errstate(over="ignore"):
        total = np.zeros(len(code) + 1, np.uint64)
        code *= power[: len(code)]
        np.cumsum(code, out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


class FlatWords:
    """All words of a list of texts as arrays: A-Z lower-cased, ends at ASCII white space.

    ``h``: a 64-bit hash of each word, ``doc``: number of its text, ``line``: number of its line over all texts,
    ``first_line``: number of each text's first line, ``start`` and ``end``: its place in ``data``, the bytes of all
    texts with a line break behind each.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.data = data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = start, end = edge[::2], edge[1::2]
        self.h = _hashed(_LOWER[data], start, end)
        at = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        breaks = np.flatnonzero(data == 10)
        self.word_ends = np.searchsorted(start, at[1:])
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.word_ends, prepend=0))
        line_ends = np.searchsorted(start, breaks)
        self.line = np.repeat(np.arange(len(breaks)), np.diff(line_ends, prepend=0))
        self.first_line = np.searchsorted(breaks, at[:-1])

    def shapes(self) -> np.ndarray:
        """A hash of each word's shape: runs of small letters (and of all signs beyond ASCII) and of capitals as one."""
        code = _SHAPE[self.data]
        kept = np.ones(len(code), bool)
        kept[1:] = (code[1:] != code[:-1]) | (code[1:] > 2)
        place = np.cumsum(kept)
        return _hashed(code[kept].astype(np.uint64), place[self.start] - 1, place[self.end - 1])

    def of(self, i: int) -> np.ndarray:
        """Word hashes of text ``i``."""
        return self.h[(self.word_ends[i - 1] if i else 0) : self.word_ends[i]]


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(_BASE) + h[i : len(h) - n + 1 + i])
    return out


def map_rows(df: DataFrame, f: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str, size: float = PIECE, rows: int = 10_000) -> DataFrame:
    """``mapInArrow`` over plain column lists; batches over ``size`` bytes or ``rows`` rows are cut so that a worker's
    memory stays bounded."""
    from pyspark.sql.types import StructType

    importable(df.sparkSession)
    target = pa.schema([pa.field(x.name, _arrow(x.dataType)) for x in StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[dict[str, list]]:
            for batch in batches:
                step = max(1, min(rows, int(batch.num_rows * min(1.0, size / max(1, batch.nbytes)))))
                for at in range(0, batch.num_rows, step):
                    cut = batch.slice(at, step)
                    yield {name: cut.column(i).to_pylist() for i, name in enumerate(cut.schema.names)}

        try:
            for out in f(pieces()):
                yield pa.RecordBatch.from_pydict(out, schema=target)
        finally:
            release()

    return df.mapInArrow(run, schema)


def filtered(df: DataFrame, keep: Callable[[list], np.ndarray]) -> DataFrame:
    """Rows of ``df`` for whose texts ``keep`` says yes, in one pass over the table and without a join."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                step = max(1, int(batch.num_rows * min(1.0, PIECE / max(1, batch.nbytes))))
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step).filter(pa.array(keep(texts.slice(at, step).to_pylist())))
        finally:
            release()

    return df.mapInArrow(run, df.schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def local_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer's file: in ``folder``, else where the installed ``public_tokenizers`` has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
