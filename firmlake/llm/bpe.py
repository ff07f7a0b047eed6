"""BPE encoding and decoding with content-defined chunk reuse (operator 9).

A rolling hash cuts every text where its last 16 bytes say so, so that copies and shared passages are cut alike
wherever they stand. Every chunk is encoded on its own, whatever its script, and its ids serve all its occurrences:
chunks that the corpus repeats are counted with Spark, the most useful ones, up to a fixed number and length, are
encoded once and handed to all tasks, and others go through a bounded memo of each worker. Either way the result is
the same; only the work saved differs.

A word may reach across a cut, so chunks joined as they are would be wrong. A join is repaired by encoding a window
around it again: from a place in the left chunk to one in the right, both before a blank that follows a visible sign,
where a word ends in any context. The window's first word must get the tokens that the left chunk has there, and its
last word those of the right chunk; while they differ, it grows by a word on each side. A chunk without such places
becomes part of the window, up to the whole text.

Null texts count as empty: no tokens, hashes of nothing. Repeated rows give repeated results, ties cannot arise, an
empty table gives no rows, a null doc_id stays null. Very long texts are cut into chunks like others. Columns other
than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import local_path, map_rows, table

#: How byte-level BPE splits a text before merging (a fixed value of the public tokenizer).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters up to here are classed alike by every Unicode version; chunks with others go to the tokenizers library.
PLAIN_END = "ɐ"
ODD = regex.compile(rf"[^\x00-{PLAIN_END}]")
#: Chunks that the whole cluster shares: how many and how long at most, so 32 MiB of text and four times that of ids
#: at the very worst; and the mask of the rolling hash, for chunks of 1 KiB on average.
SHARED_CHUNKS = 8_192
SHARED_BYTES = 4_096
CHUNK_MASK = 0x3FF
#: Chunks that a worker remembers.
REMEMBERED = 8_000
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Visible ASCII signs and last bytes of longer characters, but for those in which some Unicode blank ends.
_FIRM = ((np.arange(256) > 0x20) & (np.arange(256) < 0x7F)) | ((np.arange(256) >= 0x80) & ~np.isin(np.arange(256), [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]))

_OPEN: dict[str, object] = {}


def opened(path: str):
    """The tokenizers library's tokenizer of a file; once a worker."""
    if path not in _OPEN:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _OPEN[path] = t
    return _OPEN[path]


def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; added tokens stand for their own text."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(keep))}
    spec = json.load(open(path, encoding="utf-8"))
    added = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    size = max([*spec["model"]["vocab"].values(), *added]) + 1
    out = [b""] * size
    for token, i in spec["model"]["vocab"].items():
        out[i] = added.get(i) or bytes(back[c] for c in token)
    return [added.get(i, x) for i, x in enumerate(out)]


class ByteEncoder:
    """Encodes texts by chunks. ``path`` is the tokenizers file; the ranks of the same name serve plain characters.

    Without such ranks beside it, everything goes to the tokenizers library.
    """

    def __init__(self, path: str):
        self.library, self.bytes, self.fast = opened(path), byte_table(path), None
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[bytes, np.ndarray] = {}
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("chunks", pat_str=WORDS, mergeable_ranks=merges, special_tokens={})

    def plain(self, raw: bytes) -> np.ndarray:
        """Ids of a whole piece of text."""
        text = raw.decode()
        if self.fast is None or ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def chunk(self, raw: bytes, shared: dict[bytes, np.ndarray]) -> np.ndarray:
        """Ids of a chunk, from where they are known already."""
        key = xxhash.xxh3_128_digest(raw)
        got = shared.get(key)
        if got is None:
            got = self.known.get(key)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[key] = self.plain(raw)
        return got

    def encode(self, text: str, shared: dict[bytes, np.ndarray]) -> np.ndarray:
        """Ids of a whole text, from chunks and repaired joins."""
        raw = text.encode()
        ends = chunk_ends(raw)
        if len(ends) < 2 or any(s in text for s in self.special):
            return self.plain(raw)
        places = word_ends(raw)
        # ``left``: ids of the last chunk and where each ends, right from ``since`` on; None if a window swallowed it
        out, left, since, at = [], None, 0, 0
        for end in ends:
            ids = self.chunk(raw[at:end], shared)
            right = ids, at + np.cumsum(self.sizes[ids])
            if not at:
                left, at = right, end
                continue
            before, after = np.searchsorted(places, [at, at + 1])
            for grown in range(1, len(places) + 2):
                i, k = before - 1 - grown, after + grown
                start = int(places[i]) if i >= 0 and places[i] > since and left else since
                if k >= len(places) or places[k] >= end:
                    break
                stop = int(places[k])
                window = self.plain(raw[start:stop])
                ending = start + np.cumsum(self.sizes[window])
                agreed = start == since or _same(left, (window, ending), start, int(places[i + 1]))
                if agreed and _same(right, (window, ending), int(places[k - 1]), stop):
                    break
            else:
                k = len(places)
            if left:
                a, b = np.searchsorted(left[1], [since, start], "right")
                out.append(left[0][a:b])
            if k >= len(places) or places[k] >= end:
                left, since = None, start
            else:
                out.append(window)
                left, since = right, stop
            at = end
        out.append(left[0][np.searchsorted(left[1], since, "right") :] if left else self.plain(raw[since:]))
        return np.concatenate(out)

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def _same(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], start: int, stop: int) -> bool:
    """Two lists of ids hold the same ones, ending at the same places, from ``start`` to ``stop``."""
    (a, b), (c, d) = (np.searchsorted(x[1], [start, stop], "right") for x in (one, two))
    return np.array_equal(one[0][a:b], two[0][c:d]) and np.array_equal(one[1][a:b], two[1][c:d])


def cuts(data: np.ndarray, mask: int = CHUNK_MASK) -> np.ndarray:
    """Offsets behind which a rolling hash of the last 16 bytes ends a chunk."""
    h = data.astype(np.uint32)
    with np.errstate(over="ignore"):
        h = (h + np.uint32(1)) * np.uint32(0x9E3779B1)
        factor = 0x01000193
        for step in (1, 2, 4, 8):
            if len(h) <= step:
                break
            shifted = h[:-step] * np.uint32(factor)
            h = h.copy()
            h[step:] += shifted
            factor = factor * factor % (1 << 32)
        h ^= h >> np.uint32(15)
    return np.flatnonzero((h & np.uint32(mask)) == 0) + 1


def chunk_ends(raw: bytes, mask: int = CHUNK_MASK) -> list[int]:
    """Where the chunks of a text end: behind a cut, and behind the character that it falls in."""
    data = np.frombuffer(raw, np.uint8)
    ends = cuts(data, mask)
    inside = np.append((data & 0xC0) == 0x80, False)
    while inside[ends].any():
        ends = ends + inside[ends]
    return [*np.unique(ends[ends < len(data)]).tolist(), *([len(data)] if len(data) else [])]


def word_ends(raw: bytes) -> np.ndarray:
    """Offsets of the blanks that follow a visible sign: a word ends there whatever stands around it."""
    data = np.frombuffer(raw, np.uint8)
    return np.flatnonzero(_BLANK[data[1:]] & _FIRM[data[:-1]]) + 1


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def _chunks(text: str | None) -> Iterator[tuple[bytes, bytes]]:
    """(key, bytes) of the chunks of a text that may be shared."""
    raw, at = (text or "").encode(), 0
    for end in chunk_ends(raw):
        if end - at <= SHARED_BYTES:
            yield xxhash.xxh3_128_digest(raw[at:end]), raw[at:end]
        at = end


def shared_chunks(docs: DataFrame, path: str, limit: int = SHARED_CHUNKS) -> list[tuple[bytes, bytes]]:
    """(hash, ids) of the ``limit`` chunks whose reuse saves most, each encoded once.

    Occurrences are counted with partial sums, so a chunk in a third of all texts is one row a task.
    """
    def occurrences(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            seen: dict[bytes, list] = {}
            for i, text in zip(batch["doc_id"], batch["text"]):
                for key, raw in _chunks(text):
                    x = seen.setdefault(key, [i, len(raw), 0])
                    x[2] += 1
            yield {"key": list(seen), "owner": [x[0] for x in seen.values()], "size": [x[1] for x in seen.values()], "n": [x[2] for x in seen.values()]}

    rows = map_rows(docs.select("doc_id", "text"), occurrences, "key binary, owner long, size long, n long")
    best = (
        rows.groupBy("key").agg(F.min("owner").alias("owner"), F.max("size").alias("size"), F.sum("n").alias("n"))
        .where("n > 1 and owner is not null").orderBy(F.desc(F.expr("(n - 1) * size")), "key").limit(limit).collect()
    )
    wanted = {bytes(r.key) for r in best}
    if not wanted:
        return []
    owners = docs.sparkSession.createDataFrame([(i,) for i in {r.owner for r in best}], "doc_id long")
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def encoded(batches: Iterator[dict]) -> Iterator[dict]:
        e = encoder(path)
        for batch in batches:
            found = {key: raw for text in batch["text"] for key, raw in _chunks(text) if key in held.value}
            yield {"key": list(found), "ids": [e.plain(raw).tobytes() for raw in found.values()]}

    mine = docs.select("doc_id", "text").join(F.broadcast(owners), "doc_id", "left_semi")
    got = map_rows(mine, encoded, "key binary, ids binary").groupBy("key").agg(F.first("ids").alias("ids"))
    return [(bytes(r.key), bytes(r.ids)) for r in got.collect()]


def encode_documents(docs: DataFrame, path: str | None = None, limit: int = SHARED_CHUNKS, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every row of ``docs``."""
    path = path or local_path("byte_bpe_50k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, limit))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        e = encoder(path)
        known = {k: np.frombuffer(x, np.uint32) for k, x in shared.value}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if with_ids else ()))}
            for i, text in zip(batch["doc_id"], batch["text"]):
                ids = e.encode(text or "", known)
                back = e.decoded(ids)
                out["doc_id"].append(i)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    out["ids"].append(ids.tolist())
                    out["decoded"].append(back.decode("utf-8", "replace"))
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return map_rows(docs, run, schema)


def op9_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
