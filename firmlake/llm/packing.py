"""Best-fit packing of token sequences by hierarchical residual packing (operator 10).

Every partition packs its pieces best-fit, longest first. Bins that are nearly full are final; the others
become items, as long as what they hold, and a tree of fewer groups packs those again. A group holds a bounded
number of items on every level: while many bins stay open, there are many groups, and the tree ends when one group
holds all of them or a level saves next to nothing. So no task sees the whole input.

Null and empty texts are one token, the closing id. Repeated rows are packed as often as they occur, and a null
doc_id stays null. Of items of one length, the smaller number goes first. Very long texts are cut into pieces. An
empty table gives no rows. Columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.bpe import opened
from firmlake.llm.common import Memo, durable, importable, local_path, map_rows, table, tidy

CAPACITY = 4096
CLOSING_ID = 1
#: Items that one task packs.
GROUP_ITEMS = 40_000
#: A bin goes up the tree while this many tokens or more are free in it; the tree ends when a level saves less than
#: this share of the open bins.
SLACK = 8
LEAST_SAVED = 0.005
#: How the tokenizer splits a lower-case text of plain characters, and what marks the end of a word in its vocabulary
#: (fixed values of the public tokenizer).
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ɏ0-9²³¹¼-¾]+")
WORD_END = "</w>"
#: Characters beyond those that every Unicode version classes and lower-cases alike.
ODD = re.compile("[^\x00-įı-ɏ]")
#: Characters that Python takes as white space and the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def word_ranks(path: str) -> tuple[np.ndarray, dict[bytes, int]]:
    """(id of each rank, rank of each word or part of one) of the tokenizer's file; read once for the whole cluster."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(keep))}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    # a word's last sign and the mark of its end are one sign from the start, so these come first
    tokens = [t for t in model["vocab"] if len(t) == 1 + len(WORD_END) and t.endswith(WORD_END)] + [t for t in model["vocab"] if len(t) == 1]
    tokens += ["".join(m) for m in merged]
    ranks = {bytes(back[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END): i for i, t in enumerate(tokens)}
    return np.array([model["vocab"][t] for t in tokens], np.uint32), ranks


class WordEncoder:
    """Ids of texts under a tokenizer of words that drops white space.

    The words of plain characters, each with a blank in place of the mark of its end, go through the same merges as
    byte ranks, far faster and with the same ids. Words with other characters go to the tokenizers library, as do
    whole texts that may hold special tokens.
    """

    def __init__(self, path: str, read: tuple[np.ndarray, dict[bytes, int]] | None = None):
        import tiktoken

        self.path, self.odd = path, Memo(self._words, 50_000)
        self.ids, ranks = read or word_ranks(path)
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):
        """Opened where a text needs it, as it takes more memory than all else here."""
        return opened(self.path)

    def _words(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, text: str) -> np.ndarray:
        words = WORDS.findall(text.lower())
        return self.ids[self.fast.encode_ordinary(" ".join(words) + " ")] if words else np.empty(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if ODD_SPACE.search(text) or "<|" in text:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if not ODD.search(text):
            return self._plain(text)
        words = text.split()
        at = [i for i, w in enumerate(words) if ODD.search(w)]
        out, done = [], 0
        for i, ids in zip(at, self.odd.look([words[i] for i in at])):
            out += [self._plain(" ".join(words[done:i])), np.array(ids, np.uint32)]
            done = i + 1
        return np.concatenate([*out, self._plain(" ".join(words[done:]))])


_ENCODERS: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, closing: int = CLOSING_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, cut only where it is too long."""
    path = path or local_path("word_bpe_49k.json")
    held = docs.sparkSession.sparkContext.broadcast(word_ranks(path))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path, held.value)
        e = _ENCODERS[path]
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                ids = memoryview(np.append(e.encode(text or ""), np.uint32(closing)).astype("<u4").tobytes())
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*rows))))

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset of each item, fill of each bin): longest first, each into the fullest bin that has room."""
    at_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room = mask >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            b = at_free[free].pop()
            if not at_free[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = free - size
        if left:
            at_free[left].append(b)
            mask |= 1 << left
    return bins, offsets, fills


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, slack: int = SLACK) -> DataFrame:
    """Adds sequence_id and offset to ``items`` (item long unique, length long at most ``capacity``)."""
    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", kind="stable")
        bins, offsets, fills = best_fit(frame.length.to_numpy(), capacity)
        first = pd.Series(frame.item.to_numpy()).groupby(bins).min()
        return pd.DataFrame({"item": frame.item.to_numpy(), "bin": first.loc[bins].to_numpy(), "at": offsets, "fill": np.array(fills, np.int64)[bins]})

    schema = "item long, bin long, at long, fill long"
    importable(items.sparkSession)
    current, parts, level = items.select("item", "length"), None, 0
    left = current.count()
    while True:
        groups = max(1, -(-left // group_items))
        # other items meet on every level
        mark = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)).alias("g")
        placed = durable(current.select(mark, "item", "length").groupBy("g").applyInPandas(local, schema))
        step = placed.select(F.col("item").alias("child"), F.col("bin").alias("to"), F.col("at").alias("shift"))
        if parts is None:
            parts = placed.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
        else:
            moved = parts.join(step, parts.sequence_id == step.child, "left")
            parts = moved.select("item", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
        if groups == 1:
            return parts
        current = placed.where(F.col("fill") <= capacity - slack).select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
        before, left, level = left, current.count(), level + 1
        if not left or level > 1 and placed.select("bin").distinct().count() > (1 - LEAST_SAVED) * before:
            return parts


@tidy
def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row for each piece of each document: where it stands in which sequence of ``capacity`` tokens at most."""
    cut = durable(pieces(docs, path, capacity).withColumn("item", F.monotonically_increasing_id()))
    return cut.join(pack(cut, capacity, group_items), "item").drop("item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
