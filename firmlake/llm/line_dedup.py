"""Line dedup by an exact set-similarity join (operator 8).

A line is the set of its distinct words. Its words are ordered by rarity in the corpus; two lines whose Jaccard
similarity reaches the threshold share a word among the first few of each (prefix filter). Pairs that share one
pass a length filter, a positional filter and a parity map's bound before their whole sets are compared. A line goes if
an earlier line is similar to it, whether or not that one stays; lines stand in the order of doc_id, of a hash of the
text where several rows have one doc_id, and of their place in the text.

Texts are taken apart once: the words of every different line, as 48-bit hashes, are a table that the later steps
read. Prefix words are dealt into buckets by hash, many to a row. As one earlier similar line is enough, a bucket gives
for each line and word only the earliest line that passes all filters, so a group of near copies makes no more pairs than
it has lines. A line that none of these is similar to, and that had other candidates, meets all of them in a second
pass. Rarity comes from a fixed table of counters; it only steers the order, never the result, and bounds from above
how many lines hold a word. Words of more lines than ``HOT_WORD`` are joined apart, in a join that Spark can split:
their lines meet the earliest line first, and what stays open is compared in full.

Blank lines hold no words and always stay. Null texts stay null. Rows with one doc_id and different texts are documents
of their own; rows that repeat doc_id and text count as one, and lose the same lines. Rows without a doc_id stay as
they are. Very long texts and lines are read whole. An empty table gives no rows. Of equal lines, the earliest stays.
Other columns are carried along; n_lines and n_removed are replaced where a table has columns of these names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import FlatWords, durable, importable, map_rows, mix, packed, releasing, table, tidy, unpacked

PERCENT = 80
#: Bits of a word's hash, of the rarity counters' index, and counters in one row of what tasks send.
WORD_BITS = 48
SKETCH_BITS = 21
PART = 4096
#: Levels of rarity, a power of sqrt(2) apart, stand in front of a word's hash.
LEVEL_BITS = 6
#: A word that more lines than this may hold is joined apart.
HOT_WORD = 4_000
#: Prefix words that one bucket gets on average; pairs that it looks at together.
BUCKET = 500_000
TOGETHER = 250_000
#: Bits of the table that tells which words the second pass needs.
WANTED_BITS = 24
#: Bytes of text that a task takes apart at once, lines that it remembers, bytes of a broadcast.
PIECE = 1e6
REMEMBERED = 300_000
BROADCAST_BYTES = 32 << 20
#: Places of lines that are broadcast, each a few dozen bytes.
BROADCAST_PLACES = 1_000_000
#: Lines of more words than this have a parity map of 128 bits beside that of 64.
LONG = 80
#: What is stored of a number in a bucket, in bytes; a greater ``n`` or ``place`` is cut, which only weakens a filter.
STORED = {"word": 4, "doc": 8, "no": 4, "bits": 8, "n": 2, "place": 1}
MANY_WORDS = 65_535
LINES = "part int, counts binary, k1 long, k2 long, doc_id long, t long, line_no int, copy boolean, fresh boolean, n int, words binary"
FOUND = "xd long, xn int, yd long, yn int, more boolean, word long, n int, place int, bits long"
WHERE = ("doc_id", "line_no")


def _planes(x: np.ndarray, size: int, ends: list[tuple[int, int]]) -> list[bytes]:
    """The lowest ``size`` bytes of each span of unsigned numbers, all first bytes first: high bytes, which are mostly alike,
    stand side by side and take next to no room in a shuffle."""
    raw = np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :size].T)
    return [raw[:, a:b].tobytes() for a, b in ends]


def _from_planes(blobs: list[bytes], size: int) -> np.ndarray:
    raw = np.concatenate([np.frombuffer(b, np.uint8).reshape(size, -1) for b in blobs], 1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :size] = raw.T
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


class _Lines:
    """All lines of a batch that hold words, as flat arrays: the distinct words of each line, line by line."""

    def __init__(self, batch: dict[str, list]):
        flat = FlatWords([t if i is not None else None for i, t in zip(batch["doc_id"], batch["text"])])
        new = np.concatenate(([True], flat.line[1:] != flat.line[:-1])) if len(flat.h) else np.empty(0, bool)
        dense = np.cumsum(new) - 1
        doc = flat.doc[new]
        self.doc, self.t = (np.array([i if i is not None else 0 for i in batch[c]], np.int64)[doc] for c in ("doc_id", "t"))
        self.no = (flat.line[new] - flat.first_line[doc]).astype(np.int32)
        word, parts, room = flat.h >> np.uint64(64 - WORD_BITS), [], 1 << (64 - WORD_BITS)
        for low in range(0, len(doc), room):  # so many lines have a number of their own above a word
            a, b = np.searchsorted(dense, [low, low + room])
            key = np.sort(((dense[a:b] - low).astype(np.uint64) << np.uint64(WORD_BITS)) | word[a:b])
            key = key[np.concatenate((np.ones(1, bool), key[1:] != key[:-1]))]
            parts.append(((key >> np.uint64(WORD_BITS)).astype(np.int64) + low, key & np.uint64((1 << WORD_BITS) - 1)))
        self.line = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
        self.word = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.uint64)
        self.n = np.bincount(self.line, minlength=len(doc)).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.n)[:-1])).astype(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A 128-bit hash of each line's set."""
        salts = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
        return tuple(mix(np.add.reduceat(mix(self.word ^ np.uint64(s)), self.start)).view(np.int64) for s in salts)


def _described(batches: Iterator[dict]) -> Iterator[dict]:
    """Each line's key and place, the words of each line that the task meets first, and the task's word counters."""
    counts, seen = np.zeros(1 << SKETCH_BITS, np.uint32), {}
    for batch in batches:
        x = _Lines(batch)
        if not len(x.doc):
            continue
        k1, k2 = x.keys()
        order = np.lexsort((x.no, x.t, x.doc, k2, k1))
        new = np.ones(len(order), bool)
        new[1:] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        copy = np.zeros(len(order), bool)
        copy[order] = (x.doc[order] != x.doc[first]) | (x.t[order] != x.t[first]) | (x.no[order] != x.no[first])
        if len(seen) > REMEMBERED:
            seen.clear()
        # a line is met anew where it stands in an earlier document than before
        fresh = np.array([not c and (k not in seen or d <= seen[k]) for c, k, d in zip(copy.tolist(), k1.tolist(), x.doc.tolist())])
        seen.update(zip(k1[fresh].tolist(), x.doc[fresh].tolist()))
        counts += np.bincount((x.word[fresh[x.line]] >> np.uint64(WORD_BITS - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
        raw, size = packed(x.word, 6), 6
        words = [raw[size * a : size * (a + n)] if f else None for a, n, f in zip(x.start.tolist(), x.n.tolist(), fresh.tolist())]
        none = [None] * len(x.doc)
        yield {"part": none, "counts": none, "k1": k1, "k2": k2, "doc_id": x.doc, "t": x.t, "line_no": x.no, "copy": copy, "fresh": fresh, "n": x.n.astype(np.int32), "words": words}
    parts = [i for i, row in enumerate(counts.reshape(-1, PART)) if row.any()]
    blobs = [zlib.compress(counts[i * PART : (i + 1) * PART].tobytes(), 1) for i in parts]
    none = [None] * len(parts)
    yield {"part": parts, "counts": blobs} | {k: none for k in ("k1", "k2", "doc_id", "t", "line_no", "copy", "fresh", "n", "words")}


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PART, np.uint64)
    for x in frame.counts:
        total += np.frombuffer(zlib.decompress(x), np.uint32)
    return pd.DataFrame({"part": [frame.part.iloc[0]], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def _levels(rows: DataFrame) -> np.ndarray:
    """The level of rarity of each counter, 0 for words of one line: 2 ** SKETCH_BITS numbers, whatever the corpus."""
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    added = rows.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(_summed, "part int, counts binary")
    for r in added.collect():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, np.uint32)
    return np.minimum(2 * np.log2(np.maximum(out, 1)), (1 << LEVEL_BITS) - 1).astype(np.uint8)


class _Prefixes:
    """The rarest words of each line of a batch that another line may hold too, as flat arrays."""

    def __init__(self, batch: dict[str, list], level: np.ndarray, percent: int):
        n = self.n = np.array(batch["n"], np.int64)
        start = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
        word = unpacked(b"".join(batch["words"]), 6)
        line = np.repeat(np.arange(len(n)), n)
        # parities of how many words fall on each bit: bits that differ between two lines are words that do
        bit, side = np.uint64(1) << (word & np.uint64(63)), (word >> np.uint64(6) & np.uint64(1)).astype(bool)
        self.bits = np.bitwise_xor.reduceat(np.uint64(1) << (word >> np.uint64(8) & np.uint64(63)), start)
        self.low, self.high = (np.bitwise_xor.reduceat(np.where(side == z, bit, np.uint64(0)), start) for z in (False, True))
        rank = (level[(word >> np.uint64(WORD_BITS - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(WORD_BITS)) | word
        bottom, room = WORD_BITS + LEVEL_BITS, 1 << (64 - WORD_BITS - LEVEL_BITS)
        for low in range(0, len(n), room):
            a, b = start[low], start[low + room] if low + room < len(n) else len(word)
            rank[a:b] = np.sort(((line[a:b] - low).astype(np.uint64) << np.uint64(bottom)) | rank[a:b]) & np.uint64((1 << bottom) - 1)
        place = np.arange(len(word)) - start[line]
        degree = (rank >> np.uint64(WORD_BITS)).astype(np.int64)
        keep = (place < (n - (n * percent + 99) // 100 + 1)[line]) & (degree > 0)
        self.line, self.place, self.degree, self.mixed = line[keep], place[keep], degree[keep], mix(rank[keep])
        self.step = math.log(100 / percent) + 1e-6

    def wanted(self, further: int = 0) -> np.ndarray:
        """A number of each word and the length of its line. Lengths of similar lines are ``further`` by -1, 0 or 1 step."""
        length = np.floor(np.log(self.n) / self.step).astype(np.int64)[self.line] + further
        with np.errstate(over="ignore"):
            return (mix(self.mixed + length.view(np.uint64)) >> np.uint64(64 - WANTED_BITS)).astype(np.int64)


def _dealt(lines: DataFrame, levels, percent: int, hot: int, buckets: int, asking: bool | None = None, only=None) -> DataFrame:
    """(bucket, asking, blobs): prefix words in buckets by word; hot words have negative buckets, dealt by line.

    ``levels`` is a broadcast; ``only``: a broadcast table of the words that are asked for.
    """
    above = int(2 * math.log2(max(1, hot)))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            if not batch["n"]:
                continue
            x = _Prefixes(batch, levels.value, percent)
            keep = np.ones(len(x.line), bool) if only is None else only.value[x.wanted()] & (x.degree <= above)
            line, place, mixed, often = x.line[keep], x.place[keep], x.mixed[keep], x.degree[keep] > above
            bucket = np.where(often, -1 - line % buckets, (mixed % np.uint64(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            doc, no = (np.array(batch[c], np.int64).view(np.uint64)[line] for c in WHERE)
            kept = {"word": mixed >> np.uint64(32), "doc": doc, "no": no, "bits": x.bits[line], "n": np.minimum(x.n[line], MANY_WORDS), "place": np.minimum(place, 255)}
            long = (x.n[line] > LONG)[order]
            which, first = np.unique(bucket[order], return_index=True)
            ends = np.append(first[1:], len(order)).tolist()
            first = first.tolist()
            spans = list(zip(first, ends))
            out = {"bucket": which, "asking": [asking] * len(which)} | {c: _planes(v[order].astype(np.uint64), STORED[c], spans) for c, v in kept.items()}
            at = np.concatenate(([0], np.cumsum(long)))
            for c, v in (("low", x.low), ("high", x.high)):
                v = packed(v[line][order][long], 8)
                out[c] = [v[8 * at[a] : 8 * at[b]] for a, b in spans]
            yield out

    return map_rows(lines.select("n", "words", *WHERE), run, "bucket long, asking boolean, " + ", ".join(f"{c} binary" for c in (*STORED, "low", "high")), 2e6)


def _candidates(percent: int):
    """For one bucket, pairs of a line x and an earlier line y that pass all filters: for each x and word the earliest y,
    or for lines that ask every y."""
    schema = pa.schema([
        ("xd", pa.int64()), ("xn", pa.int32()), ("yd", pa.int64()), ("yn", pa.int32()), ("more", pa.bool_()), ("word", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("bits", pa.int64()),
    ])

    @releasing
    def of_bucket(key: tuple, rows: pa.Table) -> pa.Table:
        word, doc, no, bits, n, place = (_from_planes(rows.column(c).to_pylist(), STORED[c]) for c in STORED)
        doc, no, n, place = doc.view(np.int64), no.astype(np.int32), n.astype(np.int32), place.astype(np.int32)
        if key[0].as_py() < 0:
            none = [None] * len(doc)
            return pa.Table.from_pydict({"xd": doc, "xn": no, "yd": none, "yn": none, "more": none, "word": word.view(np.int64), "n": n, "place": place, "bits": bits.view(np.int64)}, schema)
        sizes = [len(x) // STORED["word"] for x in rows.column("word").to_pylist()]
        asks = np.repeat(np.array([bool(x) for x in rows.column("asking").to_pylist()]), sizes)
        asking = bool(asks.any())
        low, high = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)
        for c, v in (("low", low), ("high", high)):
            v[n > LONG] = unpacked(b"".join(rows.column(c).to_pylist()), 8)
        by = (word << np.uint64(16)) | n.astype(np.uint64)
        order = np.argsort(by)
        by, doc, no, bits, n, place, low, high, asks = (v[order] for v in (by, doc, no, bits, n, place, low, high, asks))
        rank = np.empty(len(doc), np.int32)
        rank[np.lexsort((no, doc))] = np.arange(len(doc), dtype=np.int32)
        # the shorter of two lines must have its first common word here; the longer ones come behind it
        at = np.flatnonzero((place <= n - -(-2 * percent * n // (100 + percent))) | (n == MANY_WORDS))
        longest = np.minimum(n[at].astype(np.int64) * 100 // percent, MANY_WORDS).astype(np.uint64)
        others = np.searchsorted(by, (by[at] >> np.uint64(16) << np.uint64(16)) | longest, "right") - at - 1
        at, others = at[others > 0], others[others > 0]
        done, here, pairs = np.cumsum(others), 0, []
        best, counts = np.full(len(doc), len(doc), np.int32), np.zeros(len(doc), np.int32)
        while here < len(at):
            then = max(here + 1, int(np.searchsorted(done, (done[here - 1] if here else 0) + TOGETHER, "right")))
            size = others[here:then]
            x = np.repeat(at[here:then], size)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
            here = then
            total, many = n[x] + n[y], n[y] == MANY_WORDS
            fine = ((100 + percent) * np.minimum(n[x] - place[x], n[y] - place[y]) >= percent * total) | many
            fine &= ((doc[x] != doc[y]) | (no[x] != no[y])) & ((asks[x] != asks[y]) if asking else True)
            x, y, total, many = x[fine], y[fine], total[fine], many[fine]
            fine = ((100 + percent) * np.bitwise_count(bits[x] ^ bits[y]).astype(np.int32) <= (100 - percent) * total) | many
            x, y, total, many = x[fine], y[fine], total[fine], many[fine]
            differ = np.bitwise_count(low[x] ^ low[y]).astype(np.int32) + np.bitwise_count(high[x] ^ high[y])
            fine = ((100 + percent) * differ <= (100 - percent) * total) | (n[x] <= LONG) | many
            x, y = x[fine], y[fine]
            late = np.where(rank[x] > rank[y], x, y)
            early = x + y - late
            if asking:
                pairs.append(np.column_stack([late, early])[asks[late]])
            else:
                np.minimum.at(best, late, rank[early])
                np.add.at(counts, late, 1)
        if asking:
            late, early = np.concatenate(pairs).T if pairs else np.empty((2, 0), np.int64)
            more = np.zeros(len(late), bool)
        else:
            late = np.flatnonzero(counts)
            early, more = np.argsort(rank)[best[late]], counts[late] > 1
        none = [None] * len(late)
        return pa.Table.from_pydict({"xd": doc[late], "xn": no[late], "yd": doc[early], "yn": no[early], "more": more, "word": none, "n": none, "place": none, "bits": none}, schema)

    return of_bucket


X, Y = ("xd", "xn"), ("yd", "yn")


def _of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``lines`` at the places ``wanted``. A bounded number of places goes to the lines, so that the table of
    words is not shuffled; beyond it both are."""
    wanted = durable(wanted.distinct().toDF(*WHERE))
    small = wanted.count() <= BROADCAST_PLACES
    return lines.join(F.broadcast(wanted) if small else wanted, list(WHERE), "left_semi")


def _without(lines: DataFrame, again: DataFrame) -> DataFrame:
    """``lines`` but for those at ``again``, which equal an earlier one and need no partner, so that copies that different
    tasks have met are not dealt and compared. More than a bounded number stay, which changes no result: shuffling the
    table of words would cost more."""
    return lines.join(F.broadcast(again), again.columns, "left_anti") if again.count() <= BROADCAST_PLACES else lines


@tidy
def _verified(lines: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (xd, xn, yd, yn) whose whole sets are similar enough, with the keys (x1, x2, y1, y2) of their lines."""
    pairs = durable(pairs.select(*X, *Y).distinct())
    wanted = pairs.select(*X).unionByName(pairs.select(F.col("yd").alias("xd"), F.col("yn").alias("xn")))
    # dealt once by place, which serves repeats and both joins
    sets = _of(lines.where("fresh"), wanted).select(*WHERE, "k1", "k2", "words").repartition(*WHERE).dropDuplicates([*WHERE, "k1", "k2"])
    one, two = (sets.toDF(f"{x}d", f"{x}n", f"{x}1", f"{x}2", f"w{x}") for x in "xy")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sizes = [np.array([len(w) // 6 for w in batch[c]], np.int64) for c in ("wx", "wy")]
            same = np.zeros(len(sizes[0]), np.int64)
            words = [unpacked(b"".join(batch[c]), 6) for c in ("wx", "wy")]
            owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
            room = 1 << (64 - WORD_BITS)
            for low in range(0, len(same), room):
                key = []
                for w, o in zip(words, owner):
                    a, b = np.searchsorted(o, [low, low + room])
                    key.append(((o[a:b] - low).astype(np.uint64) << np.uint64(WORD_BITS)) | w[a:b])
                key = np.sort(np.concatenate(key))
                both = (key[1:][key[1:] == key[:-1]] >> np.uint64(WORD_BITS)).astype(np.int64) + low
                same += np.bincount(both, minlength=len(same))
            fine = np.flatnonzero((100 + percent) * same >= percent * (sizes[0] + sizes[1])).tolist()
            yield {c: [batch[c][i] for i in fine] for c in (*X, "x1", "x2", "y1", "y2")}

    return map_rows(pairs.join(one, list(X)).join(two, list(Y)), run, "xd long, xn int, x1 long, x2 long, y1 long, y2 long")


def _asked_again(fresh: DataFrame, lines: DataFrame, open_lines: DataFrame, levels, percent: int, hot: int, buckets: int) -> DataFrame:
    """All candidates of ``open_lines`` (xd, xn; of ``fresh``) among earlier ``lines``; only words of their prefixes are dealt again, and of
    them only those in lines of such lengths as may be similar."""
    mine = durable(_of(fresh, open_lines).select("n", "words", *WHERE))

    def words(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            if batch["n"]:
                x = _Prefixes(batch, levels.value, percent)
                yield {"w": np.unique(np.concatenate([x.wanted(k) for k in (-1, 0, 1)]))}

    bits = map_rows(mine, words, "w long").groupBy(F.bitmap_bucket_number("w").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("w")).alias("bits"))
    only = np.zeros(1 << WANTED_BITS, bool)
    for r in bits.collect():  # a fixed table, whatever the number of lines; parts are numbered from 1, values start at 1 in each
        some = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little").astype(bool)
        at = (r.part - 1) * len(some) + 1
        places = at + np.flatnonzero(some)
        only[places[(places >= 0) & (places < len(only))]] = True
    only[0] = True
    held = lines.sparkSession.sparkContext.broadcast(only)
    dealt = _dealt(mine, levels, percent, hot, buckets, True, held).unionByName(_dealt(lines, levels, percent, hot, buckets, False, held))
    return durable(dealt.groupBy("bucket").applyInArrow(_candidates(percent), FOUND)).where("yd is not null").select(*X, *Y)


def _hot_pairs(lines: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(pairs to compare, pairs found similar already) of ``rows``: prefix words that very many lines may hold."""
    def near(a: str, b: str) -> Column:
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        most = F.least(na - F.col(f"{a}.place"), nb - F.col(f"{b}.place"))
        differ = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))
        fits = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * most >= percent * (na + nb))
        return (fits & ((100 + percent) * differ <= (100 - percent) * (na + nb))) | (na == MANY_WORDS) | (nb == MANY_WORDS)

    many = durable(rows.select("word", F.struct(*X).alias("at"), "n", "place", "bits").distinct())
    pair = [F.col(f"{a}.at.x{c}").alias(f"{a}{c}") for a in "xy" for c in "dn"]
    if many.isEmpty():
        return many.select(*[F.col(f"at.x{c}").alias(f"{a}{c}") for a in "xy" for c in "dn"]), None
    leaders = many.groupBy("word").agg(F.min(F.struct("at", "n", "place", "bits")).alias("y"))
    led = many.join(leaders, "word").select(F.struct("at", "n", "place", "bits").alias("x"), "y").where((F.col("x.at") != F.col("y.at")) & near("x", "y"))
    gone = _verified(lines, led.select(*pair), percent)
    open_rows = many.join(gone.select(F.struct(*X).alias("at")).distinct(), "at", "left_anti")
    x, y = open_rows.alias("x"), many.alias("y")
    rest = x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("x.at") > F.col("y.at")) & near("x", "y"))
    return rest.select(*pair), gone


@tidy
def removed_lines(docs: DataFrame, percent: int = PERCENT, hot: int = HOT_WORD) -> DataFrame:
    """(doc_id, t, removed): the numbers of all lines of ``docs`` (doc_id, t, text) that go."""
    importable(docs.sparkSession)
    rows = durable(map_rows(docs, _described, LINES, PIECE))
    levels = _levels(rows)
    lines = rows.where("part is null")
    here = ("doc_id", "t", "line_no")
    # the first place of each line, in partial sums by task: a line that most documents hold is no group of its own
    places = lines.where("not copy").select("k1", "k2", F.struct(*here).alias("place"))
    firsts = durable(places.groupBy("k1", "k2").agg(F.min("place").alias("at"), F.count("place").alias("times")))
    again = lines.where("not copy").select("k1", "k2", "fresh", F.struct(*here).alias("place")).join(firsts.where("times > 1").select("k1", "k2", "at"), ["k1", "k2"])
    again = durable(again.where("place > at").select("place.*", "fresh"))
    fresh = lines.where("fresh")
    worded = _without(fresh, again.where("fresh").select(*here))
    total = fresh.agg(F.sum("n"), F.count("n")).first()
    buckets = max(1, int(((total[0] or 0) * (100 - percent) // 100 + total[1]) // BUCKET + 1))
    held = docs.sparkSession.sparkContext.broadcast(levels)
    found = durable(_dealt(worded, held, percent, hot, buckets).groupBy("bucket").applyInArrow(_candidates(percent), FOUND))
    first = found.where("yd is not null")
    rest, gone = _hot_pairs(lines, found.where("yd is null"), percent)
    similar = _verified(lines, first.unionByName(rest, allowMissingColumns=True), percent)
    similar = similar.unionByName(gone) if gone else similar
    open_lines = durable(first.where("more").select(*X).distinct().join(similar.select(*X).distinct(), list(X), "left_anti"))
    if not open_lines.isEmpty():
        similar = similar.unionByName(_verified(lines, _asked_again(fresh, worded, open_lines, held, percent, hot, buckets), percent))
    similar = similar.where("x1 <> y1 or x2 <> y2").select("x1", "x2", "y1", "y2").distinct()
    one, two = (firsts.select(F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"), F.col("at").alias(f"at_{x}")) for x in "xy")
    later = similar.join(one, ["x1", "x2"]).join(two, ["y1", "y2"]).select(F.greatest("at_x", "at_y").alias("at")).select("at.*")
    gone = later.unionByName(again.select(*here)).unionByName(lines.where("copy").select(*here))
    return gone.groupBy("doc_id", "t").agg(F.collect_set("line_no").alias("removed"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, hot: int = HOT_WORD) -> DataFrame:
    """``docs`` with the later of similar lines taken out of ``text``; adds n_lines and n_removed.

    A line break stays between the lines that stay. ``n_chars``, where there is one, is not touched.
    """
    mark = F.xxhash64("text")
    gone = removed_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("t"), "text"), percent, hot)
    x = "removed"
    while x in docs.columns:
        x += "_"
    gone = gone.select(F.struct("doc_id", "t", "removed").alias(x))
    size = gone.agg(F.sum(48 + 4 * F.size(f"{x}.removed"))).first()[0] or 0
    same = (docs["doc_id"].cast("long") == gone[x]["doc_id"]) & (F.xxhash64(docs["text"]) == gone[x]["t"])
    out = docs.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, same, "left")
    text, some = F.coalesce("text", F.lit("")), F.col(x).isNotNull()
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(f"{x}.removed", i))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return out.withColumns({
        "n_lines": (breaks + 1).cast("long"), "n_removed": F.when(some, F.size(f"{x}.removed")).otherwise(0).cast("long"),
        "text": F.when(some, F.array_join(kept, "\n")).otherwise(F.col("text")),
    }).drop(x)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
