"""Similarity joins: names by Indel ratio, without loss, and vectors by cosine, by shared caps.

Both take rows with a number of their own and return pairs of numbers, the smaller first. ``fresh`` marks rows that are new
since an earlier run: where it is given, pairs of two old rows are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.functions.arrays import cosine
from firmlake.sources.shared import durable

#: Letters of a gram by the least ratio for which similar names of any length must share some: with ratio r and grams of q
#: letters, r / 2 must exceed (q - 1) * (1 - r).
GRAMS = ((0.86, 4), (0.81, 3), (0.67, 2))
#: Caps that a vector falls into; words of a block of the code at most; rows of a block of a hot cap.
CAPS, WORDS, BLOCK = 64, 512, 512
#: Rows of a block of a hot gram, and rows of grams that one task compares, about.
NAME_BLOCK, NAMES_DEALT = 2048, 32_768
#: Vectors of fewer components are too few directions to tell apart: all share one cap, whose blocks meet in full.
FLAT = 16
#: Member rows that one task compares, about; members of a cap up to which caps are compared many at once.
DEALT, FEW = 8192, 24
SEED = 4_219


def indel(x: str, y: str) -> float:
    """2 * LCS / (len x + len y); 0 when either is blank. The LCS is worked out on the bits of one number."""
    if not x or not y:
        return 0.0
    at: dict[str, int] = {}
    for k, c in enumerate(y):
        at[c] = at.get(c, 0) | 1 << k
    full = v = (1 << len(y)) - 1
    for c in x:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2.0 * (len(y) - v.bit_count()) / (len(x) + len(y))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (len a + len b); 0 when either is blank."""
    return pd.Series([indel(x, y) for x, y in zip(a.fillna(""), b.fillna(""))])


def _most_edits(m: Column, n: Column, least: float) -> Column:
    """How many letters may be put in or taken out at most between names of ``m`` and ``n`` letters: of the parity of both."""
    most = F.floor((1 - least) * (m + n) + 1e-6)
    return most - F.pmod(most - (m + n), F.lit(2))


def _gram(least: float) -> int:
    for bound, gram in GRAMS:
        if least >= bound:
            return gram
    raise ValueError(f"names whose ratio is under {GRAMS[-1][0]} need not share a gram")


def _shared_grams(m: Column, n: Column, least: float) -> Column:
    """How many grams of two similar names are alike at least: always one or more. With grams of q letters, a letter taken out
    breaks the q grams that hold it, one put in the q - 1 that it parts; names are padded with q - 1 signs at either end."""
    edits = _most_edits(m, n, least)
    return (m + n - edits) / 2 - (_gram(least) - 1) * (edits - 1)


def _grams(name: Column, least: float) -> Column:
    """All grams of a padded name in order."""
    q = _gram(least)
    padded = F.concat(F.lit("\x02" * (q - 1)), name, F.lit("\x03" * (q - 1)))
    return F.transform(F.sequence(F.lit(1), F.char_length(name) + q - 1), lambda i: F.substring(padded, i, q))


def _letters(name: Column) -> Column:
    """64 bits of the letters of a name, equal ones told apart by a running number: a letter put in or taken out changes one
    bit at most."""
    def bit(i: Column) -> Column:
        letter, before = F.substring(name, i, F.lit(1)), F.substring(name, F.lit(1), i)
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(letter, F.char_length(before) - F.char_length(F.replace(before, letter))), F.lit(64)))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(name)), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def _gram_table(names: DataFrame, least: float) -> DataFrame:
    """(no, name, fresh, letters, reach, gram, pos): the rarest grams of each name, so many that two similar names share one of
    them at a place that their edits allow. ``reach`` is the most edits to any similar name, ``letters`` are bits of the name.

    Of similar names some grams are unbroken. Take the one that comes first by (rarity, gram): its first place in the one
    name answers to its first place in the other, since unbroken parts keep their order, and as many grams as must be
    shared cannot all stand behind the prefix.
    """
    n, whole = F.col("n"), ("no", "name", "fresh", "letters", "reach", "kept")
    lowest, highest = F.ceil(n * least / (2 - least) - 1e-6), F.floor(n * (2 - least) / least + 1e-6)
    shared = F.array_min(F.transform(F.sequence(lowest, highest), lambda m: _shared_grams(n, m, least)))
    rows = names.select("no", "name", "fresh", _letters(F.col("name")).alias("letters"), F.char_length("name").alias("n"))
    rows = rows.withColumns({"kept": (n + _gram(least) - F.ceil(shared)).cast("int"), "reach": F.floor((1 - least) * (n + highest) + 1e-6).cast("int")})
    grams = rows.select(*whole, F.posexplode(_grams(F.col("name"), least)).alias("pos", "gram"))
    rarity = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = F.array_sort(F.collect_list(F.struct("df", "gram", "pos")))
    first = grams.join(rarity, "gram").groupBy(*whole).agg(ranked.alias("ranked"))
    return first.select(*whole[:-1], F.explode(F.slice("ranked", F.lit(1), F.col("kept"))).alias("g")).select(*whole[:-1], "g.gram", "g.pos")


def _met(members: DataFrame, keys: tuple[str, ...], block: int, dealt: int) -> tuple[DataFrame, DataFrame]:
    """``members`` (no, <keys>, ...) that share their keys with others, with the group (home, x, y) in which they meet and their
    ``side``, and (<keys>, size, blocks).

    Members of a hot key are dealt into blocks, and every two blocks meet, so a key of any size is spread over tasks; small
    keys meet many to a task.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    sizes = durable(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")))
    groups = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // dealt))
    placed = members.join(sizes, list(keys)).withColumn("z", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    # side 0 and 1: the two blocks that meet, 2: a block that meets itself
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("z", o).alias("x"), F.greatest("z", o).alias("y"), F.when(F.col("z") == o, 2).when(F.col("z") < o, 0).otherwise(1).alias("side")))
    sent = placed.select(*members.columns, "blocks", F.explode(meet).alias("p"))
    hot = F.col("blocks") > 1
    home = F.when(hot, F.xxhash64(*keys)).otherwise(F.pmod(F.xxhash64(*keys), F.lit(groups)))
    return sent.select(*members.columns, "p.side", home.alias("home"), F.when(hot, F.col("p.x")).otherwise(-1).alias("x"), F.when(hot, F.col("p.y")).otherwise(-1).alias("y")), sizes


def _gram_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of names of each gram of a frame, or of two blocks of a hot one, whose letters and places may be similar."""
    frame = frame.sort_values(["gram", "no"], kind="stable")
    gram, no, letters, reach, pos, side, fresh = (frame[c].to_numpy() for c in ("gram", "no", "letters", "reach", "pos", "side", "fresh"))
    out = [np.zeros((2, 0), np.int64)]

    def near(i: np.ndarray, j: np.ndarray) -> None:
        kept = np.bitwise_count((letters[i] ^ letters[j]).view(np.uint64)) <= reach[i]
        i, j = i[kept], j[kept]
        kept = (no[i] != no[j]) & (np.abs(pos[i] - pos[j]) <= reach[i]) & ((side[i] != side[j]) | (side[i] == 2)) & (fresh[i] | fresh[j])
        out.append(np.stack((i[kept], j[kept])))

    starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    sizes = np.diff(np.append(starts, len(gram)))
    few = np.repeat(sizes <= FEW, sizes)
    for apart in range(1, min(FEW, len(gram))):
        i = np.flatnonzero((gram[:-apart] == gram[apart:]) & few[:-apart])
        near(i, i + apart)
    for a, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
        i, j = np.triu_indices(n, 1)
        near(a + i, a + j)
    i, j = np.concatenate(out, axis=1)
    i, j = np.where(no[i] < no[j], i, j), np.where(no[i] < no[j], j, i)
    name = frame.name.to_numpy()
    return pd.DataFrame({"a": no[i], "x": name[i], "b": no[j], "y": name[j]}).drop_duplicates(["a", "b"])


def name_candidates(names: DataFrame, least: float) -> DataFrame:
    """(a, x, b, y): numbers and names of pairs of ``names`` (no, name, fresh) that rare grams at fitting places and a bound on
    their edits leave.

    Names travel with their grams, so pairs are looked at where their gram lies, and only what may be similar moves on.
    """
    members = durable(_gram_table(names, least).withColumn("gram", F.xxhash64("gram")))
    sent, _ = _met(members, ("gram",), NAME_BLOCK, NAMES_DEALT)
    return sent.groupBy("home", "x", "y").applyInPandas(_gram_pairs, "a long, x string, b long, y string").distinct()


def similar_names(names: DataFrame, least: float) -> DataFrame:
    """(a, b) of all pairs of different ``names`` (no, name, fresh; names distinct) whose Indel ratio is ``least`` or more.

    No pair is lost. What shares a rare gram and may be near enough is worked out. Names of over a few dozen letters keep few
    letters out; blank names are like nothing.
    """
    pairs = name_candidates(names.where("name <> ''"), least)
    return pairs.withColumn("ratio", indel_ratio("x", "y")).where(F.col("ratio") >= least).select("a", "b")


@lru_cache(8)
def _code(width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and random unit code words for either half of a vector."""
    rng = np.random.default_rng(SEED + width)
    rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
    words = [rng.normal(size=(min(WORDS, 16 * width), n)) for n in ((width + 1) // 2, width // 2)]
    return rotation, [w / np.linalg.norm(w, axis=1, keepdims=True) for w in words]


def nearest_caps(unit: np.ndarray, caps: int = CAPS) -> np.ndarray:
    """The ``caps`` directions nearest to each unit vector, among all pairs of a word of either half."""
    width = unit.shape[1]
    if width < FLAT:
        return np.zeros((len(unit), 1), np.int64)
    rotation, words = _code(width)
    x, half, n = unit @ rotation, words[0].shape[1], np.arange(len(unit))[:, None]
    one, two = x[:, :half] @ words[0].T, x[:, half:] @ words[1].T
    top = min(caps, one.shape[1])
    first, second = (np.argpartition(-z, top - 1, axis=1)[:, :top] for z in (one, two))
    total = (one[n, first][:, :, None] + two[n, second][:, None, :]).reshape(len(unit), -1)
    best = np.argpartition(-total, min(caps, top * top) - 1, axis=1)[:, : min(caps, top * top)]
    return first[n, best // top] * len(words[1]) + second[n, best % top]


def _capped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Caps of each vector, and its components as bytes: what is compared in caps, before pairs are checked exactly."""
    for frame in frames:
        parts = []
        for width, rows in frame.groupby(frame.vector.map(len)):
            x = np.array(rows.vector.tolist(), float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            scale = np.abs(x).max(1) / 127
            small = np.round(x / scale[:, None]).astype(np.int8)
            parts.append(pd.DataFrame({"no": rows.no, "width": width, "fresh": rows.fresh, "scale": scale, "small": [v.tobytes() for v in small], "cap": list(nearest_caps(x))}))
        if parts:
            yield pd.concat(parts)


def _cap_pairs(least: float):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """Pairs of each cap of a frame, or of two blocks of a hot one, that their bytes do not rule out."""
        out = [np.zeros((2, 0), np.int64)]
        for width, rows in frame.sort_values(["width", "cap", "no"], kind="stable").groupby("width"):
            x = np.frombuffer(b"".join(rows.small), np.int8).reshape(-1, width).astype(np.float32)
            no, cap, side, fresh, scale = (rows[c].to_numpy() for c in ("no", "cap", "side", "fresh", "scale"))
            # rounding moves a vector by half a step in each component at most
            slack = 0.5 * np.sqrt(width) * scale

            def near(i: np.ndarray, j: np.ndarray, product: np.ndarray) -> np.ndarray:
                bound = least - 1e-5 - (slack[i] + slack[j] + slack[i] * slack[j])
                return (product * scale[i] * scale[j] >= bound) & ((side[i] != side[j]) | (side[i] == 2)) & (fresh[i] | fresh[j])

            starts = np.flatnonzero(np.append(True, cap[1:] != cap[:-1]))
            sizes = np.diff(np.append(starts, len(cap)))
            # small caps all at once: every row with the one so many places behind it
            few = np.repeat(sizes <= FEW, sizes)
            for apart in range(1, min(FEW, len(cap))):
                i = np.flatnonzero((cap[:-apart] == cap[apart:]) & few[:-apart])
                i = i[near(i, i + apart, np.einsum("ij,ij->i", x[i], x[i + apart]))]
                out.append(np.stack((no[i], no[i + apart])))
            for a, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
                i, j = np.triu_indices(n, 1)
                product = (x[a : a + n] @ x[a : a + n].T)[i, j]
                kept = near(a + i, a + j, product)
                out.append(np.stack((no[a + i[kept]], no[a + j[kept]])))
        found = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": found[0], "b": found[1]})

    return compare


def vector_candidates(vectors: DataFrame, least: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(a, b) of pairs of ``vectors`` (no, vector, fresh; finite and not zero) that share a cap and whose bytes are near
    enough, and (compared) how many pairs were looked at in caps.

    Vectors travel to their caps as bytes.
    """
    capped = vectors.mapInPandas(_capped, "no long, width int, fresh boolean, scale double, small binary, cap array<long>")
    sent, sizes = _met(durable(capped.withColumn("cap", F.explode("cap"))), ("width", "cap"), block, DEALT)
    pairs = sent.groupBy("home", "x", "y").applyInPandas(_cap_pairs(least), "a long, b long").distinct()
    return pairs, sizes.select(F.col("size") * (F.col("size") - 1) / 2).toDF("compared")


def similar_vectors(vectors: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b) of pairs of different ``vectors`` (no, vector, fresh; vectors distinct) whose cosine is ``least`` or more.

    Pairs are found by a shared cap and checked exactly. At a cosine of 0.82 two vectors of 64 or 384 components share one
    with a probability of 0.995; closer ones more. Vectors of under 16 components are all compared.
    """
    pairs, _ = vector_candidates(vectors, least, block)
    v = vectors.select("no", "vector")
    both = pairs.join(v.withColumnsRenamed({"no": "a", "vector": "x"}), "a").join(v.withColumnsRenamed({"no": "b", "vector": "y"}), "b")
    return both.where(cosine(F.col("x"), F.col("y")) >= least).select("a", "b")
