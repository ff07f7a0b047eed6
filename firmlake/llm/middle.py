"""Fill-in-middle transformation over a compressed set of token boundaries (operator 11).

A text's tokens are runs of ASCII letters and single other code points. The offsets, in code points, at which a token
may begin or end form a set of integers, kept as a Roaring bitmap keeps them: one container for each 65,536 offsets, as
a sorted array, a bitmap or a list of runs, whichever is smallest, with the cumulative cardinality of the containers
before it. Cutting behind the k-th token is ``select(k)``: the container is searched for among the cumulative
cardinalities, and the place inside it is found by index (array), by the bit counts of words (bitmap) or by the
cumulative lengths (runs). Prose gives arrays or bitmaps, long stretches of digits, signs or other scripts give runs.

The two cuts are the only thing that Python works out. Texts are cut and put together, and taken apart again, by
expressions inside the JVM, so a text goes to Python once and never back.

Null texts count as empty and stay plain; so do texts that hold a marker. A null doc_id is hashed as no digits, so all
rows without one draw the same numbers. Repeated rows are treated alike; equal draws (an empty middle) are allowed. Very
long texts are read whole. An empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.llm.common import importable, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of those the share whose suffix stands first.
RATE, SPM = 90, 20
SEED = 1
#: Offsets of one container.
CHUNK = 1 << 16


class Container:
    """Some of the offsets 0 to 65,535: ``kind`` is array, bitmap or runs, whichever takes the fewest bytes."""

    def __init__(self, low: np.ndarray):
        """``low``: the sorted offsets."""
        new = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
        sizes = {"runs": 4 * len(new), "array": 2 * len(low), "bitmap": CHUNK // 8}
        self.kind = min(sizes, key=sizes.get)
        if self.kind == "array":
            self.values = low.astype(np.uint16)
        elif self.kind == "runs":
            self.first = low[new].astype(np.uint16)
            self.before = np.append(new, len(low))  # cumulative lengths
        else:
            bits = np.zeros(CHUNK, np.uint8)
            bits[low] = 1
            self.words = np.packbits(bits, bitorder="little").view("<u8")
            self.before = np.append(0, np.cumsum(np.bitwise_count(self.words).astype(np.int64)))  # cumulative bit counts

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if self.kind == "array":
            return int(self.values[k])
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        if self.kind == "runs":
            return int(self.first[at]) + k - int(self.before[at])
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # without its lowest bit
        return 64 * at + (word & -word).bit_length() - 1


class Boundaries:
    """A set of offsets in containers, with the number of offsets before each."""

    def __init__(self, offsets: np.ndarray):
        """``offsets``: sorted and distinct."""
        high = offsets // CHUNK
        self.keys, starts = np.unique(high, return_index=True)
        self.before = np.append(starts, len(offsets))
        self.containers = [Container(offsets[a:b] % CHUNK) for a, b in zip(self.before[:-1], self.before[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return CHUNK * int(self.keys[at]) + self.containers[at].select(k - int(self.before[at]))


def boundaries(text: str) -> Boundaries:
    """Offset 0 and the end of each token."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((code | 32) - 97) < 26  # unsigned: what is below wraps around
    cut = np.ones(len(code) + 1, bool)
    cut[1:-1] = ~(letter[1:] & letter[:-1])
    return Boundaries(np.flatnonzero(cut))


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("n", "first", "second")]))
def cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The number of tokens of each text, and the offsets behind the smaller and the larger of two draws."""
    for texts, one, two in batches:
        out = np.zeros((len(texts), 3), np.int64)
        for i, (text, x, y) in enumerate(zip(texts, one.tolist(), two.tolist())):
            found = boundaries(text)
            n = len(found) - 1
            a, b = sorted((x % (n + 1), y % (n + 1)))
            out[i] = n, found.select(a), found.select(b)
        yield pd.DataFrame(out, columns=["n", "first", "second"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output): every text with a middle part moved to its end.

    ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain.
    """
    importable(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *map(draw, range(4)))
    rows = rows.withColumn("at", cuts("text", "h1", "h2"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    rows = rows.select("doc_id", "text", "at", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm").alias("form"))
    part = lambda a, b: F.substring("text", a.cast("int") + 1, (b - a).cast("int"))
    first, second = F.col("at.first"), F.col("at.second")
    prefix, middle, suffix = part(F.lit(0), first), part(first, second), part(second, F.char_length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = lambda x: F.when(F.col("form") != "plain", x)
    return rows.select("doc_id", "text", F.col("at.n").alias("n"), "form", cut(first).alias("prefix_chars"), cut(second - first).alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that ``output`` was made of. No part holds a marker, and none arises where parts and markers meet."""
    def between(after: str, until: str | None = None) -> Column:
        rest = F.substring_index(output, after, -1)
        return F.substring_index(rest, until, 1) if until else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
        [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS draws FROM d),
c AS (SELECT *, len(tokens) AS n, least(draws[1] % (len(tokens) + 1), draws[2] % (len(tokens) + 1)) AS a, greatest(draws[1] % (len(tokens) + 1), draws[2] % (len(tokens) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 90 THEN 'plain' WHEN draws[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(tokens[:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (SELECT *, instr(output, '<P>') AS ip, instr(output, '<S>') AS ins, instr(output, '<M>') AS im FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN output[ip + 3:ins - 1] || output[im + 3:] || output[ins + 3:im - 1] ELSE output[ip + 3:im - 1] || output[im + 3:] || output[ins + 3:ip - 1] END) AS restored_sha256
FROM r
"""
