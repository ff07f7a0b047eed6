"""A corpus pipeline of five operators: quality, language, line dedup, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; all but the last return the columns
of documents, whatever other columns a table has. Rows that are repeated are treated alike, and an empty table gives
an empty table. Null or empty texts pass the first stage as far as their score allows; the second rejects texts without
a letter, and all texts if no row tells a language. Rows without a doc_id pass line dedup and the near-duplicate stage
as they are. Rows that repeat a doc_id are one document to the near-duplicate stage and stay or go together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm import langid, line_dedup, ngram_join, packing, quality
from firmlake.llm.common import durable, importable, table
from firmlake.sources.shared import remove, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _of_documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    importable(spark)
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    held = quality.kept(docs, machine)
    return _of_documents(held)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough confidence."""
    return _of_documents(langid.kept(docs, langid.fit(docs)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one; documents of which nothing is left go.

    n_chars follows the text.
    """
    found = line_dedup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _of_documents(found.where(left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates; all documents without a partner."""
    found = ngram_join.ngram_components(docs)
    gone = durable(found.where("doc_id <> component_id").select("doc_id").distinct())
    small = gone.limit(1_000_001).count() <= 1_000_000
    return _of_documents(docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which sequence."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the trained classifiers nor the tokenizer; tests/llm/test_pipeline.py holds every stage against a
#: plain version of its rule.
ORACLE_SQL = None


def _kept(docs: DataFrame, held: ExitStack) -> DataFrame:
    """A table of its own, which is removed when ``held`` is closed."""
    path = f"{shared_dir(docs.sparkSession)}/stage-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    held.callback(remove, docs.sparkSession, path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again, and goes when the next one stands."""
    held = ExitStack()
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, held = held, ExitStack()
        with last:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = _kept(docs, held)
    return docs
