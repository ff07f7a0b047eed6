"""Questions to log lines (line_no, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_level(lines: DataFrame) -> DataFrame:
    low = F.lower("value")
    return lines.withColumn("level", F.when(low.contains("error") | low.contains("fail"), "error").when(low.contains("warn"), "warn").otherwise("info"))


def level_counts(lines: DataFrame) -> DataFrame:
    return with_level(lines).groupBy("level").agg(F.count("*").alias("n"))


def log_tail(lines: DataFrame, level: str | None = None, tail: int = 150) -> DataFrame:
    out = with_level(lines)
    if level:
        out = out.where(F.col("level") == level)
    return out.orderBy(F.desc("line_no")).limit(tail)


def count_lines(lines: DataFrame, text: str = "Saved markdown:") -> DataFrame:
    return lines.agg(F.count_if(F.col("value").contains(text)).alias("n"))
