"""Running sums over an order of any length, spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlake.sources.shared import durable


def running_sums(df: DataFrame, sums: dict[str, Column], order: list[Column], keys: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Adds each column of ``sums``: the sum of its expression over the rows of the same ``keys`` that come earlier in
    ``order``; 0 for the first.

    Rows are dealt into ranges of (keys, order), so a key of any size is spread over as many tasks as it fills ranges. Each
    range is summed once, the sums of ranges are added up for each key, and rows add what stands before them in their
    range. Only rows that are equal in keys and order must share a task, and their mutual order is open: give a unique
    order. The dealt rows are written to the shared folder, since ranges are picked from a sample: two passes over other
    ranges would not fit together. Null keys and orders are values like others. One range, for a table that is known to
    be small, is a plain window.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__v_{name}": F.coalesce(x, F.lit(0)) for name, x in sums.items()}
    if n == 1:
        w = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(F.coalesce(x, F.lit(0))).over(w), F.lit(0)).alias(name) for name, x in sums.items()])
    dealt = df.withColumns(values).repartitionByRange(n, *[F.col(k) for k in keys], *order)
    dealt = durable(dealt.withColumn("__range", F.spark_partition_id()))
    groups = ["__range", *keys]
    of_ranges = dealt.groupBy(*groups).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = of_ranges.select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k_{k}") for k in keys], *[F.sum(v).over(earlier).alias(f"__b{v}") for v in values])
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    here = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.sum(v).over(here).alias(f"__h{v}") for v in values]).join(before, same, "left")
    zero = F.lit(0)
    total = [(F.coalesce(f"__h__v_{name}", zero) + F.coalesce(f"__b__v_{name}", zero)).alias(name) for name in sums]
    return out.select(*df.columns, *total)
