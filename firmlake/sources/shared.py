"""Tables that jobs write on the way: in the folder that driver and executors share, removed when the job ends."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder of its own; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.firmlake.local.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-firmlake-")
        spark.conf.set("spark.firmlake.local.dir", found)
    return found


#: Tables that the jobs now at work in this thread have written, innermost last.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def place(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the job that is at work ends."""
    path = f"{shared_dir(spark)}/firmlake-{uuid.uuid4().hex}"
    if _WRITTEN.get():
        _WRITTEN.get()[-1].append(path)
    return path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside go when their query ends, not when the driver collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, so lost executors lose nothing."""
    path = path or place(df.sparkSession)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, path: str | None = None) -> DataFrame:
    """As ``durable``, in as many buckets of ``key`` as the session has shuffle partitions: what groups or joins such tables
    by that key shuffles nothing. The name that Spark's catalogue needs for buckets is given up at once."""
    spark, name = df.sparkSession, f"firmlake_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
    with swept(spark):
        rows.option("path", path or place(spark)).option("compression", "zstd").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside, by this thread, are removed at the end, whether or not it ends well."""
    mine: list[str] = []
    before = _WRITTEN.set((*_WRITTEN.get(), mine))
    try:
        yield
    finally:
        _WRITTEN.reset(before)
        for path in mine:
            remove(spark, path)


def tidy(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A job whose result is a table of its own; all tables that it wrote on the way are removed."""
    @wraps(job)
    def run(*args, **kwargs) -> DataFrame:
        outer = _WRITTEN.get()
        sessions = [a if isinstance(a, SparkSession) else a.sparkSession for a in args if isinstance(a, (SparkSession, DataFrame))]
        with scratch(sessions[0] if sessions else SparkSession.getActiveSession()):
            out = job(*args, **kwargs)
            inner = _WRITTEN.set(outer)
            try:
                return durable(out)
            finally:
                _WRITTEN.reset(inner)

    return run
