"""Stored tables in hash buckets: an upsert rewrites the buckets that it touches, and readers change over at once.

A table is a folder with data and manifests. Rows lie in buckets by a hash of their key; a manifest names, for one version of
the table, the folder of each bucket's files. A write puts the new files of the touched buckets beside the old ones and
then publishes a manifest with the next number by renaming it into place. So a write that fails leaves the last version
readable, a reader sees one version throughout, and of two writers that start from one version the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    place, fs = _files(spark, f"{path}/manifests")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, or else of the newest one."""
    if version is None:
        known = _versions(spark, path)
        if not known:
            raise FileNotFoundError(f"no table at {path}")
        version = known[-1]
    (row,) = spark.read.text(f"{path}/manifests/{version:012d}.json", wholetext=True).collect()
    return json.loads(row.value)


def _publish(spark: SparkSession, path: str, found: dict) -> None:
    draft, fs = _files(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    target, _ = _files(spark, f"{path}/manifests/{found['version']:012d}.json")
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"version {found['version']} of {path} stands already")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _written(df: DataFrame, path: str, keys: list[str], buckets: int) -> dict[str, str]:
    """Writes rows by bucket; the folder of each bucket that has rows."""
    folder = f"data/{uuid.uuid4().hex}"
    spark = df.sparkSession
    parts = df.withColumn("__bucket", _bucket(keys, buckets)).repartition(buckets, "__bucket")
    parts.write.partitionBy("__bucket").parquet(f"{path}/{folder}")
    place, fs = _files(spark, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return {n.removeprefix("__bucket="): f"{folder}/{n}" for n in names if n.startswith("__bucket=")}


def create(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table; ``keys`` tell rows apart and stay as they are."""
    if _versions(df.sparkSession, path):
        raise Conflict(f"there is a table at {path}")
    folders = _written(df, path, keys, buckets)
    _publish(df.sparkSession, path, {"version": 0, "keys": keys, "buckets": buckets, "schema": df.schema.jsonValue(), "folders": folders, "batches": {}})


def _rows(spark: SparkSession, path: str, found: dict, only: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(found["schema"])
    folders = [f"{path}/{folder}" for bucket, folder in found["folders"].items() if only is None or bucket in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, or else of the newest one."""
    return _rows(spark, path, manifest(spark, path, version))


def upsert(path: str, incoming: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], source: str = "", batch: int | None = None) -> bool:
    """Publishes the table after ``change(stored, incoming)``, which sees the stored rows of those buckets that hold a key of
    ``incoming`` and returns all rows that they hold from now on.

    A ``batch`` number makes it safe to repeat: a batch of ``source`` that is not newer than the last one that was published
    changes nothing, and the answer is False.
    """
    spark = incoming.sparkSession
    found = manifest(spark, path)
    if batch is not None and batch <= found["batches"].get(source, -1):
        return False
    keys, buckets = found["keys"], found["buckets"]
    touched = {str(r[0]) for r in incoming.select(_bucket(keys, buckets)).distinct().collect()}  # at most as many as buckets
    after = change(_rows(spark, path, found, touched), incoming).select(*StructType.fromJson(found["schema"]).names)
    folders = {b: folder for b, folder in found["folders"].items() if b not in touched}
    new = _written(after, path, keys, buckets)
    if not new.keys() <= touched:
        raise ValueError("a change may not bring in keys that are not in incoming")
    batches = found["batches"] | ({source: batch} if batch is not None else {})
    _publish(spark, path, found | {"version": found["version"] + 1, "folders": folders | new, "batches": batches})
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes what only versions before the newest ``keep`` name, and what failed writes left; how many folders went. Not
    to be run beside a writer."""
    known = _versions(spark, path)
    held = {folder for v in known[-keep:] for folder in manifest(spark, path, v)["folders"].values()}
    for v in known[:-keep]:
        place, fs = _files(spark, f"{path}/manifests/{v:012d}.json")
        fs.delete(place, False)
    gone = 0
    place, fs = _files(spark, f"{path}/data")
    for write in fs.listStatus(place) if fs.exists(place) else []:
        name = write.getPath().getName()
        parts = [s.getPath() for s in fs.listStatus(write.getPath())]
        left = [p for p in parts if f"data/{name}/{p.getName()}" in held]
        for p in [write.getPath()] if not left else [p for p in parts if p not in left and p.getName().startswith("__bucket=")]:
            fs.delete(p, True)
            gone += 1
    return gone
