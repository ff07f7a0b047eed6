"""Tables in hash buckets, and streams that may be stopped and replayed."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from firmlake.operators import ledgers
from firmlake.sources import snapshots
from firmlake.streaming import jobs

LEDGER = "url string, error_message string, retry_count long, last_attempt timestamp, status string"


def at(day, second=0):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=day, seconds=second)


def ledger(spark, n):
    return spark.createDataFrame([(f"u{i}", "old", 1, at(0), "pending") for i in range(n)], LEDGER)


def shown(df):
    return {r.url: (r.error_message, r.retry_count, r.status) for r in df.collect()}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshots.create(ledger(spark, 200), path, ["url"], 16)
    first = snapshots.manifest(spark, path)
    assert len(first["folders"]) == 16 and snapshots.read(spark, path).count() == 200
    new = spark.createDataFrame([("u3", "boom", at(2), "failed"), ("new", "x", at(2), "failed")], "url string, error_message string, ts timestamp, kind string")
    assert snapshots.upsert(path, new, ledgers.apply_failure_events)
    second = snapshots.manifest(spark, path)
    assert sum(first["folders"][b] != f for b, f in second["folders"].items()) <= 2 and second["version"] == 1
    got = shown(snapshots.read(spark, path))
    assert len(got) == 201 and got["u3"] == ("boom", 2, "pending") and got["new"] == ("x", 1, "pending") and got["u4"] == ("old", 1, "pending")
    assert shown(snapshots.read(spark, path, 0))["u3"] == ("old", 1, "pending")
    assert not snapshots.upsert(path, new, ledgers.apply_failure_events, "s", -1)


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshots.create(ledger(spark, 40), path, ["url"], 4)

    def broken(stored, incoming):
        return stored.withColumn("status", F.when(F.rand() >= 0, F.raise_error(F.lit("stop"))).otherwise("x"))

    with pytest.raises(Exception, match="stop"):
        snapshots.upsert(path, ledger(spark, 3), broken)
    assert snapshots.manifest(spark, path)["version"] == 0 and snapshots.read(spark, path).count() == 40
    with pytest.raises(ValueError, match="keys"):
        snapshots.upsert(path, ledger(spark, 1), lambda stored, _: ledger(spark, 40))
    with pytest.raises(snapshots.Conflict):
        snapshots.create(ledger(spark, 1), path, ["url"])

    def overtaken(stored, incoming):
        snapshots.upsert(path, ledger(spark, 2), lambda old, _: old.withColumn("status", F.lit("other writer")))
        return stored

    with pytest.raises(snapshots.Conflict):
        snapshots.upsert(path, ledger(spark, 2), overtaken)
    assert "other writer" in {s for *_, s in shown(snapshots.read(spark, path)).values()}
    snapshots.upsert(path, ledger(spark, 40), lambda old, _: old.where("url <> 'u1'"))
    before = shown(snapshots.read(spark, path))
    assert snapshots.vacuum(spark, path, 1) > 0 and shown(snapshots.read(spark, path)) == before and len(before) == 39
    assert snapshots.vacuum(spark, path, 1) == 0


def test_failures_are_counted_once_when_batches_are_replayed(spark, tmp_path):
    rng = random.Random(3)
    path, source = f"file://{tmp_path}/t", tmp_path / "in"
    source.mkdir()
    rows = [(f"u{rng.randrange(30)}", f"e{k}", at(k % 9, k), rng.choice(("failed", "failed", "resolved"))) for k in range(120)]
    schema = "url string, error_message string, ts timestamp, kind string"
    snapshots.create(spark.createDataFrame([], LEDGER), path, ["url"], 8)
    for part in range(3):
        df = spark.createDataFrame(sorted(rows, key=lambda r: r[2])[40 * part : 40 * part + 40], schema)
        df.coalesce(1).write.mode("append").json(str(source))
        events = spark.readStream.schema(schema).json(str(source))
        jobs.keep_failures(events, path, str(tmp_path / "check")).awaitTermination()
        if part == 1:  # a crash behind the publication: the last batch is not marked as done, and runs again
            done = sorted((tmp_path / "check" / "commits").iterdir(), key=lambda p: p.name)
            number = max(int(p.name) for p in done if p.name.isdigit())
            for p in done:
                if p.name.strip(".").split(".")[0] == str(number):
                    p.unlink()
            before = snapshots.manifest(spark, path)["version"]
            jobs.keep_failures(events, path, str(tmp_path / "check")).awaitTermination()
            assert snapshots.manifest(spark, path)["version"] == before
    want = ledgers.apply_failure_events(spark.createDataFrame([], LEDGER), spark.createDataFrame(rows, schema))
    assert shown(snapshots.read(spark, path)) == shown(want)
    assert snapshots.manifest(spark, path)["batches"] == {"failures": 2}


def test_due_hits_as_a_stream_and_as_a_batch(spark, tmp_path):
    """Late and repeated events: the stream gives what the batch gives of all events."""
    rng = random.Random(5)
    schema = "url string, ts timestamp, kind string"
    events = [(f"u{rng.randrange(6)}", at(rng.randrange(0, 120), rng.randrange(86_400)), rng.choice(("hit", "hit", "crawl"))) for _ in range(300)]
    events += events[:20]  # repeated
    events.sort(key=lambda e: e[1] + dt.timedelta(seconds=rng.randrange(100_000)))  # up to 28 hours out of order
    events += [("end", at(400), "crawl")]
    source = tmp_path / "in"
    for k in range(0, len(events), 80):
        spark.createDataFrame(events[k : k + 80], schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    out = str(tmp_path / "out")
    q = jobs.due_hits(stream, 30, "2 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.url, r.ts) for r in spark.read.parquet(out).collect())
    every = spark.createDataFrame(events, schema)
    want = sorted((r.url, r.ts) for r in ledgers.hits_due(every.where("kind = 'hit'").drop("kind"), every.where("kind = 'crawl'").drop("kind"), 30).collect())
    plain = sorted((u, t.astimezone().replace(tzinfo=None)) for u, t, k in events if k == "hit" and not any(v == u and c == "crawl" and dt.timedelta(0) <= t - s < dt.timedelta(days=30) for v, s, c in events))
    assert got == want and len(want) == len(plain) and 0 < len(want) < sum(k == "hit" for *_, k in events)
