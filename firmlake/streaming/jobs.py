"""Streaming forms of batch jobs, over file or other streaming sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from firmlake.operators.ledgers import apply_failure_events
from firmlake.operators.pages import domain_bundles
from firmlake.sources import snapshots


def failure_ledger(events: DataFrame) -> DataFrame:
    """Failures by URL kept from a stream of (url, error_message, ts), for update or complete mode."""
    return events.groupBy("url").agg(F.count("*").alias("retry_count"), F.max_by("error_message", "ts").alias("error_message"), F.max("ts").alias("last_attempt"))


def keep_failures(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the failure ledger, a table of ``sources.snapshots`` keyed by url, from a stream of (url, error_message, ts,
    kind), kind "failed" or "resolved". A batch that is replayed after a crash finds its number published and changes
    nothing; others rewrite the buckets of their URLs."""
    def batch(frame: DataFrame, number: int) -> None:
        snapshots.upsert(path, frame, apply_failure_events, "failures", number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_discoveries(hits: DataFrame, days: int = 30, key: str = "url", ts: str = "ts") -> DataFrame:
    """Hits whose URL was not seen in the last ``days``; state older than that is dropped."""
    return hits.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark([key])


def due_hits(events: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """(url, ts) of the hits in a stream of (url, ts, kind), kind "hit" or "crawl", whose URL was not crawled in the ``days``
    before them; each crawl starts that time anew.

    A hit waits until the watermark, ``late`` behind the newest event, has passed it, so crawls that come late still
    count, and the stream gives the rows that ``hits_due`` gives of all events at once. Of each URL the crawls of the last
    ``days`` are kept, and nothing once they are older.
    """
    span = days * 86_400_000_000  # all times in microseconds, but for the watermark

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        crawls, waiting = map(list, state.get) if state.exists else ([], [])
        for frame in frames:
            crawls += frame["at"][frame.kind == "crawl"].tolist()
            waiting += frame["at"][frame.kind == "hit"].tolist()
        now = state.getCurrentWatermarkMs()
        ready, waiting = sorted(t for t in waiting if t // 1000 < now), [t for t in waiting if t // 1000 >= now]
        due = [t for t in ready if not any(t - span < c <= t for c in crawls)]
        # a hit that may still come is not older than the watermark
        crawls = sorted({c for c in crawls if c > now * 1000 - span})
        if crawls or waiting:
            state.update((crawls, waiting))
            state.setTimeoutTimestamp(max(now + 1, min(waiting or [max(crawls) + span]) // 1000 + 1))
        else:
            state.remove()
        if due:
            yield pd.DataFrame({"url": key[0], "at": due})

    kind = events.schema["url"].dataType.simpleString()
    grouped = events.where("url is not null and ts is not null").select("url", "ts", F.unix_micros("ts").alias("at"), "kind").withWatermark("ts", late).groupBy("url")
    found = grouped.applyInPandasWithState(decide, f"url {kind}, at bigint", "crawls array<bigint>, waiting array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("url", F.timestamp_micros("at").alias("ts"))


def keep_bundles(pages: DataFrame, all_pages: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """On every batch of new pages, bundles their domains anew from ``all_pages(batch)`` and hands them to ``write``."""
    def batch(frame: DataFrame, number: int) -> None:
        write(domain_bundles(all_pages(frame)), number)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
