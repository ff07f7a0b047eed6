"""Crawl queue, crawl ledger and failure ledger. Every job returns the new state as a table; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.operators.running import running_sums
from firmlake.sources.shared import tidy


def record_failures(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """``ledger`` (url, error_message, retry_count, last_attempt, status) after ``events`` (url, error_message, ts): pending again."""
    new = events.groupBy("url").agg(F.count("*").alias("n"), F.max_by("error_message", "ts").alias("e"), F.max("ts").alias("t"))
    out = ledger.join(new, "url", "full_outer")
    return out.select(
        "url", F.coalesce("e", "error_message").alias("error_message"), (F.coalesce("retry_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("retry_count"),
        F.coalesce("t", "last_attempt").alias("last_attempt"), F.when(F.col("n").isNotNull(), "pending").otherwise(F.col("status")).alias("status"),
    )


def apply_failure_events(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """``ledger`` after ``events`` (url, error_message, ts, kind), kind "failed" or "resolved": failures count as in
    ``record_failures``, and a URL whose last event resolves it is resolved. Of events at one time a failure counts last."""
    failed = F.col("kind") == "failed"
    out = record_failures(ledger, events.where(failed).select("url", "error_message", "ts"))
    last = events.groupBy("url").agg(F.max_by("kind", F.struct("ts", failed)).alias("last"))
    known = out.join(last, "url", "left")
    return known.withColumn("status", F.when(F.col("last") == "resolved", "resolved").otherwise(F.col("status"))).drop("last")


def resolve_failures(ledger: DataFrame, urls: DataFrame) -> DataFrame:
    done = urls.select("url").distinct().withColumn("done", F.lit(True))
    return ledger.join(done, "url", "left").withColumn("status", F.when(F.col("done"), "resolved").otherwise(F.col("status"))).drop("done")


def retry_candidates(ledger: DataFrame, max_retries: int = 3, limit: int = 100) -> DataFrame:
    return ledger.where((F.col("status") == "pending") & (F.col("retry_count") <= max_retries)).orderBy("last_attempt", "url").limit(limit)


def next_urls(queue: DataFrame, limit: int = 500) -> DataFrame:
    return queue.where("status = 'pending'").orderBy(F.desc("priority_score"), "discovered_at", "url").limit(limit)


def insert_absent(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """``queue`` with the URLs it does not hold yet, each once with its highest priority."""
    new = incoming.join(queue.select("url"), "url", "left_anti").groupBy("url").agg(F.max("priority_score").alias("priority_score"), F.min("discovered_at").alias("discovered_at"))
    return queue.unionByName(new.withColumn("status", F.lit("pending")), allowMissingColumns=True)


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    """``queue`` with the URLs of ``done`` (url, crawled_at) completed."""
    d = done.groupBy("url").agg(F.max("crawled_at").alias("crawled_at"))
    out = queue.join(d, "url", "left").withColumn("status", F.when(F.col("crawled_at").isNotNull(), "completed").otherwise(F.col("status")))
    old = F.col("last_crawled") if "last_crawled" in queue.columns else F.lit(None).cast("timestamp")
    return out.withColumn("last_crawled", F.coalesce("crawled_at", old)).drop("crawled_at")


def queue_summary(queue: DataFrame, crawled: DataFrame, failed: DataFrame) -> DataFrame:
    """One row of counts. Failed crawls stay pending until a job says otherwise, as in the queue's own rules."""
    q = queue.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "completed", "failed")])
    c = crawled.agg(F.count("*").alias("crawled_urls"))
    f = failed.agg(F.count("*").alias("failed_urls"), F.count_if(F.col("status") == "pending").alias("pending_failures"))
    return q.crossJoin(c).crossJoin(f)  # one row each


def upsert_crawled(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest row (url, discovered_query, updated_at) of each URL of both tables."""
    both = ledger.select("url", "discovered_query", "updated_at").unionByName(incoming.select("url", "discovered_query", "updated_at"))
    last = F.max_by(F.struct("discovered_query", "updated_at"), F.struct("updated_at", "discovered_query")).alias("x")
    return both.groupBy("url").agg(last).select("url", "x.*")


def not_recently_crawled(hits: DataFrame, crawled: DataFrame, queue: DataFrame, cutoff, requeue_completed: bool = False) -> DataFrame:
    """Hits whose URL was neither crawled after ``cutoff`` nor ever queued (or only queued and not completed)."""
    fresh = crawled.where(F.col("updated_at") > cutoff).select("url")
    held = (queue.where("status <> 'completed'") if requeue_completed else queue).select("url")
    return hits.join(fresh, "url", "left_anti").join(held, "url", "left_anti")


def hits_due(hits: DataFrame, crawled: DataFrame, days: int = 30) -> DataFrame:
    """Hits (url, ts) whose URL no row of ``crawled`` (url, ts) shows as crawled in the ``days`` before them.

    Crawls of the same and of the next stretch of ``days`` are enough to look at, so a hit meets the crawls of two stretches
    of its URL at most.
    """
    span = F.lit(days * 86_400_000_000)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    stretch = F.floor(micros(F.col("ts")) / span).alias("part")
    last = crawled.where("ts is not null").groupBy("url", stretch).agg(F.collect_set(micros(F.col("ts"))).alias("crawls"))
    reach = last.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    reach = reach.groupBy("url", "part").agg(F.flatten(F.collect_list("crawls")).alias("crawls"))
    out = hits.withColumn("part", stretch).join(reach, ["url", "part"], "left")
    ago = lambda c: micros(F.col("ts")) - c
    recent = F.exists(F.coalesce("crawls", F.array().cast("array<long>")), lambda c: (ago(c) >= 0) & (ago(c) < span))
    return out.where(~recent).drop("part", "crawls")


@tidy
def within_budget(counts: DataFrame, budget: int) -> DataFrame:
    """Queries (seq, n) to run until ``budget`` URLs are found (0: no limit), and how many each may still take.

    The sum of what earlier queries found runs over ranges of seq, so the list may be of any length.
    """
    out = running_sums(counts, {"before": F.col("n")}, [F.col("seq")]).where((F.lit(budget) == 0) | (F.col("before") < budget))
    return out.withColumn("take", F.when(F.lit(budget) == 0, F.col("n")).otherwise(F.least(F.col("n"), budget - F.col("before"))))
