"""Streaming forms: polling with memory, one alert a batch, expiring caches, resumable jobs, event-time windows."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def new_only(batch: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """Rows of a batch that the memory lacks, one per key."""
    return batch.dropDuplicates([key]).join(memory.select(key), key, "left_anti")


def best_alert(batch: DataFrame, value: str, least: float, first: int | None = None, order: str | None = None) -> DataFrame:
    """At most one row: the largest value above ``least``, among the first rows in order if asked."""
    rows = batch.orderBy(order).limit(first) if first else batch
    return rows.filter(F.col(value) > least).orderBy(F.desc(value)).limit(1)


def fresh(cache: DataFrame, now: float, ttl: float = 10_800.0, at: str = "fetched_at") -> DataFrame:
    """Cache rows younger than ``ttl`` seconds."""
    return cache.filter(F.lit(now) - F.col(at) < ttl)


def poll(spark: SparkSession, source: str, schema: str, memory: str, key: str, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None, every: str | None = None):
    """Run files that arrive in ``source`` against a Parquet memory of keys: new rows are handled, then remembered.

    Each batch writes its own folder of the memory, over again if it is retried, so a lost batch repeats without double
    rows. Without ``every`` it takes what is there and ends (a resumable job); with it, it polls.
    """
    stream = spark.readStream.schema(schema).json(source)

    def step(batch: DataFrame, number: int) -> None:
        try:
            seen = spark.read.option("recursiveFileLookup", True).schema(batch.schema).parquet(memory).withColumn("_f", F.col("_metadata.file_path")).filter(~F.col("_f").contains(f"/batch={number}/")).drop("_f")
            fresh_rows = new_only(batch, seen, key)
        except Exception as e:  # no memory yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            fresh_rows = batch.dropDuplicates([key])
        fresh_rows.write.mode("overwrite").parquet(f"{memory.rstrip('/')}/batch={number}")
        if handle:
            handle(spark.read.schema(batch.schema).parquet(f"{memory.rstrip('/')}/batch={number}"), number)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def next_refresh(last: Column, now: Column, every: float, least: float = 60.0) -> Column:
    """Seconds until the next refresh: what is left of the period since the last, never under ``least``; a missed one is caught up after ``least``."""
    return F.greatest(F.lit(least), F.coalesce(last + every - now, F.lit(least)))


def refreshed(current: DataFrame, build: Callable[[], DataFrame], accept: Callable[[DataFrame, DataFrame], bool] = lambda old, new: True) -> tuple[DataFrame, bool]:
    """(table, whether it is new): what ``build`` gives if it comes through and ``accept`` takes it, else the current table."""
    try:
        new = build()
        return (new, True) if accept(current, new) else (current, False)
    except Exception as e:
        warnings.warn(f"refresh failed, the old table stays: {e}", stacklevel=2)
        return current, False


def job_states(polls: DataFrame, deadline: float) -> DataFrame:
    """Per job of polls (job, at, status): the first final status and its time; 'expired' where none came by ``deadline`` seconds after the first poll, else 'waiting'.

    Polls may repeat and come in any order, so a poller that is stopped goes on from its saved polls.
    """
    final = F.col("status").isin("completed", "failed", "cancelled")
    done = F.min(F.when(final, F.struct("at", "status")))
    x = polls.groupBy("job").agg(F.min("at").alias("first"), F.max("at").alias("last"), done.alias("d"))
    in_time = F.col("d").isNotNull() & (F.col("d.at") <= F.col("first") + deadline)
    late = (F.col("last") > F.col("first") + deadline) | F.col("d").isNotNull()
    return x.select("job", F.when(in_time, F.col("d.status")).when(late, "expired").otherwise("waiting").alias("state"), F.when(in_time, F.col("d.at")).alias("at"))


def new_events(polls: DataFrame, key: str, order: str, poll: str) -> DataFrame:
    """Events of polls that repeat what came before: each once, at the poll that saw it first; ``place`` numbers a poll's new events, oldest first."""
    first = polls.groupBy(key).agg(F.min_by(F.struct(*polls.columns), F.struct(F.col(poll), F.col(order))).alias("_e")).select("_e.*")
    return first.withColumn("place", F.row_number().over(W.partitionBy(poll).orderBy(order, key)))


def distinct_stream(stream: DataFrame, keys: list[str], at: str | None = None, within: str | None = None) -> DataFrame:
    """First rows per key; with a time and a delay the state is bounded by a watermark."""
    if at and within:
        return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def tumbling(events: DataFrame, at: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums per window and group (an extension: the reference has no event time)."""
    e = events.withWatermark(at, late) if late and events.isStreaming else events
    return e.groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, by: list[str]) -> DataFrame:
    """Counts per overlapping window (an extension)."""
    return events.groupBy(F.window(at, width, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, at: str, gap: str, by: list[str]) -> DataFrame:
    """Sessions that end after a gap (an extension)."""
    return events.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
