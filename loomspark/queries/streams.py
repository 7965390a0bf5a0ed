"""Streaming queries: each runs a stream over files to its end and returns what it kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import scratch
from ..registry import query
from ..streaming import streams as S


@query("STR1 STR2", "SELECT DISTINCT user_id FROM events")
def polled_memory(spark, t):
    """Two arrivals of files polled against a memory: every key is handled once."""
    folder = scratch(spark)
    src, memory, mark = f"{folder}/in", f"{folder}/memory", f"{folder}/checkpoint"
    e = t.events.select("user_id", "event_id")
    schema = "user_id long, event_id long"
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        e.filter(part).write.mode("append").json(src)
        S.poll(spark, src, schema, memory, "user_id", mark).awaitTermination()
    return spark.read.option("recursiveFileLookup", True).schema(schema).parquet(memory).select("user_id")


@query("STR3", "SELECT max(value) AS value FROM events WHERE value > 5")
def one_alert(spark, t):
    """At most one alert a batch."""
    return S.best_alert(t.events.select("value"), "value", 5.0)


@query("STR5", """SELECT event_id, greatest(60, coalesce(floor(epoch(ts)) + 300 - 1705276800, 60))::DOUBLE AS wait FROM events""")
def refresh_times(spark, t):
    """Seconds until the next refresh: the period's rest, a missed one soon, never under a minute."""
    return t.events.select("event_id", S.next_refresh(F.unix_timestamp("ts").cast("double"), F.lit(1705276800.0), 300.0).alias("wait"))


@query("STR5 IX2", "SELECT n_nationkey, n_name FROM nation")
def kept_on_failure(spark, t):
    """A refresh that fails, and one that shrinks too much, leave the old table."""
    import warnings

    from ..operators.index import may_shrink

    old = t.nation.select("n_nationkey", "n_name")

    def broken():
        raise OSError("the source is away")

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        kept, new = S.refreshed(old, broken)
    small, newer = S.refreshed(kept, lambda: old.filter("n_nationkey < 3"), may_shrink)
    return small if not (new or newer) else old.limit(0)


POLLS = """polls AS (SELECT user_id AS job, floor(epoch(ts))::DOUBLE AS t, CASE WHEN event_type = 'purchase' THEN 'completed' WHEN value > 180 THEN 'failed' ELSE 'running' END AS status FROM events)"""


@query("STR6", f"""WITH {POLLS}, x AS (SELECT job, min(t) AS t0, max(t) AS t1, min(t) FILTER (WHERE status <> 'running') AS td, min((t, status)) FILTER (WHERE status <> 'running') AS d FROM polls GROUP BY job)
SELECT job, CASE WHEN td <= t0 + 86400 THEN d[2] WHEN t1 > t0 + 86400 OR td IS NOT NULL THEN 'expired' ELSE 'waiting' END AS state, CASE WHEN td <= t0 + 86400 THEN td END AS "at" FROM x""")
def job_states(spark, t):
    """Jobs polled until they are done or a day is over."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("value") > 180, "failed").otherwise("running")
    return S.job_states(t.events.select(F.col("user_id").alias("job"), F.unix_timestamp("ts").cast("double").alias("at"), status.alias("status")), 86_400.0)


@query("STR9", """WITH p AS (SELECT event_id, ts, n AS poll FROM events, (SELECT unnest(range(0, 3)) AS n) WHERE event_id % 3 <= n),
f AS (SELECT event_id, ts, min(poll) AS poll FROM p GROUP BY ALL)
SELECT event_id, poll::INT AS poll, row_number() OVER (PARTITION BY poll ORDER BY ts, event_id) AS place FROM f""")
def new_events(spark, t):
    """Events of three polls, each a repetition of the one before and more: every one once, oldest first."""
    p = t.events.withColumn("poll", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("event_id % 3 <= poll").select("event_id", "ts", "poll")
    return S.new_events(p, "event_id", "ts", "poll").select("event_id", "poll", "place")


@query("STR10 DD13", "SELECT count(DISTINCT user_id || '/' || event_type) AS n FROM events")
def distinct_beacons(spark, t):
    """Different pairs out of a stream."""
    folder = scratch(spark)
    e = t.events.select("user_id", "event_type")
    e.write.parquet(f"{folder}/in")
    s = S.distinct_stream(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), ["user_id", "event_type"])
    s.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("n"))


@query("SC22", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def protocol_beacons(spark, t):
    """Different pairs out of a stream of which only some protocols count: files of records stand for the live source."""
    folder = scratch(spark)
    e = t.events.select("user_id", "event_type")
    e.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{folder}/in").filter(F.col("event_type").isin("view", "click"))
    S.distinct_stream(stream, ["user_id", "event_type"]).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{folder}/out")


@query("STR1", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", name="tumbling_windows")
def tumbling_windows(spark, t):
    """Daily windows (an extension)."""
    return S.tumbling(t.events, "ts", "1 day", ["event_type"]).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("STR1", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY ALL", name="sliding_windows")
def sliding_windows(spark, t):
    """Two-day windows every day (an extension)."""
    return S.sliding(t.events, "ts", "2 days", "1 day", ["event_type"])


@query("STR1", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""", name="session_windows")
def session_windows(spark, t):
    """Sessions that end after six hours (an extension)."""
    return S.sessions(t.events, "ts", "6 hours", ["user_id"])


@query("STR1")
def watermarked_windows(spark, t):
    """A stream's daily counts in append mode: windows come out when the watermark has passed (an extension)."""
    folder = scratch(spark)
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.orderBy("ts").repartitionByRange(3, "ts").write.parquet(f"{folder}/in")
    s = S.tumbling(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), "ts", "1 day", ["event_type"], late="1 hour")
    s.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{folder}/out")


@query("SC3 SC6", "SELECT n_nationkey, n_name FROM nation")
def scanned_files(spark, t):
    """A table through CSV and JSON lines and back."""
    from ..sources import tables as R

    folder = scratch(spark)
    t.nation.select("n_nationkey", "n_name").write.csv(f"{folder}/csv", header=True)
    a = R.read_csv_plain(spark, f"{folder}/csv")
    a.write.json(f"{folder}/json")
    return R.read_jsonl(spark, f"{folder}/json", "n_nationkey int, n_name string", strict=True)
