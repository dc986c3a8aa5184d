"""Event-time streams over the events table that end with the input.

The stream reads a folder of Parquet files, keeps state up to the watermark and
writes to a shared folder; the batch query over the same rows is its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakeloom.scratch import scratch_path


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream of the events; their times get the zone that watermarks ask for."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # The table may be a file or a folder: the pattern takes that name alone.
    return spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, what: str, **trigger: bool) -> DataFrame:
    """Append the stream's rows to a shared folder until the input ends, and read them.

    Streams of processing time never end by themselves: they ask for ``once=True``, one batch.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, what)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch_path(spark, f"{what}-checkpoint")).trigger(**(trigger or {"availableNow": True})).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drained_states(stream: DataFrame, what: str, keys: list[str], mode: str) -> DataFrame:
    """Of a stream in update or complete mode the last row of each key; every batch is written under its number."""
    spark = stream.sparkSession
    out = scratch_path(spark, what)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", scratch_path(spark, f"{what}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch int").parquet(out)
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_batch")))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last", "_batch", "batch")


def _naive(column: str, alias: str):
    return F.col(column).cast("timestamp_ntz").alias(alias)


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by event type; hours the watermark has not passed are not final and not written."""
    events = events_stream(spark, sf_dir).withWatermark("ts", "2 hours")
    counts = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))
    return drained(counts.select(_naive("window.start", "hour"), "event_type", "n", "n_high"), "hourly")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day that begin every six hours."""
    counts = events_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day", "6 hours")).agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return drained(counts.select(_naive("window.start", "began"), "n", "most"), "sliding")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour sessions per user that the watermark has closed."""
    counts = events_stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return drained(counts.select("user_id", _naive("session_window.start", "began"), "n"), "sessions")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user, event type, day): a repetition finds the first one in the state, which ends a day after it."""
    events = events_stream(spark, sf_dir).withColumn("day", F.window("ts", "1 day").start).withWatermark("day", "1 day")
    return drained(events.select("user_id", "event_type", "day").dropDuplicates().select("user_id", "event_type", _naive("day", "day")), "first-seen")


def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event sent twice comes out once; the state holds an event for the watermark's hour."""
    twice = events_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("ts", "1 hour")
    return drained(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"), "deduplicated")


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts by type in update mode: the last state of each."""
    return drained_states(events_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("latest")), "totals", ["event_type"], "update")


def stream_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts anew with every batch (complete mode)."""
    return drained_states(events_stream(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("part")).agg(F.count("*").alias("n")), "complete", ["part"], "complete")


def stream_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams: each error with the same user's clicks of the six hours before it; state on both sides ends with the watermarks."""
    errors = events_stream(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("u"), F.col("ts").alias("at")).withWatermark("at", "1 hour")
    clicks = events_stream(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("clicked")).withWatermark("clicked", "1 hour")
    return drained(errors.join(clicks, F.expr("u = user_id AND clicked <= at AND clicked >= at - INTERVAL 6 HOURS")).select("error_id", "click_id"), "joined")


_HOUR = "date_trunc('hour', ts)"
QUERIES = {f.__name__: f for f in (stream_hourly, stream_sliding, stream_sessions, stream_first_seen, stream_deduplicated, stream_totals, stream_complete, stream_joined)}
ORACLES = {
    "stream_hourly": f"""
        SELECT {_HOUR}::TIMESTAMP AS hour, event_type, count(*) AS n, (count(*) FILTER (value > 50))::BIGINT AS n_high FROM events
        WHERE {_HOUR} + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""",
    "stream_sliding": """
        SELECT began, count(*) AS n, max(value) AS most FROM (
            SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 6 HOUR FOR i IN range(4)]) AS began, value FROM events)
        WHERE began + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""",
    "stream_sessions": """
        SELECT user_id, min(ts) AS began, count(*) AS n
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
              FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
        GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_first_seen": "SELECT DISTINCT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day FROM events",
    "stream_deduplicated": "SELECT event_id, user_id FROM events",
    "stream_totals": "SELECT event_type, count(*) AS n, max(event_id) AS latest FROM events GROUP BY ALL",
    "stream_complete": "SELECT user_id % 10 AS part, count(*) AS n FROM events GROUP BY ALL",
    "stream_joined": """
        SELECT e.event_id AS error_id, c.event_id AS click_id FROM events e JOIN events c ON e.user_id = c.user_id
        WHERE e.event_type = 'error' AND c.event_type = 'click' AND c.ts <= e.ts AND c.ts >= e.ts - INTERVAL 6 HOUR""",
}
