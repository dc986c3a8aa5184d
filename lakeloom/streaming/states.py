"""Streams with state of their own, late rows fed file by file, and the memory sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeloom.scratch import scratch_path
from lakeloom.streaming.events import drained, events_stream


class Streaks(StatefulProcessor):
    """Ten events of a user close a lap: its number, its last event and the sum of its event ids.

    Rows come in any order within a batch and are put in order of time there; the
    state of a user is one row, whatever the number of events.
    A batch's events of one user are held at once: bound batches by ``maxFilesPerTrigger``.
    """

    LAP = 10

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lap = handle.getValueState("lap", "lap long, seen long, ids long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lap, seen, ids = self.lap.get() if self.lap.exists() else (0, 0, 0)
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        # Running counts and sums tell every lap's end at once.
        place = seen + pd.Series(range(1, len(events) + 1))
        total = ids + events["event_id"].reset_index(drop=True).cumsum()
        ends = place % self.LAP == 0
        sums = total[ends].diff().fillna(total[ends])
        yield pd.DataFrame({"user_id": key[0], "lap": lap + pd.Series(range(1, int(ends.sum()) + 1), index=sums.index, dtype="int64"), "last_id": events["event_id"].reset_index(drop=True)[ends], "ids": sums})
        closed = int(ends.sum())
        self.lap.update((lap + closed, (seen + len(events)) % self.LAP, int(total.iloc[-1] - (total[ends].iloc[-1] if closed else 0))))

    def close(self) -> None:
        pass


def stream_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom state by user (transformWithState); the state lives in RocksDB, off the heap."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        laps = events_stream(spark, sf_dir).where("user_id IS NOT NULL").select("user_id", "ts", "event_id").groupBy("user_id").transformWithStateInPandas(Streaks(), "user_id long, lap long, last_id long, ids long", "append", "none")
        return drained(laps, "laps")
    finally:
        spark.conf.set(provider, before)


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows: the events come as three files, one a batch, the middle of the time range last.

    A batch filters by the watermark that the batches before it left: the first two
    files hold the first third of the days and the last one, so what the third holds
    is behind the watermark and counts nowhere.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    low, high = events.agg(F.min("day"), F.max("day")).first()
    if low is None:
        return spark.createDataFrame([], "day timestamp_ntz, n long")
    third = (high - low) // 3
    parts = [events.where(F.col("day") <= low + third), events.where(F.col("day") > high - third), events.where((F.col("day") > low + third) & (F.col("day") <= high - third))]
    source = scratch_path(spark, "late-source")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(files)
    out, checkpoint = scratch_path(spark, "late"), scratch_path(spark, "late-checkpoint")
    stream = spark.readStream.schema(events.select("event_id", "ts").schema).option("recursiveFileLookup", "true").parquet(source)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "6 hours")
    counts = stream.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n")
    for i, part in enumerate(parts):
        part.select("event_id", "ts").write.parquet(f"{source}/part={i}")
        counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


def stream_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory sink, for results of a stated size: a row an event type."""
    name = f"types_{uuid.uuid4().hex}"
    counts = events_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


QUERIES = {f.__name__: f for f in (stream_laps, stream_late, stream_in_memory)}
ORACLES = {
    "stream_laps": f"""
        SELECT user_id, lap, max_by(event_id, place) AS last_id, sum(event_id)::BIGINT AS ids
        FROM (SELECT *, (place - 1) // {Streaks.LAP} + 1 AS lap FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE user_id IS NOT NULL))
        GROUP BY ALL HAVING count(*) = {Streaks.LAP}""",
    "stream_late": """
        WITH e AS (SELECT ts, ts::DATE AS day FROM events), b AS (SELECT min(day) AS low, max(day) AS high, (max(day) - min(day)) // 3 AS third, max(ts) AS latest FROM e)
        SELECT day::TIMESTAMP AS day, count(*) AS n FROM e, b WHERE (day <= low + third::INT OR day > high - third::INT) AND day + INTERVAL 1 DAY <= latest - INTERVAL 6 HOUR GROUP BY ALL""",
    "stream_in_memory": "SELECT event_type, count(*) AS n, min(event_id) AS least FROM events GROUP BY ALL",
}
