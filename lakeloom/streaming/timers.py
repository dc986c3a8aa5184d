"""Keyed state with timers, lists, maps and an end of life."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeloom.streaming.events import drained, events_stream

GAP_MS = 30 * 60 * 1000
#: Open sessions in a row of state.
PACK = 1024
DAY_US = 24 * 3600 * 1_000_000
#: Milliseconds after which a key that no row touched is forgotten.
FORGOTTEN_MS = 24 * 3600 * 1000
#: ``us``: the session's begin in microseconds, made a timestamp by the plan, for all rows at once.
SESSIONS = "user_id long, us long, n long, value double, nth long, nth_of_day long"


class ClosingSessions(StatefulProcessor):
    """Sessions of a user that end half an hour after their last event, closed by timers of event time.

    State of a user: a list of the open sessions (first and last event in microseconds,
    events, sum of values), which are disjoint, ``PACK`` of them in a row of columns, since
    each row of state costs a conversion on both sides; a value, the number of closed ones; a
    map from day to the number closed that began on it, of the last day alone.  So it is
    bounded by the sessions that the watermark leaves open.  Rows may come in any order:
    an event joins the sessions it falls within half an hour of, two of them become one.

    A user has one timer, of the first open session: it closes all that the watermark has
    passed, so state is read and written once a user and batch, not once a session.

    A batch's events of one user are held at once: bound batches by ``maxFilesPerTrigger``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "began array<long>, ended array<long>, n array<long>, value array<double>")
        self.closed = handle.getValueState("closed", "n long")
        self.days = handle.getMapState("days", "day long", "n long")

    def _opened(self) -> list[tuple]:
        return [s for pack in self.open.get() for s in zip(*pack)]

    def _open(self, sessions: list) -> None:
        self.open.put([tuple(map(list, zip(*sessions[i : i + PACK]))) for i in range(0, len(sessions), PACK)])

    def _over(self, session: tuple) -> int:
        """The watermark at which it is closed, in whole milliseconds: the first at or after its end."""
        return -(-session[1] // 1000) + GAP_MS

    def _timer(self, session: tuple) -> int:
        # Spark's timers expire when the watermark is beyond them.
        return self._over(session) - 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._opened()
        pieces = list(before)
        for events in rows:
            pieces += [(t, t, 1, v if v == v and v is not None else 0.0) for t, v in zip(events["us"].tolist(), events["value"].tolist())]
        merged: list[list] = []
        for began, ended, n, value in sorted(pieces):
            if merged and began < merged[-1][1] + GAP_MS * 1000:
                last = merged[-1]
                last[1], last[2], last[3] = max(last[1], ended), last[2] + n, last[3] + value
            else:
                merged.append([began, ended, n, value])
        self._open(merged)
        was, now = self._timer(before[0]) if before else None, self._timer(merged[0])
        if was != now:
            if before:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(now)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        sessions = self._opened()
        done = [s for s in sessions if self._over(s) <= mark]
        stay = sessions[len(done) :]  # sessions are in order of time
        if not done:
            return
        if stay:
            self._open(stay)
            self.handle.registerTimer(self._timer(stay[0]))
        else:
            self.open.clear()
        (nth,) = self.closed.get() or (0,)
        (last,), (of_day,) = next(iter(self.days.iterator()), ((None,), (0,)))
        day, places = last, []
        began, _, n, value = map(list, zip(*done))
        for at in began:
            if at // DAY_US != day:
                day, of_day = at // DAY_US, 0
            of_day += 1
            places.append(of_day)
        if last is not None and last != day:
            self.days.removeKey((last,))
        self.days.updateValue((day,), (of_day,))
        self.closed.update((nth + len(done),))
        yield pd.DataFrame({"user_id": key[0], "us": began, "n": n, "value": value, "nth": range(nth + 1, nth + len(done) + 1), "nth_of_day": places})

    def close(self) -> None:
        pass


class FirstOfLife(StatefulProcessor):
    """A user's first row of each type, and again the first one after the type was forgotten: its state has an end of life in processing time.

    State of a user: a map from type to the first row, each entry with an end of its own, read
    at once.  Rows come and go as such: there are few of a type, so a data frame would cost more than they do.
    """

    def __init__(self, ttl_ms: int = FORGOTTEN_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event_type string", "event_id long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first: dict[str, tuple[int, int]] = {}
        for r in rows:
            first[r.event_type] = min(first.get(r.event_type, (r.at, r.event_id)), (r.at, r.event_id))
        seen = {kind for (kind,), _ in self.seen.iterator()}
        for kind, (_, event_id) in first.items():
            if kind not in seen:
                self.seen.updateValue((kind,), (event_id,))
                yield Row(user_id=key[0], event_type=kind, event_id=event_id)

    def close(self) -> None:
        pass


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Within it new streams keep their state in RocksDB, off the heap."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


def closed_sessions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The sessions that the watermark (``delay`` behind the latest event) has passed; ``events``: a stream with user_id, ts, value."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "ts", F.unix_micros("ts").alias("us"), "value").withWatermark("ts", delay)
    closed = rows.groupBy("user_id").transformWithStateInPandas(ClosingSessions(), SESSIONS, "append", "eventTime")
    return closed.select("user_id", F.timestamp_micros("us").alias("began"), "n", "value", "nth", "nth_of_day")


def first_of_life(events: DataFrame, ttl_ms: int = FORGOTTEN_MS) -> DataFrame:
    # Rows without a time come last; times go as numbers, which are quicker to hand over.
    rows = events.where("user_id IS NOT NULL AND event_type IS NOT NULL").select("user_id", "event_type", F.coalesce(F.unix_micros("ts"), F.lit(2**63 - 1)).alias("at"), "event_id")
    return rows.groupBy("user_id").transformWithState(FirstOfLife(ttl_ms), "user_id long, event_type string, event_id long", "append", "processingTime")


def stream_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers close each user's sessions; the last ones stay open."""
    with state_on_disk(spark):
        out = drained(closed_sessions(events_stream(spark, sf_dir)), "closed")
    return out.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), "n", F.round("value", 6).alias("value"), "nth", "nth_of_day")


def stream_first_of_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State that is forgotten a day after it was written: each user's first event of a type."""
    with state_on_disk(spark):
        return drained(first_of_life(events_stream(spark, sf_dir)), "first-of-life", once=True)


QUERIES = {f.__name__: f for f in (stream_closed_sessions, stream_first_of_life)}
ORACLES = {
    "stream_closed_sessions": """
        WITH e AS (SELECT user_id, ts, value, coalesce(ts >= lag(ts) OVER own + INTERVAL 30 MINUTE, true) AS new FROM events WHERE user_id IS NOT NULL WINDOW own AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, ts, value, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
        closed AS (SELECT user_id, min(ts) AS began, count(*) AS n, round(sum(coalesce(value, 0)), 6) AS value FROM s GROUP BY user_id, k
            HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE user_id IS NOT NULL))
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY began) AS nth, row_number() OVER (PARTITION BY user_id, began::DATE ORDER BY began) AS nth_of_day FROM closed""",
    "stream_first_of_life": "SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL",
}
