"""Timers, list and map state and an end of life, batch by batch, against plain loops."""

from __future__ import annotations

import datetime as dt
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from lakeloom.streaming import timers

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
BEGAN = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return None if minutes is None else BEGAN + dt.timedelta(minutes=minutes)


def plain(batches, delay=10, gap=30):
    """Sessions closed after all batches: each batch is filtered by the watermark that those before it left."""
    mark, seen, out = None, {}, set()
    for rows in [*batches, []]:
        for _, m, user, _, value in rows:
            if m is not None and user is not None and (mark is None or m > mark):
                seen.setdefault(user, []).append((m, value or 0.0))
        latest = max((m for _, m, *_ in rows if m is not None), default=None)
        for user, events in seen.items():
            pieces = []
            for m, v in sorted(events):
                if pieces and m < pieces[-1][1] + gap:
                    pieces[-1][1:] = [m, pieces[-1][2] + 1, pieces[-1][3] + v]
                else:
                    pieces.append([m, m, 1, v])
            closed = [p for p in pieces if mark is not None and p[1] + gap <= mark]
            out |= {(user, p[0], p[2], round(p[3], 6)) for p in closed}
            seen[user] = [(m, v) for m, v in events if not any(p[0] <= m <= p[1] for p in closed)]
        if latest is not None:
            mark = max(mark or latest - delay, latest - delay)
    return out


def run(spark, batches, stream_of, folder, **trigger):
    """One file a batch; the same checkpoint throughout."""
    source, out = f"{folder}/source", f"{folder}/out"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(e, at(m), u, k, v) for e, m, u, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = stream_of(spark.readStream.schema(SCHEMA).parquet(source))
        with timers.state_on_disk(spark):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start().awaitTermination(60)
    return spark.read.schema(stream.schema).parquet(out)


def test_sessions_with_late_and_disordered_rows(spark):
    draw = random.Random(4)
    batches, now = [], 0
    for b in range(4):
        now += 240
        rows = [(b * 100 + i, draw.choice([draw.uniform(now - 240, now), draw.uniform(now - 240, now), draw.uniform(0, now)]), draw.choice([1, 2, 3]), "view", draw.choice([1.0, 2.5, None])) for i in range(60)]
        batches.append([*rows, (b * 100 + 98, None, 1, "view", 1.0), (b * 100 + 99, now - 100.0, None, "view", 1.0)])
    folder = tempfile.mkdtemp(prefix="timers-")
    got = run(spark, batches, timers.closed_sessions, folder, availableNow=True)
    rows = got.withColumn("minute", (F.unix_micros("began") - int(BEGAN.timestamp() * 1e6)) / 60e6).collect()
    mine = {(r["user_id"], round(r["minute"], 4), r["n"], round(r["value"], 6)) for r in rows}
    assert mine == {(u, round(m, 4), n, v) for u, m, n, v in plain(batches)} and len(rows) == len(mine) > 10
    by_user = {}
    for r in rows:
        by_user.setdefault(r["user_id"], []).append(r["nth"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_user.values())
    # What is kept: sessions that the watermark leaves open, and one day a user.
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint").collect()
    assert len(state("days")) <= 3 and len(state("closed")) == 3
    assert len(state("open")) <= 3


def test_one_timer_a_user(spark, monkeypatch):
    """Sessions of a user that the watermark passes together are closed in one call, the last one where the watermark meets its end."""
    rows = [(i, 60.0 * i, 1, "view", 1.0) for i in range(40)] + [(90, 60.0 * 39 + 40, 2, "view", 1.0)]
    folder = tempfile.mkdtemp(prefix="calls-")

    class Counted(timers.ClosingSessions):
        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            for frame in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
                yield frame.assign(value=float(len(frame)))

    monkeypatch.setattr(timers, "ClosingSessions", Counted)
    got = run(spark, [rows], timers.closed_sessions, folder, availableNow=True).collect()
    assert sorted((r["user_id"], r["nth"], r["nth_of_day"], r["value"]) for r in got) == [(1, i + 1, i % 24 + 1, 40.0) for i in range(40)]


def test_state_ends(spark):
    rows = [[(1, 5.0, 1, "view", 1.0), (2, 4.0, 1, "view", 1.0), (3, 1.0, 2, "buy", None)], [(4, 6.0, 1, "view", 1.0), (5, 6.0, 3, "view", 1.0)]]
    folder = tempfile.mkdtemp(prefix="ends-")
    long = run(spark, rows, lambda s: timers.first_of_life(s, 3600_000), folder, once=True)
    assert {r["event_id"] for r in long.collect()} == {2, 3, 5}
    folder = tempfile.mkdtemp(prefix="ends-")
    first = run(spark, rows[:1], lambda s: timers.first_of_life(s, 500), folder, once=True)
    assert {r["event_id"] for r in first.collect()} == {2, 3}
    time.sleep(1)
    again = run(spark, rows[1:], lambda s: timers.first_of_life(s, 500), folder, once=True)
    assert {r["event_id"] for r in again.collect()} == {2, 3, 4, 5}


def test_types_of_a_user_are_handled_in_one_call(spark, monkeypatch):
    rows = [(i, 10.0 - i, i % 2, f"type {i % 3}", None) for i in range(1, 13)] + [(13, None, 0, "untimed", 1.0), (14, 1.0, 0, None, 1.0), (15, 1.0, None, "view", 1.0)]
    calls = spark.sparkContext.accumulator(0)

    class Counted(timers.FirstOfLife):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(timers, "FirstOfLife", Counted)
    got = run(spark, [rows], timers.first_of_life, tempfile.mkdtemp(prefix="types-"), once=True).collect()
    # The latest id is the earliest row.
    assert {(r["user_id"], r["event_type"], r["event_id"]) for r in got} == {(i % 2, f"type {i % 3}", i) for i in range(7, 13)} | {(0, "untimed", 13)} and len(got) == 7
    assert calls.value == 2


@pytest.mark.parametrize("stream_of", [timers.closed_sessions])
def test_empty_stream(spark, stream_of):
    assert run(spark, [[]], stream_of, tempfile.mkdtemp(prefix="none-"), availableNow=True).count() == 0
