"""As-of and range joins on awkward rows, against plain loops."""

from __future__ import annotations

import datetime as dt
import random

from lakeloom.operators.timejoins import as_of_join, range_join


def test_as_of_join_over_stretches(spark):
    r = random.Random(2)
    at = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    left = [(i, r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *range(0, 400)])) for i in range(120)]
    right = [(r.choice(["hot", "hot", "a", None]), r.choice([None, *range(0, 400)]), i) for i in range(90)]
    a = spark.createDataFrame([(i, k, at(h)) for i, k, h in left], "id long, k string, t timestamp_ntz")
    b = spark.createDataFrame([(k, at(h), v) for k, h, v in right], "k string, t timestamp_ntz, v long")
    got = {x["id"]: x["last_v"] for x in as_of_join(a, b, "k", "t", ["v"], bucket=36 * 3600).collect()}
    want = {}
    for i, k, h in left:
        known = [(hh, v) for kk, hh, v in right if k is not None and kk == k and None not in (h, hh) and hh <= h]
        want[i] = max(known)[1] if known else None
    assert got == want
    assert as_of_join(a.limit(0), b, "k", "t", ["v"]).count() == 0 and as_of_join(a, b.limit(0), "k", "t", ["v"]).where("last_v IS NULL").count() == 120


def test_range_join_of_mixed_widths(spark):
    r = random.Random(4)
    points = [(i, r.choice([None, r.uniform(-500, 500)])) for i in range(80)]
    ranges = [(j, lo, lo + r.choice([-1, 0, 0.001, 3, 40, 900])) for j, lo in enumerate(r.uniform(-500, 500) for _ in range(60))] + [(99, None, 1.0)]
    got = range_join(spark.createDataFrame(points, "i long, x double"), spark.createDataFrame(ranges, "j long, lo double, hi double"), "x", "lo", "hi")
    want = {(i, j) for i, x in points for j, lo, hi in ranges if None not in (x, lo, hi) and lo <= x <= hi}
    rows = [(g["i"], g["j"]) for g in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_range_join_of_any_width(spark):
    inf = float("inf")
    numbers = [None, float("nan"), -inf, inf, 0.0, -1e-300, 1e40, -1e40, 1e300, 5.0, 1e17, 1e17 + 16]
    points = list(enumerate(numbers))
    bounds = [(-inf, inf), (0.0, inf), (-inf, 0.0), (-1e40, 1e40), (1e40, 1e40), (0.0, 1e300), (1e300, inf), (float("nan"), 1.0), (0.0, float("nan")), (inf, inf), (1e17, 1e17 + 16), (4.0, 6.0), (6.0, 4.0)]
    ranges = [(j, lo, hi) for j, (lo, hi) in enumerate(bounds)]
    got = range_join(spark.createDataFrame(points, "i long, x double"), spark.createDataFrame(ranges, "j long, lo double, hi double"), "x", "lo", "hi")
    rows = [(g["i"], g["j"]) for g in got.collect()]
    want = {(i, j) for i, x in points for j, lo, hi in ranges if x is not None and lo <= x <= hi}
    assert len(rows) == len(set(rows)) and set(rows) == want
