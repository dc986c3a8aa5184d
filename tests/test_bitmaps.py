"""Bitmap counts and frequent values on awkward rows, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lakeloom.operators import bitmaps, heavy

LEVELS = [["a", "b"], ["a"], ["b"], []]


def test_counts_of_all_levels_and_merged_states(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["x", "y", None]), draw.choice([1, 2, None]), draw.choice([None, 0, -1, 1, 32768, 32769, -32768, 10**12, draw.randrange(-(10**6), 10**6)])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "a string, b int, v long")
    by = ["a", "b"]
    once = bitmaps.bitmap_states(df, by, "v")
    cut = bitmaps.merged_states([bitmaps.bitmap_states(df.where(c), by, "v") for c in ("v % 3 = 0", "v % 3 <> 0", "v > 100")], by)
    want = set()
    for bits, level in ((0, (0, 1)), (1, (0,)), (2, (1,)), (3, ())):
        groups = {}
        for r in rows:
            if r[2] is not None:
                groups.setdefault(tuple(r[i] if i in level else None for i in (0, 1)), set()).add(r[2])
        want |= {(*k, bits, len(v)) for k, v in groups.items()}
    for states in (once, cut):
        got = [(r["a"], r["b"], r["level"], r["n_distinct"]) for r in bitmaps.distinct_counts(states, by, LEVELS).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert bitmaps.distinct_counts(bitmaps.bitmap_states(df.limit(0), by, "v"), by, LEVELS).count() == 0


@pytest.mark.parametrize("width", [16, 4096])
def test_heavy_hitters_are_whole(spark, width):
    draw = random.Random(width)
    values = [draw.choice([None, "hot", "hot", f"w{draw.randrange(40)}", f"cold{draw.randrange(5000)}", ""]) for _ in range(20000)]
    df = spark.createDataFrame([(v, "x") for v in values], "v string, value string").repartition(7)
    counts = Counter(v for v in values if v is not None)
    total = sum(counts.values())
    for share in (0.4, 0.01, 0.003):
        got = {r["value"]: (r["n"], r["estimate"]) for r in heavy.heavy_hitters(df, "v", share, width=width).collect()}
        assert {k: n for k, (n, _) in got.items()} == {k: n for k, n in counts.items() if n > share * total}
        assert all(e >= n for n, e in got.values())


def test_estimates_keep_their_bound_and_merge(spark):
    draw = random.Random(1)
    values = [f"v{int(draw.paretovariate(0.8))}" for _ in range(30000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    parts = heavy.merged([heavy.sketch(df.where(c), "v", 0.01, width=512) for c in ("length(v) < 3", "length(v) >= 3")])
    whole = heavy.sketch(df, "v", 0.01, width=512)
    counters = lambda s: {(r["row"], r["cell"]): r["n"] for r in s.where("kind = 0").collect()}
    assert counters(parts) == counters(whole)
    counts = Counter(values)
    asked = spark.createDataFrame([(v,) for v in [*list(counts)[:400], "never"]], "value string")
    got = {r["value"]: r["estimate"] for r in heavy.estimates(whole, asked, width=512).collect()}
    assert all(e >= counts[v] for v, e in got.items())
    assert sum(e - counts[v] > 2.72 / 512 * len(values) for v, e in got.items()) <= 0.01 * len(got)
    assert heavy.heavy_hitters(df.limit(0), "v", 0.01).count() == 0
