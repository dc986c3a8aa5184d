"""Percentiles by selection against numpy."""

from __future__ import annotations

import math
import random

import numpy as np

from lakeloom.operators import percentiles

WANTED = {"low": ("cont", 0.0), "mid": ("cont", 0.5), "p9": ("cont", 0.9), "d75": ("disc", 0.75), "d0": ("disc", 0.0), "top": ("disc", 1.0)}


def test_awkward_values(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "BINS", 4)
    draw = random.Random(6)
    inf = math.inf
    kinds = {
        "hot": lambda: draw.choice([7.0, 7.0, 7.0, draw.gauss(7, 1)]),
        "wide": lambda: draw.choice([0.0, 1e-300, -1e-300, 1e300, -1e300, 5.0, draw.uniform(-1, 1)]),
        "ends": lambda: draw.choice([inf, -inf, math.nan, None, 3.0, 4.0]),
        None: lambda: float(draw.randrange(3)),
        "close": lambda: 1.0 + draw.randrange(5) * 2.0**-52,
    }
    rows = [(k, f()) for k, f in kinds.items() for _ in range(draw.randrange(60, 140))] + [("none", None), ("none", math.nan), ("one", 2.5)]
    got = {r["g"]: r for r in percentiles.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", WANTED).collect()}
    assert set(got) == {k for k, _ in rows}
    for g, r in got.items():
        v = np.sort([x for k, x in rows if k == g and x is not None and not math.isnan(x)])
        if not len(v):
            assert all(r[c] is None for c in WANTED)
            continue
        for name, (kind, p) in WANTED.items():
            if kind == "disc":
                want = v[max(0, math.ceil(p * len(v) - 1e-9) - 1)]
            else:
                at = p * (len(v) - 1)
                a, b = v[math.floor(at)], v[math.ceil(at)]
                want = a if a == b or at % 1 == 0 else a + (b - a) * (at % 1)
            assert r[name] == want or math.isclose(r[name], want, rel_tol=1e-12), (g, name)


def test_whole_table_and_none(spark):
    df = spark.range(100001).selectExpr("cast(id AS double) AS v")
    assert [tuple(r) for r in percentiles.exact_percentiles(df, [], "v", {"m": ("cont", 0.5), "d": ("disc", 0.25)}).collect()] == [(50000.0, 25000.0)]
    assert percentiles.exact_percentiles(df.selectExpr("v", "v AS g").limit(0), ["g"], "v", {"m": ("cont", 0.5)}).count() == 0
