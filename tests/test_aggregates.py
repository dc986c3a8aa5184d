"""Aggregates with mergeable states against plain numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lakeloom.functions import aggregates


def rows(n=5000):
    draw = random.Random(9)
    key = lambda: draw.choice(["hot", "hot", "hot", "a", "b", None, f"k{draw.randrange(300)}"])
    return [(key(), draw.choice([1, 2, None]), draw.choice([None, draw.gauss(1e6, 3), draw.gauss(-5, 1)]), draw.choice([0.0, 1.0, 2.5, None])) for _ in range(n)]


@pytest.mark.parametrize("held", [5, 100_000])
def test_states_merge_to_the_whole(spark, monkeypatch, held):
    monkeypatch.setattr(aggregates, "HELD_GROUPS", held)
    data = rows()
    df = spark.createDataFrame(data, "g string, h int, v double, w double").repartition(9)
    groups = {}
    for g, h, v, w in data:
        if v is not None and w is not None:
            groups.setdefault((g, h), []).append((v, w))
    got = {(r["g"], r["h"]): (r["w_mean"], r["w_var"]) for r in aggregates.aggregated(df, ["g", "h"], ["v", "w"], aggregates.WeightedMoments()).collect()}
    assert set(got) == set(groups)
    for k, pairs in groups.items():
        v, w = np.array(pairs).T
        if w.sum() == 0:
            assert got[k] == (None, None)
            continue
        mean = (v * w).sum() / w.sum()
        assert math.isclose(got[k][0], mean, rel_tol=1e-9) and math.isclose(got[k][1], (w * (v - mean) ** 2).sum() / w.sum(), rel_tol=1e-6, abs_tol=1e-6)
    spread = {r["g"]: r["spread"] for r in aggregates.aggregated(df, ["g"], ["v"], aggregates.Spread()).collect()}
    want = {}
    for g, _, v, _ in data:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert spread == {g: max(v) - min(v) for g, v in want.items()}


def test_one_group_of_all_rows_and_none(spark):
    df = spark.range(100000).selectExpr("1 AS g", "cast(id AS double) AS v").repartition(20)
    assert [tuple(r) for r in aggregates.aggregated(df, ["g"], ["v"], aggregates.Spread()).collect()] == [(1, 99999.0)]
    assert [tuple(r) for r in aggregates.aggregated(df, [], ["v"], aggregates.Spread()).collect()] == [(99999.0,)]
    assert aggregates.aggregated(df.limit(0), ["g"], ["v"], aggregates.Spread()).count() == 0
