"""Joins on two inequalities against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lakeloom.operators import inequality


def sides(seed, n=180):
    draw = random.Random(seed)
    value = lambda: draw.choice([None, 5.0, 5.0, 5.0, float(draw.randrange(12)), draw.uniform(-3, 20)])
    make = lambda first: [(first + i, value(), value()) for i in range(n)]
    return make(0), make(50)


def wanted(left, right):
    return {(a, b) for a, x, y in left for b, u, v in right if None not in (x, y, u, v) and x < u and y > v}


@pytest.mark.parametrize("strip", [3, 40, 100000])
def test_counts_and_pairs(spark, monkeypatch, strip):
    monkeypatch.setattr(inequality, "STRIP_ROWS", strip)
    monkeypatch.setattr(inequality, "PAIR_STRIP_ROWS", strip)
    monkeypatch.setattr(inequality, "PAIR_BLOCK", 20)
    left, right = sides(strip)
    a, b = (spark.createDataFrame([(*r, "s") for r in rows], "k long, x double, y double, xs string") for rows in (left, right))
    want = wanted(left, right)
    counts = {r["id"]: r["n"] for r in inequality.matching_rows(a, b, "x", "y", "k", "k").collect()}
    assert counts == {k: sum(p[0] == k for p in want) for k, *_ in left}
    pairs = [(r["left_id"], r["right_id"]) for r in inequality.inequality_pairs(a, b, "x", "y", "k", "k").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("strip", [3, 40, 100000])
def test_sums_by_a_column_without_pairs(spark, monkeypatch, strip):
    from lakeloom.plans import advanced

    assert not hasattr(advanced, "inequality_pairs")  # no query sums over made pairs
    monkeypatch.setattr(inequality, "STRIP_ROWS", strip)
    left, right = sides(strip + 1)
    wide = lambda k: (-1) ** k * (k + 2**52)
    a = spark.createDataFrame([(*r, None if r[0] % 5 == 4 else r[0] % 5) for r in left], "k long, x double, y double, kind int")
    b = spark.createDataFrame([(*r, wide(r[0])) for r in right], "k long, x double, y double, v long")
    want = {}
    for i, j in wanted(left, right):
        kind = None if i % 5 == 4 else i % 5
        n, total = want.get(kind, (0, 0))
        want[kind] = n + 1, total + wide(j)
    got = inequality.matching_sums(a, b, "x", "y", "k", "k", "kind", "v")
    assert dict(got.dtypes) == {"by": "int", "n": "bigint", "total": "bigint"}
    assert {r["by"]: (r["n"], r["total"]) for r in got.collect()} == want


def test_strips_are_bounded_at_one_hot_value(spark):
    rows = spark.range(20000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7.0D ELSE cast(id AS double) END AS x", "cast(id % 5 AS double) AS y", "id % 2 = 0 AS is_right")
    placed = inequality._strips(rows, 40)
    for name in ("xs", "ys"):
        sizes = [r["count"] for r in placed.groupBy(name).count().collect()]
        assert len(sizes) == 40 and max(sizes) < 4 * 20000 / 40


def test_empty_sides(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0)], "k long, x double, y double")
    assert [tuple(r) for r in inequality.matching_rows(a, a.limit(0), "x", "y", "k", "k").collect()] == [(1, 0)]
    assert inequality.matching_rows(a.limit(0), a, "x", "y", "k", "k").count() == 0
    assert inequality.inequality_pairs(a.limit(0), a, "x", "y", "k", "k").count() == 0


def test_counting_inside_a_strip():
    draw = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 300):
        first, second, right = draw.permutation(n), draw.permutation(n), draw.random(n) < 0.5
        got = inequality._dominated(first, second, right)
        want = [0 if right[i] else int((right & (first > first[i]) & (second < second[i])).sum()) for i in range(n)]
        assert got.tolist() == want
