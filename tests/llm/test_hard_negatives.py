import math
import random

import duckdb
import numpy as np
import pytest

from lakeloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, LABEL string, codes int"


def brute(rows, every=100):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= hn.LARGEST for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        one = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, one), one)
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1]))
    out = []
    for a in kept:
        if a % every:
            continue
        same = sorted((-score(a, b), b) for b in kept if b != a and kept[b][0] == kept[a][0])[:5]
        other = sorted((-score(a, b), b) for b in kept if kept[b][0] != kept[a][0])
        for s, p in same:
            fits = [(n, c) for n, c in other if 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(a, p, k, c, -s, -n) for k, (n, c) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(df, **more).collect())


def awkward():
    draw = random.Random(3)
    vector = lambda n=6: [draw.uniform(-0.6, 0.9) for _ in range(n)]
    same = vector()
    rows = [(i, vector(), draw.randrange(3)) for i in range(260)]
    rows += [(1000 + i, same, i % 2) for i in range(40)]  # ties, and one label of many
    rows += [(700, None, 1), (800, vector(), None), (901, [0.1, None], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] * 6, 1), (904, [3e7] * 6, 1), (None, vector(), 1)]
    rows += [(905, [], 1), (500, [], 1), (906, vector(3), 2), (600, vector(8), 0), (1000, same, 0), (1000, same, 0), (1000, vector(), 5), (300, [0.0] * 6, 2), (-100, vector(), -5), (400, vector(), 77)]
    return rows


def test_awkward_rows_equal_brute_force(spark):
    assert found(spark, awkward()) == brute(awkward())


def test_blocks_of_anchors_and_of_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 7)
    assert found(spark, awkward(), anchor_every=10) == brute(awkward(), 10)


def test_wide_values_take_two_lookups(spark):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-900000, 1000000) for _ in range(4)], i % 2) for i in range(0, 300)]
    assert found(spark, rows) == brute(rows)


def test_bounds_hold_and_prune(spark):
    rows = hn.integer_rows(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    cells = hn.Cells(rows)
    vectors = np.array([r["v"] for r in rows.collect()], np.int64)
    codes = cells.codes(vectors.astype(np.int32)).T.astype(np.intp)
    left = []
    for a in vectors[:50]:
        low, high = cells.bounds(a, codes)
        score = vectors @ a
        assert (low <= score).all() and (score <= high).all()
        left.append((high >= np.sort(score)[-5]).mean())
    # Rows that the bounds leave to be scored, once the fifth best score is known.
    assert np.mean(left) < 0.2


def test_empty_tables(spark):
    assert hn.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert found(spark, [(100, [0.5], 1)]) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_table_equals_sql(spark, sf):
    got = sorted(tuple(r) for r in hn.op13_hard_negatives(spark, f"/root/testdata/{sf}").collect())
    want = duckdb.sql(hn.negatives_sql(f"'/root/testdata/{sf}/embeddings.parquet'")).fetchall()
    assert got == sorted(want) and got
