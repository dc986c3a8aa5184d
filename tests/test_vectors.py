"""The inverted file against plain comparison of all rows."""

from __future__ import annotations

import math
import random

import numpy as np

from lakeloom.operators import vectors


def brute(rows, k, every):
    size = max({len(v) for _, v in rows if v}, key=lambda n: sum(len(v or []) == n for _, v in rows))
    kept = {}
    for i, v in rows:
        if i is None or not v or len(v) != size or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        u = [x / math.sqrt(sum(y * y for y in v)) for x in v]
        kept[i] = min(kept.get(i, u), u)
    out = {}
    for q in kept:
        if q % every == 0:
            out[q] = sorted((-sum(a * b for a, b in zip(kept[q], kept[x])), x) for x in kept if x != q)[:k]
    return out


def clustered(n, d=8, hot=0.4):
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(12, d))
    which = np.where(draw.random(n) < hot, 0, draw.integers(1, 12, n))
    return [(int(i), (centre[c] + 0.3 * draw.normal(size=d)).tolist()) for i, c in enumerate(which)]


def test_exact_equals_brute_force_on_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", 50)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    rows = clustered(900) + [(None, [1.0] * 8), (2000, None), (2010, [1.0, None] * 4), (2020, [0.0] * 8), (2030, [math.nan] * 8), (2040, [1.0]), (2050, [math.inf] * 8), (5, [9.0] * 8), (5, [1.0] + [0.0] * 7)]
    same = rows[7][1]
    rows += [(3000 + i, same) for i in range(40)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, e array<double>, v string")
    got = {}
    for r in vectors.nearest_vectors(df, "id", "e", "id % 10 = 0", 6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["cosine"]))
    want = brute(rows, 6, 10)
    assert set(got) == set(want)
    for q, near in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert np.allclose([m[2] for m in mine], [-s for s, _ in near])
        if len({round(s, 9) for s, _ in near}) == len(near):
            assert [m[1] for m in mine] == [x for _, x in near]


def test_probed_cells_reach_the_recall(spark):
    """On rows in clusters, and on the given table, whose vectors have none."""
    table = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    for rows in (clustered(3000), table):
        df = spark.createDataFrame(rows, "id long, e array<double>")
        found = {(r["query_id"], r["id"]) for r in vectors.nearest_vectors(df, "id", "e", "id % 100 = 0", 10, exact=False).collect()}
        want = {(q, x) for q, near in brute(rows, 10, 100).items() for _, x in near}
        recall = len(found & want) / len(want)
        print("recall", recall)
        assert recall >= 0.9


def test_empty_and_single(spark):
    assert vectors.nearest_vectors(spark.createDataFrame([], "id long, e array<float>"), "id", "e", "id % 10 = 0").count() == 0
    assert vectors.nearest_vectors(spark.createDataFrame([(0, [1.0])], "id long, e array<float>"), "id", "e", "id % 10 = 0").count() == 0
