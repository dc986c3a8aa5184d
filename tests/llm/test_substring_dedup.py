import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import substring_dedup as sd


def brute(rows, window=sd.WINDOW):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    met = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - window + 1) if met[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=_key)


def _key(row):
    return tuple((x is not None, x) for x in row)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, TEXT string, span int")
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd._removed(df, sd.WINDOW, False, **more).collect()), key=_key)


def words(draw, n, v=500):
    return [f"w{draw.randrange(v)}" for _ in range(n)]


def awkward():
    draw = random.Random(2)
    passage, line = words(draw, 60), words(draw, 36)
    rows = [(1, None), (2, ""), (3, "  \n "), (None, " ".join(words(draw, 80))), (5, "one word " * 100), (6, "a " * 34), (7, "b " * 35), (8, "b " * 36), (9, "b " * 500)]
    rows += [(10 + i, " ".join(words(draw, draw.randrange(40)) + passage + words(draw, draw.randrange(40)))) for i in range(20)]
    rows += [(40 + i, "\n".join(words(draw, 30) + line[i % 3 :] + words(draw, 20))) for i in range(9)]
    copy = " ".join(words(draw, 200))
    rows += [(60, copy), (61, copy), (61, copy), (62, copy + " tail"), (63, "head joined " + copy), (None, copy), (None, "x " * 40), (64, " ".join(passage[:34])), (65, " ".join(passage[3:38]))]
    near = copy.split()
    for i in range(12):
        one = list(near)
        one[draw.randrange(200)] = "edit"
        rows.append((70 + i, "\t".join(one)))
    rows += [(90, " ".join(passage + words(draw, 3) + passage)), (91, " ".join(words(draw, 3000, 40))), (92, "é 你好 " * 30), (93, "x" * 100000), (94, "Case " * 20 + "case " * 40)]
    return rows


def test_awkward_rows_equal_brute_force(spark):
    assert found(spark, awkward()) == brute(awkward())


def test_frequent_symbols_and_slices(spark, monkeypatch):
    for name, value in (("COUNTERS", 8), ("MANY", 2), ("SLICE_WORDS", 70), ("PART_BYTES", 50)):
        monkeypatch.setattr(sd, name, value)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert found(spark, awkward()) == brute(awkward())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_kept_text(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.deduplicated(df).collect()
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=_key) == brute(rows)


@pytest.mark.parametrize("seed", range(8))
def test_equal_windows_have_one_anchor(seed, monkeypatch):
    draw = random.Random(seed)
    window, v = draw.choice([3, 5, 12, 35]), draw.choice([1, 2, 3, 50])
    base = words(draw, draw.randrange(1, 200), v)
    texts = ["", "a"]
    for _ in range(6):
        one = list(base)
        for _ in range(draw.randrange(4)):
            i = draw.randrange(len(one))
            one[i : i + draw.randrange(3)] = words(draw, 1, v) * draw.randrange(1, 40)
        texts.append(" ".join(one))
    monkeypatch.setattr(sd, "SLICE_WORDS", draw.choice([1 << 18, 50, 7]))
    anchor, seen = {}, Counter()
    for text, start, size, symbol, _ in sd._runs_of(pa.array(texts), window):
        for d, s, n, a in zip(text.tolist(), start.tolist(), size.tolist(), symbol.tolist()):
            for k in range(n):
                assert anchor.setdefault(tuple(texts[d].split()[s + k : s + k + window]), a) == a
                seen[d, s + k] += 1
    assert seen == Counter((d, i) for d, t in enumerate(texts) for i in range(len(t.split()) - window + 1))


def test_rounds_shorten_what_is_settled():
    word = np.random.default_rng(1).integers(1, 1 << 63, 20000).astype(np.uint64)
    by_round = sd.settled_symbols(word, np.array([0, len(word)]), 16)
    assert len(by_round) > 6 and len(by_round[2][0]) > len(word) / 5
    assert all((high - low <= 16).all() for low, high in by_round)


def test_empty_table(spark):
    assert sd._removed(spark.createDataFrame([], "doc_id long, text string"), sd.WINDOW, False).count() == 0


def test_the_table_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in sd.op11_substring_dedup(spark, path).collect())
    want = duckdb.sql(sd.dedup_sql(f"'{path}/documents.parquet'")).fetchall()
    assert got == sorted(want) and any(r[2] for r in got)
