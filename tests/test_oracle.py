"""Every registered query against its oracle, by sorted rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def same_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})")
    want = sorted(repr([plain(v) for v in r]) for r in rel.fetchall())
    assert got == want
    assert got


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "pipeline"))])
def test_matches_oracle(spark, name):
    same_rows(spark, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
