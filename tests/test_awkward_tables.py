"""Every registered query outside the training-data operators on empty tables, and on tables with nulls and repeated rows against its oracle."""

from __future__ import annotations

import os

import duckdb
import pyarrow.parquet as pq
import pytest

from lakeloom.plans import catalog
from tests import test_oracle

SOURCE = "/root/testdata/sf0.001"
#: Columns that every row has: keys, and times that streams and calendars run on.
KEPT = {"ts", "event_id", "o_orderdate", "vec_id", "embedding", "o_orderkey", "n_nationkey"}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Two folders: one of empty tables, one in which a ninth of all values is null and some rows are repeated."""
    empty, holes = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("holes")
    con = duckdb.connect()
    for name in test_oracle.TABLES:
        rows = pq.read_table(f"{SOURCE}/{name}.parquet")
        pq.write_table(rows.slice(0, 0), f"{empty}/{name}.parquet")
        if name == "embeddings":
            pq.write_table(rows, f"{holes}/{name}.parquet")
            continue
        key = rows.schema.names[0]
        columns = ", ".join(c if c in KEPT or c == key else f"CASE WHEN hash({key}, '{c}', _n) % 9 <> 0 THEN {c} END AS {c}" for c in rows.schema.names)
        again = "" if name in ("orders", "events", "documents", "nation", "region", "part", "customer", "supplier") else f" UNION ALL SELECT * FROM rows WHERE hash({key}) % 20 = 0"
        holed = con.execute(f"SELECT * EXCLUDE _n FROM (SELECT {columns}, _n FROM (SELECT *, row_number() OVER () AS _n FROM (SELECT * FROM rows{again})))").to_arrow_table()
        pq.write_table(holed.cast(rows.schema), f"{holes}/{name}.parquet")
    return str(empty), str(holes)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_empty_tables(spark, tables, name):
    catalog.queries()[name](spark, tables[0]).collect()


#: Where Spark and DuckDB differ in what nulls mean, not in the query: their place in an order (ranks, listed), a
#: pattern's result on a null text (text_functions, nested_values), a slope of one point (by_all), grouping by a
#: key that a correlated condition compares (below_average), distinct counts of null flags (merged_sketches).
OTHER_NULLS = {"ranks", "listed", "text_functions", "nested_values", "by_all", "below_average", "merged_sketches"}


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n not in OTHER_NULLS])
def test_nulls_and_repeated_rows(spark, tables, monkeypatch, name):
    monkeypatch.setattr(test_oracle, "SF", tables[1])
    test_oracle.same_rows(spark, name)
