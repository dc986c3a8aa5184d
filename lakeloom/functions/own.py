"""Pandas, table and SQL functions over the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lakeloom.functions.aggregates import Spread, WeightedMoments, aggregated
from lakeloom.sources.tables import table


@F.pandas_udf(DoubleType())
def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
    return price * (1 - discount)


@F.udtf(returnType=StructType([StructField("part", StringType()), StructField("n", LongType())]))
class Parts:
    """The dot-separated parts of a host, from the last one; none of a null host."""

    def eval(self, host: str):
        if host is not None:
            for i, part in enumerate(reversed(host.split("."))):
                yield part, i


def pandas_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar pandas function, and aggregates whose states are merged: no worker sees a whole group."""
    lines = table(spark, sf_dir, "lineitem").withColumn("net", discounted("l_extendedprice", "l_discount"))
    by = ["l_returnflag", "l_linestatus"]
    net = aggregated(lines, by, ["net"], Spread()).withColumnRenamed("spread", "net_spread")
    moments = aggregated(lines, by, ["l_discount", "l_quantity"], WeightedMoments()).toDF("_flag", "_status", "w_mean", "w_var")
    rows = net.join(moments, F.col("l_returnflag").eqNullSafe(F.col("_flag")) & F.col("l_linestatus").eqNullSafe(F.col("_status")), "left")
    return rows.select(*by, F.round("net_spread", 4).alias("net_spread"), F.round("w_mean", 8).alias("w_mean"), F.round("w_var", 8).alias("w_var"))


def _frames(orders: DataFrame) -> int:
    """Groups of customers: the orders of one are a pandas frame of some megabytes at any scale."""
    return max(8, orders.count() // 100_000)


def grouped_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """applyInPandas on groups of many customers: each one's orders with the gap to the one before."""

    def gaps(orders: pd.DataFrame) -> pd.DataFrame:
        orders = orders.sort_values(["o_custkey", "o_orderdate", "o_orderkey"])
        gap = orders.groupby("o_custkey", dropna=False)["o_orderdate"].diff().dt.days.astype("float64")
        return pd.DataFrame({"o_orderkey": orders["o_orderkey"], "gap_days": gap})

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    frame = F.pmod(F.xxhash64("o_custkey"), F.lit(_frames(orders)))
    return orders.groupBy(frame.alias("frame")).applyInPandas(gaps, "o_orderkey long, gap_days double")


def arrow_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mapInArrow: a filter and a column in Arrow, batch by batch."""

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            kept = batch.filter(pc.greater(batch.column(1), 5000.0))
            yield pa.RecordBatch.from_arrays([kept.column(0), pc.floor(kept.column(1))], ["c_custkey", "whole"])

    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").mapInArrow(large, "c_custkey long, whole double")


def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python table function called laterally from SQL, and a SQL function that Catalyst inlines."""
    spark.udtf.register("lakeloom_host_parts", Parts)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lakeloom_page_host(url STRING) RETURNS STRING RETURN split_part(url, '/', 3)")
    return spark.sql("SELECT page_id, part, n FROM (SELECT page_id, lakeloom_page_host(url) AS host FROM {pages}) p, LATERAL lakeloom_host_parts(p.host)", pages=table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (pandas_functions, grouped_maps, arrow_maps, table_functions)}
ORACLES = {
    "pandas_functions": """
        WITH m AS (SELECT l_returnflag AS f, l_linestatus AS s, sum(l_discount * l_quantity) / sum(l_quantity) FILTER (l_discount IS NOT NULL) AS w_mean FROM lineitem GROUP BY ALL)
        SELECT l_returnflag, l_linestatus, round(max(l_extendedprice * (1 - l_discount)) - min(l_extendedprice * (1 - l_discount)), 4) AS net_spread, round(any_value(w_mean), 8) AS w_mean,
               round(sum(l_quantity * (l_discount - w_mean) ** 2) / sum(l_quantity) FILTER (l_discount IS NOT NULL), 8) AS w_var
        FROM lineitem JOIN m ON l_returnflag IS NOT DISTINCT FROM f AND l_linestatus IS NOT DISTINCT FROM s GROUP BY ALL""",
    "grouped_maps": """
        SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)::DOUBLE AS gap_days FROM orders""",
    "arrow_maps": "SELECT c_custkey, floor(c_acctbal)::DOUBLE AS whole FROM customer WHERE c_acctbal > 5000",
    "table_functions": """
        SELECT page_id, part, n FROM (SELECT page_id, unnest(list_reverse(string_split(split_part(url, '/', 3), '.'))) AS part,
            unnest(range(len(string_split(split_part(url, '/', 3), '.')))) AS n FROM pages)""",
}
