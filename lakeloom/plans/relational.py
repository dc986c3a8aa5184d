"""Relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, then one two-key aggregation: the filter and six columns reach the scan."""
    price, discount = "cast(l_extendedprice AS decimal(12, 2))", "cast(l_discount AS decimal(4, 2))"  # sums don't depend on the order of rows
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("2001-08-01").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.expr(f"cast(sum({price}) AS double)").alias("sum_base"),
            F.expr(f"cast(sum({price} * (1 - {discount})) AS double)").alias("sum_net"),
            F.expr(f"round(cast(sum({discount}) AS double) / count(*), 6)").alias("avg_disc"),
            F.count("*").alias("n"),
        )
    )


QUERIES = {"pricing_summary": pricing_summary}
ORACLES = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
               sum(l_extendedprice::DECIMAL(12, 2))::DOUBLE AS sum_base,
               sum(l_extendedprice::DECIMAL(12, 2) * (1 - l_discount::DECIMAL(4, 2)))::DOUBLE AS sum_net,
               round(sum(l_discount::DECIMAL(4, 2))::DOUBLE / count(*), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01'
        GROUP BY ALL""",
}
