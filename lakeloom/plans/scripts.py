"""SQL scripts, statements built at run time, join forms and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import table


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL script: a loop finds the least power of two that a tenth of the quantities' sum stays below."""
    path = f"{sf_dir}/lineitem.parquet"
    return spark.sql(
        f"""BEGIN
              DECLARE bound BIGINT DEFAULT 1;
              DECLARE total DOUBLE;
              SET total = (SELECT sum(l_quantity) / 10 FROM parquet.`{path}`);
              WHILE bound <= total DO
                SET bound = bound * 2;
              END WHILE;
              SELECT bound, total < bound AS below, total >= bound / 2 AS least;
            END"""
    )


def executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXECUTE IMMEDIATE with named parameters."""
    path = f"{sf_dir}/orders.parquet"
    return spark.sql(
        f"""EXECUTE IMMEDIATE 'SELECT o_orderpriority, count(*) AS n FROM parquet.`{path}` WHERE o_orderstatus = :status AND o_totalprice > :least GROUP BY o_orderpriority'
            USING 'F' AS status, 1000 AS least"""
    )


def using_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USING and NATURAL joins: the key appears once, and comes from either side of a full one."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey").where("custkey % 3 > 0")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey").where("custkey % 2 = 0")
    return spark.sql(
        """SELECT 'full' AS kind, count(custkey) AS keys, count(DISTINCT custkey) AS n_keys, count(o_orderkey) AS orders, count(c_nationkey) AS customers FROM {orders} FULL JOIN {customers} USING (custkey)
           UNION ALL SELECT 'natural', count(custkey), count(DISTINCT custkey), count(o_orderkey), count(c_nationkey) FROM {orders} NATURAL JOIN {customers}""",
        orders=orders, customers=customers,
    )


def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches made by group and merged: theta (union and intersection) and KLL quantiles.

    Each is compared with the exact value within its stated error.
    """
    lines = table(spark, sf_dir, "lineitem")
    by_flag = lines.groupBy("l_returnflag").agg(F.expr("theta_sketch_agg(l_partkey, 14)").alias("theta"), F.expr("kll_sketch_agg_double(l_extendedprice, 800)").alias("kll"))
    both = "theta_union_agg(theta, 14)" if lines.isEmpty() else "theta_intersection_agg(theta)"  # an intersection of nothing is an error
    merged = by_flag.agg(F.expr("theta_union_agg(theta, 14)").alias("any_flag"), F.expr(both).alias("all_flags"))
    either = merged.selectExpr("theta_sketch_estimate(any_flag) AS any_flag", "theta_sketch_estimate(all_flags) AS all_flags")
    flags = lines.groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("k"))
    exact = flags.agg(F.count("*").alias("n_any"), F.count_if(F.col("k") == lines.select("l_returnflag").distinct().count()).alias("n_all"))
    middle = by_flag.selectExpr("l_returnflag", "kll_sketch_get_quantile_double(kll, 0.5) AS near")
    # The share of prices at or below the sketch's median.
    ranked = lines.join(middle, "l_returnflag").groupBy("l_returnflag").agg(F.avg(F.when(F.col("l_extendedprice") <= F.col("near"), 1.0).otherwise(0.0)).alias("share"))
    sound = ranked.agg(F.max(F.abs(F.col("share") - 0.5)).alias("off"))
    return either.crossJoin(exact).crossJoin(sound).selectExpr("n_any", "n_all", "abs(any_flag - n_any) <= 0.05 * n_any AS any_ok", "abs(all_flags - n_all) <= 0.05 * n_any AS all_ok", "off <= 0.02 AS kll_ok")


def frequent_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """approx_top_k: with more counters than values its counts are exact."""
    return spark.sql("SELECT top.item AS o_orderpriority, cast(top.count AS bigint) AS n FROM (SELECT explode(approx_top_k(o_orderpriority, 3, 100)) AS top FROM {orders})", orders=table(spark, sf_dir, "orders"))


QUERIES = {f.__name__: f for f in (scripted, executed, using_joins, merged_sketches, frequent_types)}
ORACLES = {
    "scripted": """
        SELECT (2 ** ceil(log2(s)))::BIGINT AS bound, true AS below, true AS least FROM (SELECT sum(l_quantity) / 10 AS s FROM lineitem)""",
    "executed": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY ALL",
    "using_joins": """
        WITH o AS (SELECT o_custkey AS custkey, o_orderkey FROM orders WHERE o_custkey % 3 > 0), c AS (SELECT c_custkey AS custkey, c_nationkey FROM customer WHERE c_custkey % 2 = 0)
        SELECT 'full' AS kind, count(custkey) AS keys, count(DISTINCT custkey) AS n_keys, count(o_orderkey) AS orders, count(c_nationkey) AS customers FROM o FULL JOIN c USING (custkey)
        UNION ALL SELECT 'natural', count(custkey), count(DISTINCT custkey), count(o_orderkey), count(c_nationkey) FROM o NATURAL JOIN c""",
    "merged_sketches": """
        SELECT count(*) AS n_any, count(*) FILTER (k = (SELECT count(DISTINCT l_returnflag) FROM lineitem)) AS n_all, true AS any_ok, true AS all_ok, true AS kll_ok
        FROM (SELECT l_partkey, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY ALL)""",
    "frequent_types": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC LIMIT 3",
}
