"""Statistics, percentiles, grouping sets and ordered or approximate aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.percentiles import exact_percentiles
from lakeloom.sources.tables import table


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread and shape of quantities; skewness and kurtosis from the raw moments, without a sample correction."""
    x = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.stddev_samp(x).alias("sd"), F.var_pop(x).alias("var"), F.corr("l_quantity", "l_extendedprice").alias("r"), F.covar_samp("l_quantity", "l_discount").alias("cov"),
        F.avg(x).alias("m"), F.avg(x * x).alias("m2"), F.avg(x * x * x).alias("m3"), F.avg(x * x * x * x).alias("m4"),
    )
    third = "(m3 - 3 * m * m2 + 2 * m * m * m) / power(m2 - m * m, 1.5)"
    fourth = "(m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / power(m2 - m * m, 2) - 3"
    return rows.selectExpr("l_returnflag", "round(sd, 6) AS sd", "round(var, 6) AS var", "round(r, 6) AS r", "round(cov, 6) AS cov", f"round({third}, 5) AS skew", f"round({fourth}, 5) AS kurt")


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles by selection: no task holds a group's values."""
    wanted = {"mid": ("cont", 0.5), "p90": ("cont", 0.9), "p25": ("cont", 0.25), "p75": ("disc", 0.75)}
    found = exact_percentiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", wanted)
    return found.select("o_orderpriority", "mid", F.round("p90", 6).alias("p90"), F.round("p25", 6).alias("p25"), "p75")


def grouping_set_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grouping sets in one pass, and aggregates under a filter."""
    return spark.sql(
        """SELECT o_orderstatus, o_orderpriority, cast(grouping_id() AS bigint) AS level, count(*) AS n,
               count(*) FILTER (WHERE o_totalprice > 100000) AS n_large, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS dearest
           FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
        orders=table(spark, sf_dir, "orders"),
    )


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lists, and aggregates of bits and truth values."""
    return spark.sql(
        """SELECT c_nationkey, c_mktsegment, listagg(c_name, ';') WITHIN GROUP (ORDER BY c_acctbal DESC, c_custkey) AS names, bool_and(c_acctbal > -1000) AS sound,
               cast(bit_xor(c_custkey) AS bigint) AS bits, min_by(c_name, struct(c_acctbal, c_custkey)) AS poorest, any_value(c_mktsegment) AS segment
           FROM {customer} GROUP BY c_nationkey, c_mktsegment""",
        customer=table(spark, sf_dir, "customer"),
    )


def by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT p_brand, p_type, count(*) AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope FROM {part} GROUP BY ALL", part=table(spark, sf_dir, "part"))


def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches against exact counts: whether each is within its stated error.

    The exact count has an aggregate of its own: beside it every sketch would be made once a distinct key.
    """
    lines = table(spark, sf_dir, "lineitem")
    near = lines.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("near"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)).alias("hll"), F.percentile_approx("l_quantity", 0.5, 10000).alias("mid_near")
    )
    exact = lines.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("exact"))
    counts = lines.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    mid = counts.groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.5, F.col("n")).alias("mid"))
    rows = near
    for own in (exact, mid):
        own = own.withColumnRenamed("l_returnflag", "_flag")
        rows = rows.join(own, F.col("l_returnflag").eqNullSafe(F.col("_flag"))).drop("_flag")  # a null flag is a group
    return rows.selectExpr("l_returnflag", "exact", "abs(near - exact) <= 0.1 * exact AS near_ok", "abs(hll - exact) <= 0.05 * exact AS hll_ok", "abs(mid - mid_near) <= 1 AS mid_ok")


QUERIES = {f.__name__: f for f in (moments, percentiles, grouping_set_sums, listed, by_all, approximate)}
ORACLES = {
    "moments": """
        SELECT l_returnflag, round(sd, 6) AS sd, round(var, 6) AS var, round(r, 6) AS r, round(cov, 6) AS cov,
               round((m3 - 3 * m * m2 + 2 * m * m * m) / power(m2 - m * m, 1.5), 5) AS skew,
               round((m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / power(m2 - m * m, 2) - 3, 5) AS kurt
        FROM (SELECT l_returnflag, stddev_samp(l_quantity) AS sd, var_pop(l_quantity) AS var, corr(l_quantity, l_extendedprice) AS r, covar_samp(l_quantity, l_discount) AS cov,
                  avg(l_quantity) AS m, avg(l_quantity ** 2) AS m2, avg(l_quantity ** 3) AS m3, avg(l_quantity ** 4) AS m4 FROM lineitem GROUP BY ALL)""",
    "percentiles": """
        SELECT o_orderpriority, median(o_totalprice) AS mid, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.25), 6) AS p25,
               quantile_disc(o_totalprice, 0.75) AS p75 FROM orders GROUP BY ALL""",
    "grouping_set_sums": """
        SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n,
               count(*) FILTER (o_totalprice > 100000) AS n_large, max(o_totalprice) FILTER (o_orderstatus = 'F') AS dearest
        FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
    "listed": """
        SELECT c_nationkey, c_mktsegment, string_agg(c_name, ';' ORDER BY c_acctbal DESC, c_custkey) AS names, bool_and(c_acctbal > -1000) AS sound,
               bit_xor(c_custkey)::BIGINT AS bits, min_by(c_name, (c_acctbal, c_custkey)) AS poorest, any_value(c_mktsegment) AS segment
        FROM customer GROUP BY ALL""",
    "by_all": "SELECT p_brand, p_type, count(*) AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope FROM part GROUP BY ALL",
    "approximate": "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS near_ok, true AS hll_ok, true AS mid_ok FROM lineitem GROUP BY ALL",
}
