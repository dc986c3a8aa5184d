"""Ranks and frames, and rewrites of window forms that Spark's SQL lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.sources.tables import table


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = W.partitionBy("p_brand").orderBy("p_size")
    settled = W.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    rows = table(spark, sf_dir, "part")
    return rows.select(
        "p_partkey",
        F.rank().over(own).cast("long").alias("rank"),
        F.dense_rank().over(own).cast("long").alias("dense"),
        F.round(F.percent_rank().over(own), 9).alias("share"),
        F.round(F.cume_dist().over(own), 9).alias("upto"),
        F.ntile(4).over(settled).cast("long").alias("quarter"),
        F.lead("p_partkey", 2).over(settled).alias("two_on"),
        F.nth_value("p_partkey", 3).over(settled.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("third"),
    )


def qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a window (QUALIFY): orders above their customer's mean, the dearest of each day."""
    rows = table(spark, sf_dir, "orders").withColumns({"_mean": F.avg("o_totalprice").over(W.partitionBy("o_custkey")), "_place": F.row_number().over(W.partitionBy("o_orderdate").orderBy(F.desc("o_totalprice"), "o_orderkey"))})
    return rows.where("o_totalprice > _mean AND _place = 1").select("o_orderkey", "o_custkey")


def frames_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GROUPS frames as ranges over dense ranks, EXCLUDE by subtraction, and a distinct count over a window without sets.

    Of the types in the days from one before to one after, those of the day before count all,
    those of the day itself if the type was last seen two days ago or earlier, those of the day
    after if three: three counts a user and day, added up by lag and lead.
    """
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    events = events.withColumn("_group", F.dense_rank().over(W.partitionBy("user_id").orderBy("day")))
    types = events.where("event_type IS NOT NULL").select("user_id", "_group", "event_type").distinct()
    ago = F.coalesce(F.col("_group") - F.lag("_group").over(W.partitionBy("user_id", "event_type").orderBy("_group")), F.lit(3))
    days = types.withColumn("_ago", ago).groupBy("user_id", "_group").agg(F.count("*").alias("_all"), F.count_if(F.col("_ago") >= 2).alias("_two"), F.count_if(F.col("_ago") >= 3).alias("_three"))
    days = days.withColumnsRenamed({"user_id": "_user", "_group": "_day"})
    every = events.select("user_id", "_group").distinct().join(days, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_group") == F.col("_day")), "left").fillna(0, ["_all", "_two", "_three"])
    by_user = W.partitionBy("user_id").orderBy("_group")
    distinct = every.select("user_id", "_group", (F.coalesce(F.lag("_all").over(by_user), F.lit(0)) + F.col("_two") + F.coalesce(F.lead("_three").over(by_user), F.lit(0))).alias("n_types"))
    near = W.partitionBy("user_id").orderBy("_group").rangeBetween(-1, 1)
    n_near, n_peers = F.count("*").over(near), F.count("*").over(W.partitionBy("user_id", "_group"))
    counted = events.select("event_id", "user_id", "_group", n_near.alias("n_near"), (n_near - 1).alias("n_others"), (n_near - n_peers).alias("n_no_group"), (n_near - n_peers + 1).alias("n_no_ties"))
    distinct = distinct.toDF("_user", "_day", "n_types")
    return counted.join(distinct, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_group") == F.col("_day"))).drop("user_id", "_group", "_user", "_day")


QUERIES = {f.__name__: f for f in (ranks, qualified, frames_rewritten)}
ORACLES = {
    "ranks": """
        SELECT p_partkey, rank() OVER own AS rank, dense_rank() OVER own AS dense, round(percent_rank() OVER own, 9) AS share, round(cume_dist() OVER own, 9) AS upto,
               ntile(4) OVER settled AS quarter, lead(p_partkey, 2) OVER settled AS two_on,
               nth_value(p_partkey, 3) OVER (settled ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third
        FROM part WINDOW own AS (PARTITION BY p_brand ORDER BY p_size), settled AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)""",
    "qualified": """
        SELECT o_orderkey, o_custkey FROM orders
        QUALIFY o_totalprice > avg(o_totalprice) OVER (PARTITION BY o_custkey) AND row_number() OVER (PARTITION BY o_orderdate ORDER BY o_totalprice DESC, o_orderkey) = 1""",
    "frames_rewritten": """
        SELECT event_id, count(*) OVER near AS n_near, count(*) OVER (PARTITION BY user_id ORDER BY ts::DATE GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS n_others,
               count(*) OVER (PARTITION BY user_id ORDER BY ts::DATE GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS n_no_group,
               count(*) OVER (PARTITION BY user_id ORDER BY ts::DATE GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS n_no_ties,
               count(DISTINCT event_type) OVER near AS n_types
        FROM events WINDOW near AS (PARTITION BY user_id ORDER BY ts::DATE GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
}
