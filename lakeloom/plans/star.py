"""Joins, aggregations, windows and set operations over the star schema.

Sums are taken over decimals, so they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.timejoins import as_of_join, interval_join
from lakeloom.sources.tables import table

PRICE = "cast(l_extendedprice as decimal(12, 2))"
#: Lines of a task of ``star_revenue``, about.
TASK_ROWS = 500_000
NET = f"{PRICE} * (1 - cast(l_discount as decimal(4, 2)))"


def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tables; nations are broadcast by their size, all that grows meets by its keys in partitions of bounded rows.

    An order's lines stand in one partition after the last join, so distinct orders are
    counted there, group by group, and only the groups' sums are shuffled.
    """
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_ROWS))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    # Merged, not broadcast: customers and parts grow with the lines, and so would each task's copy of them.
    customers = t("customer").select("c_custkey", "c_nationkey").hint("merge")
    orders = t("orders").select("o_orderkey", "o_custkey").repartition(n, "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name", "r_name")
    parts = t("part").where("p_size <= 25").select("p_partkey", "p_type").hint("merge")
    sold = lines.repartition(n, "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type", "l_extendedprice", "l_discount")
    joined = sold.repartition(n, "l_orderkey").join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    by_order = joined.groupBy("r_name", "n_name", "p_type", "o_orderkey").agg(F.expr(f"sum({NET})").alias("net"))
    return by_order.groupBy("r_name", "n_name", "p_type").agg(F.expr("cast(sum(net) as double)").alias("revenue"), F.count("o_orderkey").alias("n_orders"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of each customer; the limit is applied before the shuffle."""
    own = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(own)).where("place <= 3")
    return rows.select("o_custkey", "o_orderkey", "o_totalprice", F.col("place").cast("long").alias("place"))


def without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join: orders without line items."""
    lines = table(spark, sf_dir, "lineitem")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


def returning_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join: customers who have an urgent order that is still open."""
    urgent = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def matched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of two aggregates."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers")).where("n_customers % 2 = 0")
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nation", "full_outer")


def below_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated average: lines under a fifth of their part's mean quantity."""
    return spark.sql(
        "SELECT l_partkey, count(*) AS n, cast(sum(l_quantity) as double) AS quantity FROM {lines} a"
        " WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM {lines} b WHERE a.l_partkey = b.l_partkey) GROUP BY l_partkey",
        lines=table(spark, sf_dir, "lineitem"),
    )


def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup with its level."""
    return (
        table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.expr(f"cast(sum({PRICE}) as double)").alias("price"), F.count("*").alias("n"))
    )


def cubed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


def several_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several distinct counts, each from its own distinct pairs: together in one aggregate they would copy every row for each of them."""
    lines = table(spark, sf_dir, "lineitem")
    distinct = lambda c, name: lines.select("l_returnflag", c).distinct().groupBy("l_returnflag").agg(F.count(c).alias(name))
    rest = lines.groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("n_cheap"), F.max(F.when(F.col("l_linenumber").isNotNull(), F.col("l_extendedprice"))).alias("_dearest"))
    top = F.broadcast(rest.select(F.col("l_returnflag").alias("_flag"), "_dearest"))  # a row a flag
    dearest = lines.join(top, F.col("l_returnflag").eqNullSafe(F.col("_flag")) & (F.col("l_extendedprice") == F.col("_dearest")))
    line = dearest.groupBy("l_returnflag").agg(F.max("l_linenumber").cast("long").alias("line_of_dearest"))
    out = rest.drop("_dearest")
    for own in (distinct("l_partkey", "parts"), distinct("l_suppkey", "suppliers"), line):
        own = own.withColumnRenamed("l_returnflag", "_flag")
        out = out.join(own, F.col("l_returnflag").eqNullSafe(F.col("_flag")), "left").drop("_flag")  # a null flag is a group
    return out


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by rows and by a time interval, lag and rank."""
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumn("v", F.col("value").cast("decimal(12, 4)"))
    events = events.withColumns({"total": F.sum("v").over(own.rowsBetween(W.unboundedPreceding, 0)).cast("double"), "gap_us": (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(own).cast("timestamp"))).cast("long")})
    return spark.sql("SELECT event_id, total, gap_us, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_day FROM {events}", events=events)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour session windows per user."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("began"), "n")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersect, except and union all of keys."""
    orders, lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    low = orders.where("k % 3 = 0")
    marked = lambda df, name: df.withColumn("kind", F.lit(name))
    return marked(low.intersect(lines), "both").unionByName(marked(orders.exceptAll(low), "high")).unionByName(marked(low.union(low), "twice")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("s"))


def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "purchase"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id")).fillna(0, kinds)


def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "cast(s_nationkey as double) AS nation", "s_acctbal AS balance").unpivot("s_suppkey", ["nation", "balance"], "field", "amount")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed access into JSON text, then an ordered list a group."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    return rows


def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: each purchase with the user's last view at or before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view"))
    return as_of_join(bought, viewed, "user_id", "ts", ["view"]).select("event_id", "last_view")


def clicks_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: clicks of the same user within six hours before an error."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("at"))
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("clicked"))
    return interval_join(errors, clicks, ["user_id"], "at", "clicked", 6 * 3600).select("error_id", "click_id")


QUERIES = {
    f.__name__: f
    for f in (
        star_revenue, top_orders, without_lines, returning_customers, matched_keys, below_average, rolled_up, cubed, several_distinct, running_totals,
        sessions, set_operations, pivoted, unpivoted, json_fields, last_view, clicks_before,
    )
}
ORACLES = {
    "star_revenue": f"""
        SELECT r_name, n_name, p_type, sum({NET})::DOUBLE AS revenue, count(DISTINCT o_orderkey) AS n_orders
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY ALL""",
    "top_orders": """
        SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place
        FROM orders QUALIFY place <= 3""",
    "without_lines": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "returning_customers": """
        SELECT c_custkey, c_mktsegment FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')""",
    "matched_keys": """
        SELECT nation, n_customers, n_suppliers
        FROM (SELECT c_nationkey AS nation, count(*) AS n_customers FROM customer GROUP BY ALL HAVING count(*) % 2 = 0)
        FULL JOIN (SELECT s_nationkey AS nation, count(*) AS n_suppliers FROM supplier GROUP BY ALL) USING (nation)""",
    "below_average": """
        SELECT l_partkey, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity
        FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_partkey) AS mean FROM lineitem) WHERE l_quantity < 0.2 * mean GROUP BY ALL""",
    "rolled_up": f"""
        SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, sum({PRICE})::DOUBLE AS price, count(*) AS n
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "cubed": """
        SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "several_distinct": """
        SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, (count(*) FILTER (l_discount > 0.05))::BIGINT AS n_cheap,
               max_by(l_linenumber, (l_extendedprice, l_linenumber)) FILTER (l_extendedprice IS NOT NULL)::BIGINT AS line_of_dearest FROM lineitem GROUP BY ALL""",
    "running_totals": """
        SELECT event_id, (sum(value::DECIMAL(12, 4)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS total,
               epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us,
               count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_day FROM events""",
    "sessions": """
        SELECT user_id, min(ts) AS began, count(*) AS n
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
              FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
        GROUP BY user_id, s""",
    "set_operations": """
        WITH low AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0)
        SELECT kind, count(*) AS n, sum(k)::BIGINT AS s FROM (
            SELECT k, 'both' AS kind FROM (SELECT k FROM low INTERSECT SELECT l_orderkey FROM lineitem)
            UNION ALL SELECT o_orderkey, 'high' FROM orders WHERE o_orderkey % 3 <> 0
            UNION ALL SELECT k, 'twice' FROM (SELECT k FROM low UNION ALL SELECT k FROM low)) GROUP BY kind""",
    "pivoted": """
        SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view",
               count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY ALL""",
    "unpivoted": """
        SELECT s_suppkey, 'nation' AS field, s_nationkey::DOUBLE AS amount FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier""",
    "json_fields": """
        SELECT (props::JSON ->> '$.k')::BIGINT AS k, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY ALL""",
    "last_view": """
        SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "clicks_before": """
        SELECT e.event_id AS error_id, c.event_id AS click_id FROM events e JOIN events c ON e.user_id = c.user_id
        WHERE e.event_type = 'error' AND c.event_type = 'click' AND c.ts <= e.ts AND c.ts >= e.ts - INTERVAL 6 HOUR""",
}
