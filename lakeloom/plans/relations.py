"""Joins beyond equality, subqueries in FROM, recursion, ordering and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.timejoins import range_join
from lakeloom.sources.tables import table


def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta join: parts in the band of sizes of each size class; the classes are a literal table."""
    bands = spark.createDataFrame([("small", 1, 10), ("middle", 8, 30), ("large", 25, 50)], "band string, low int, high int")
    parts = range_join(table(spark, sf_dir, "part"), bands, "p_size", "low", "high")
    return parts.groupBy("band").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("s"))


def outer_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join with a condition beside the key, and a left outer one by USING."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    both = customers.join(suppliers, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_acctbal") < F.col("s_acctbal")), "full_outer")
    counted = both.groupBy(F.coalesce("c_nationkey", "s_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("with_customer"), F.count("s_suppkey").alias("with_supplier"), F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(counted, "n_nationkey", "left_outer")


def hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffled hash join by hint, its smaller side built."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").hint("shuffle_hash")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


def lateral_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LATERAL: the two dearest orders of each customer of one segment; null rows by LEFT JOIN."""
    return spark.sql(
        """SELECT c_custkey, o_orderkey, o_totalprice FROM {customer} c LEFT JOIN LATERAL
               (SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) ON true
           WHERE c_mktsegment = 'BUILDING'""",
        customer=table(spark, sf_dir, "customer"), orders=table(spark, sf_dir, "orders"),
    )


def recursive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive CTE: a calendar of months, with the orders of each."""
    return spark.sql(
        """WITH RECURSIVE ends AS (SELECT cast(trunc(min(o_orderdate), 'MM') AS date) AS low, cast(trunc(max(o_orderdate), 'MM') AS date) AS high FROM {orders}),
               months(m, high) AS (SELECT low, high FROM ends UNION ALL SELECT cast(add_months(m, 1) AS date), high FROM months WHERE m < high)
           SELECT m, count(o_orderkey) AS n FROM months LEFT JOIN {orders} ON cast(trunc(o_orderdate, 'MM') AS date) = m GROUP BY m""",
        orders=table(spark, sf_dir, "orders"),
    )


def shorthand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe syntax, lateral aliases and all columns but some."""
    return spark.sql(
        """FROM {lines} |> WHERE l_quantity BETWEEN least(40, 20) AND greatest(40, 20)
           |> SELECT * EXCEPT (l_shipdate, l_tax, l_linestatus, l_linenumber, l_suppkey, l_partkey)
           |> SELECT l_orderkey, l_returnflag, cast(l_quantity * 2 AS double) AS twice, twice + 1 AS more
           |> AGGREGATE count(*) AS n, sum(more) AS total GROUP BY l_returnflag""",
        lines=table(spark, sf_dir, "lineitem"),
    )


def ordered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORDER BY with limit and offset; only the first rows of each task travel."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").offset(10).limit(25)


def set_alls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INTERSECT ALL and EXCEPT ALL keep multiplicities; NOT IN with a null keeps nothing."""
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).where("k % 2 = 0")
    with_null = b.unionByName(spark.createDataFrame([(None,)], "k long"))
    nothing = spark.sql("SELECT k FROM {a} WHERE k NOT IN (SELECT k FROM {b})", a=a, b=with_null)
    parts = [("both", a.intersectAll(b.unionByName(b))), ("rest", a.exceptAll(b)), ("none", nothing)]
    counted = [df.agg(F.count("*").alias("n"), F.sum("k").alias("s")).withColumn("kind", F.lit(kind)) for kind, df in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


QUERIES = {f.__name__: f for f in (price_bands, outer_conditions, hinted, lateral_latest, recursive_days, shorthand, ordered_page, set_alls)}
ORACLES = {
    "price_bands": """
        SELECT band, count(*) AS n, sum(p_partkey)::BIGINT AS s FROM part JOIN (VALUES ('small', 1, 10), ('middle', 8, 30), ('large', 25, 50)) b(band, low, high)
        ON p_size BETWEEN low AND high GROUP BY ALL""",
    "outer_conditions": """
        SELECT n_nationkey, n_name, with_customer, with_supplier, n FROM nation LEFT JOIN (
            SELECT coalesce(c_nationkey, s_nationkey) AS n_nationkey, count(c_custkey) AS with_customer, count(s_suppkey) AS with_supplier, count(*) AS n
            FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal GROUP BY 1) USING (n_nationkey)""",
    "hinted": """
        SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderpriority = '1-URGENT' GROUP BY ALL""",
    "lateral_latest": """
        SELECT c_custkey, o_orderkey, o_totalprice FROM customer c LEFT JOIN (
            SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2) o ON o_custkey = c_custkey
        WHERE c_mktsegment = 'BUILDING'""",
    "recursive_days": """
        SELECT m::DATE AS m, count(o_orderkey) AS n FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH))::DATE AS m)
        LEFT JOIN orders ON date_trunc('month', o_orderdate)::DATE = m GROUP BY ALL""",
    "shorthand": "SELECT l_returnflag, count(*) AS n, sum(l_quantity * 2 + 1)::DOUBLE AS total FROM lineitem WHERE l_quantity BETWEEN 20 AND 40 GROUP BY ALL",
    "ordered_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
    "set_alls": """
        WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
        SELECT 'both' AS kind, count(*) AS n, sum(k)::BIGINT AS s FROM (SELECT k FROM a INTERSECT ALL SELECT k FROM (SELECT k FROM b UNION ALL SELECT k FROM b))
        UNION ALL SELECT 'rest', count(*), sum(k)::BIGINT FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)
        UNION ALL SELECT 'none', 0, NULL""",
}
