"""Further scalar, collection and aggregate functions, a few of a kind in one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakeloom.sources.tables import table


@F.udf(StringType())
def initials(name):
    """A plain Python function, a row at a time: the first character of each word."""
    return None if name is None else "".join(word[0] for word in name.split())


def text_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats, patterns, addresses, zones and intervals."""
    return spark.sql(
        r"""SELECT o_orderkey, to_number(to_char(cast(o_totalprice AS decimal(12, 2)), '999999999.99'), '999999999.99') AS price,
               array_join(regexp_extract_all(o_orderpriority, '([A-Z])[A-Z]*', 1), '') AS heads, split_part(o_orderpriority, '-', -1) AS kind,
               parse_url(concat('http://h.example/p?k=', o_orderkey), 'QUERY', 'k') AS k, translate(o_orderpriority, 'AEIOU', 'aeiou') AS vowels,
               convert_timezone('UTC', 'Asia/Tokyo', o_orderdate) AS tokyo, try_to_timestamp(o_orderpriority) IS NULL AS no_time,
               cast(floor(months_between(o_orderdate, timestamp_ntz'1990-01-01 00:00:00')) AS bigint) AS months, o_orderdate + make_interval(0, 1, 0, 2) AS later,
               cast(last_day(o_orderdate) AS date) AS month_end, levenshtein(o_orderpriority, '5-LOW') AS away
           FROM {orders}""",
        orders=table(spark, sf_dir, "orders"),
    ).withColumn("price", F.col("price").cast("double"))


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, encryption that comes back, valid UTF-8, and a plain Python function."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", initials("c_name").alias("initials"))
    return rows.selectExpr(
        "c_custkey", "initials", "sha2(c_name, 256) AS sha", "md5(c_name) AS md", "cast(try_aes_decrypt(aes_encrypt(c_name, '0123456789abcdef', 'GCM'), '0123456789abcdef', 'GCM') AS string) = c_name AS back",
        "is_valid_utf8(c_name) AS valid", "octet_length(make_valid_utf8(cast(concat(cast(c_name AS binary), X'FF') AS string))) - octet_length(c_name) AS mended",
    )


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps and arrays element by element, rows from text formats, and generators."""
    return spark.sql(
        """WITH n AS (SELECT n_nationkey, coalesce(n_name, '') AS n_name, array(n_nationkey, coalesce(n_regionkey, 0), n_nationkey + coalesce(n_regionkey, 0)) AS a FROM {nation}),
               m AS (SELECT *, map_from_arrays(array('x', 'y', 'z'), a) AS m FROM n),
               t AS (SELECT n_nationkey, k, v FROM m LATERAL VIEW stack(2, 'odd', size(map_filter(m, (k, v) -> v % 2 = 1)), 'sum', aggregate(map_values(transform_values(m, (k, v) -> v * 2)), 0, (s, x) -> cast(s + x AS int))) s AS k, v),
               i AS (SELECT n_nationkey, concat('z', c1) AS k, c2 AS v FROM m LATERAL VIEW inline(zip_with(a, sequence(1, 3), (x, y) -> named_struct('p', y, 'q', cast(x * y AS int)))) s AS c1, c2),
               c AS (SELECT n_nationkey, 'csv' AS k, from_csv(concat(n_nationkey, ',', n_name), 'a int, b string').a AS v FROM m),
               x AS (SELECT n_nationkey, 'xml' AS k, from_xml(concat('<r><a>', n_nationkey, '</a></r>'), 'a int').a AS v FROM m),
               j AS (SELECT n_nationkey, 'json' AS k, cast(c0 AS int) AS v FROM m LATERAL VIEW json_tuple(to_json(m), 'z') s AS c0),
               e AS (SELECT n_nationkey, concat('key', k) AS k, v FROM m LATERAL VIEW explode(transform_keys(m, (k, v) -> upper(k))) s AS k, v)
           SELECT n_nationkey, k, cast(v AS bigint) AS v FROM (TABLE t UNION ALL TABLE i UNION ALL TABLE c UNION ALL TABLE x UNION ALL TABLE j UNION ALL TABLE e)""",
        nation=table(spark, sf_dir, "nation"),
    )


def more_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode (ties by the least), bits, the fit of a regression."""
    return spark.sql(
        """SELECT l_returnflag, mode() WITHIN GROUP (ORDER BY l_linenumber) AS usual, cast(bit_and(l_suppkey) AS bigint) AS all_bits, cast(bit_or(l_suppkey) AS bigint) AS any_bits,
               round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_intercept(l_extendedprice, l_quantity), 3) AS base, bool_or(l_tax > 0.07) AS taxed, count_if(l_tax > 0.07) AS n_taxed
           FROM {lines} GROUP BY l_returnflag""",
        lines=table(spark, sf_dir, "lineitem"),
    ).withColumn("usual", F.col("usual").cast("bigint"))


QUERIES = {f.__name__: f for f in (text_and_time, digests, collections, more_aggregates)}
ORACLES = {
    "text_and_time": r"""
        SELECT o_orderkey, o_totalprice::DECIMAL(12, 2)::DOUBLE AS price, list_aggregate(regexp_extract_all(o_orderpriority, '([A-Z])[A-Z]*', 1), 'string_agg', '') AS heads, split_part(o_orderpriority, '-', -1) AS kind,
               o_orderkey::VARCHAR AS k, translate(o_orderpriority, 'AEIOU', 'aeiou') AS vowels, o_orderdate + INTERVAL 9 HOUR AS tokyo, true AS no_time,
               date_sub('month', TIMESTAMP '1990-01-01', o_orderdate) AS months, o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS later,
               last_day(o_orderdate) AS month_end, levenshtein(o_orderpriority, '5-LOW')::INT AS away FROM orders""",
    "digests": """
        SELECT c_custkey, array_to_string(list_transform(string_split_regex(trim(c_name), '\\s+'), lambda w: w[1]), '') AS initials, sha256(c_name) AS sha, md5(c_name) AS md, c_name = c_name AS back, c_name = c_name AS valid, CASE WHEN c_name IS NOT NULL THEN 3 END AS mended FROM customer""",
    "collections": """
        WITH n AS (SELECT n_nationkey AS n, coalesce(n_regionkey, 0) AS r FROM nation)
        SELECT n AS n_nationkey, k, v::BIGINT AS v FROM (
            SELECT n, 'odd' AS k, n % 2 + r % 2 + (n + r) % 2 AS v FROM n UNION ALL SELECT n, 'sum', 4 * (n + r) FROM n
            UNION ALL SELECT n, 'z1', n FROM n UNION ALL SELECT n, 'z2', 2 * r FROM n UNION ALL SELECT n, 'z3', 3 * (n + r) FROM n
            UNION ALL SELECT n, unnest(['csv', 'xml']), n FROM n UNION ALL SELECT n, 'json', n + r FROM n
            UNION ALL SELECT n, 'keyX', n FROM n UNION ALL SELECT n, 'keyY', r FROM n UNION ALL SELECT n, 'keyZ', n + r FROM n)""",
    "more_aggregates": """
        WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT l_returnflag, (SELECT min(l_linenumber) FROM c WHERE c.l_returnflag IS NOT DISTINCT FROM l.l_returnflag AND l_linenumber IS NOT NULL AND n = (SELECT max(n) FROM c d WHERE d.l_returnflag IS NOT DISTINCT FROM l.l_returnflag AND l_linenumber IS NOT NULL))::BIGINT AS usual,
               bit_and(l_suppkey)::BIGINT AS all_bits, bit_or(l_suppkey)::BIGINT AS any_bits, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_intercept(l_extendedprice, l_quantity), 3) AS base,
               bool_or(l_tax > 0.07) AS taxed, count(*) FILTER (l_tax > 0.07) AS n_taxed FROM lineitem l GROUP BY l_returnflag""",
}
