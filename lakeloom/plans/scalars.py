"""Scalar functions over text, dates, numbers, arrays, maps and semi-structured values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.sources.tables import table


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "split_part(url, '/', 3) AS host", "regexp_extract(url, '/([a-z]{2})/', 1) AS lang", "cast(levenshtein(split_part(url, '/', 3), 'www.example.com') AS bigint) AS far",
        "translate(url, 'aeiou', '12345') AS vowels", "lpad(cast(page_id AS string), 6, '0') AS padded", "cast(length(url) AS bigint) AS n", "overlay(url PLACING '##' FROM 1 FOR 4) AS covered",
        "regexp_replace(url, '[0-9]+', '#') AS masked", "concat_ws('|', reverse(split_part(url, '/', 3)), upper(substr(url, 1, 4))) AS joined", "md5(url) AS md5", "cast(instr(url, 'example') AS bigint) AS place",
    )


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(date_trunc('quarter', o_orderdate) AS timestamp_ntz) AS quarter", "cast(add_months(o_orderdate, 1) AS date) AS later", "last_day(o_orderdate) AS ends",
        "cast(dayofweek(o_orderdate) AS bigint) AS day", "cast(weekofyear(o_orderdate) AS bigint) AS week", "cast(datediff(DATE '2002-01-01', o_orderdate) AS bigint) AS days",
        "date_format(o_orderdate, 'yyyy/MM/dd') AS written", "cast(extract(YEAR FROM o_orderdate) AS bigint) AS year", "cast(timestampdiff(MONTH, TIMESTAMP_NTZ '1995-01-01', o_orderdate) AS bigint) AS months",
    )


def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding, remainders and bits; what would raise gives null, and nulls are filled."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "round(s_acctbal, 1) AS near", "floor(s_acctbal) AS low", "pmod(s_suppkey, 7) AS left_over", "s_suppkey div 3 AS thirds", "cast(bit_count(s_suppkey) AS bigint) AS bits",
        "try_divide(s_acctbal, s_nationkey) AS share", "try_cast(s_name AS int) AS number", "coalesce(try_divide(1, s_nationkey), -1.0D) AS filled", "nullif(s_nationkey, 3) AS but_three",
        "cast(width_bucket(s_acctbal, 0, 10000, 10) AS bigint) AS tenth", "greatest(s_acctbal, 0D) AS paid", "round(ln(1 + s_suppkey), 9) AS log", "equal_null(nullif(s_nationkey, 3), NULL) AS is_three",
    )


def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Higher-order functions over arrays and maps, folded to plain columns."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg({"o_orderkey": "collect_list"}).toDF("o_custkey", "keys")
    return rows.selectExpr(
        "o_custkey", "array_join(transform(filter(array_sort(keys), k -> k % 2 = 0), k -> cast(k * 10 AS string)), ',') AS even", "aggregate(keys, 0L, (s, k) -> s + k) AS total",
        "exists(keys, k -> k % 97 = 0) AS any_97", "forall(keys, k -> k >= 0) AS all_positive", "array_join(slice(array_sort(keys), 1, 3), ',') AS first_three",
        "cast(size(array_distinct(transform(keys, k -> k % 5))) AS bigint) AS fifths", "element_at(map_from_arrays(array('low', 'high'), array(array_min(keys), array_max(keys))), 'high') AS high",
        "array_join(array_union(array(1L, 2L), array_intersect(array(2L, 3L), array(3L))), '-') AS fixed",
    )


def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant, typed JSON with a schema, and generated rows."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "variant_get(parse_json(props), '$.k', 'bigint') AS k", "from_json(props, 'k BIGINT, missing STRING') AS typed", "explode(sequence(1, 1 + cast(event_id % 3 AS int))) AS turn")
    return rows.selectExpr("event_id", "cast(turn AS bigint) AS turn", "k", "typed.k AS same", "typed.missing IS NULL AS absent", "to_json(struct(k, turn)) AS written")


QUERIES = {f.__name__: f for f in (text_functions, date_functions, number_functions, array_functions, nested_values)}
ORACLES = {
    "text_functions": """
        SELECT page_id, split_part(url, '/', 3) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, levenshtein(split_part(url, '/', 3), 'www.example.com') AS far,
               translate(url, 'aeiou', '12345') AS vowels, CASE WHEN length(page_id::VARCHAR) > 6 THEN left(page_id::VARCHAR, 6) ELSE lpad(page_id::VARCHAR, 6, '0') END AS padded, length(url) AS n,
               '##' || substr(url, 5) AS covered, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, reverse(split_part(url, '/', 3)) || '|' || upper(substr(url, 1, 4)) AS joined, md5(url) AS md5,
               instr(url, 'example') AS place FROM pages""",
    "date_functions": """
        SELECT o_orderkey, date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter, (o_orderdate + INTERVAL 1 MONTH)::DATE AS later, last_day(o_orderdate) AS ends, dayofweek(o_orderdate) + 1 AS day,
               weekofyear(o_orderdate) AS week, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS days, strftime(o_orderdate, '%Y/%m/%d') AS written, year(o_orderdate) AS year,
               date_sub('month', TIMESTAMP '1995-01-01', o_orderdate) AS months FROM orders""",
    "number_functions": """
        SELECT s_suppkey, round(s_acctbal, 1) AS near, floor(s_acctbal)::BIGINT AS low, ((s_suppkey % 7) + 7) % 7 AS left_over, s_suppkey // 3 AS thirds, bit_count(s_suppkey)::BIGINT AS bits,
               s_acctbal / nullif(s_nationkey, 0) AS share, try_cast(s_name AS INT) AS number, coalesce(1 / nullif(s_nationkey, 0), -1)::DOUBLE AS filled, nullif(s_nationkey, 3) AS but_three,
               (CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal >= 10000 THEN 11 ELSE floor(s_acctbal / 1000) + 1 END)::BIGINT AS tenth, greatest(s_acctbal, 0)::DOUBLE AS paid,
               round(ln(1 + s_suppkey), 9) AS log, s_nationkey = 3 AS is_three FROM supplier""",
    "array_functions": """
        WITH g AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY ALL)
        SELECT o_custkey, array_to_string([(k * 10)::VARCHAR FOR k IN keys IF k % 2 = 0], ',') AS even, list_sum(keys)::BIGINT AS total, list_bool_or([k % 97 = 0 FOR k IN keys]) AS any_97,
               true AS all_positive, array_to_string(keys[1:3], ',') AS first_three, len(list_distinct([k % 5 FOR k IN keys])) AS fifths, list_max(keys) AS high, '1-2-3' AS fixed FROM g""",
    "nested_values": """
        SELECT event_id, turn, k, k AS same, true AS absent, '{"k":' || k || ',"turn":' || turn || '}' AS written
        FROM (SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, unnest(range(1, 2 + event_id % 3)) AS turn FROM events)""",
}
