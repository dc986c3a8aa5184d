"""Updates of rows, keys under a collation, and records of drifting shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.drifting import leaves, merged_schema
from lakeloom.scratch import scratch_path
from lakeloom.sources.filetable import FileTable
from lakeloom.sources.tables import table


def row_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files by key: some updated, some deleted, some appended; only files that hold such rows are written anew."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    held = FileTable(spark, scratch_path(spark, "orders"))
    held.create(orders.repartitionByRange(16, "o_orderkey"))
    held.update((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000), {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") * 2})
    held.delete(F.col("o_custkey") % 7 == 0)
    held.append(orders.where("o_custkey % 7 = 0 AND o_orderstatus = 'O'").withColumn("o_orderstatus", F.lit("N")))
    return held.read()


def collated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last words of texts, joined and grouped without regard to case."""
    words = table(spark, sf_dir, "documents").selectExpr("doc_id", r"regexp_extract(text, '^\\s*(\\p{L}+)', 1) AS first", r"regexp_extract(text, '(\\p{L}+)\\P{L}*$', 1) AS last")
    folded = lambda c: F.expr(f"nullif({c}, '') COLLATE UNICODE_CI")
    first = words.groupBy(folded("first").alias("word")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    last = words.where("last <> ''").groupBy(folded("last").alias("word")).agg(F.count("*").alias("n_last"))
    return first.join(last, "word", "left").select(F.lower(F.col("word").cast("string")).alias("word"), "n", "least", F.coalesce("n_last", F.lit(0)).alias("n_last")).select("n", "least", "n_last")


def drifting_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON of four shapes: the leaves by path, with the types each has had and the sum of their lengths as text."""
    shape = """CASE o_orderkey % 4
        WHEN 0 THEN to_json(named_struct('id', o_orderkey, 'who', named_struct('key', o_custkey, 'tags', array(o_orderstatus, o_orderpriority))))
        WHEN 1 THEN to_json(named_struct('id', cast(o_orderkey AS string), 'who', o_custkey))
        WHEN 2 THEN to_json(named_struct('id', o_orderkey, 'who', named_struct('key', cast(o_custkey AS string), 'tags', array(named_struct('t', o_orderstatus)))))
        ELSE '{"id": null, "who": []}' END"""
    orders = table(spark, sf_dir, "orders").fillna({"o_custkey": -1, "o_orderstatus": "?", "o_orderpriority": "?"})  # nulls would leave no leaf
    found = leaves(orders.select("o_orderkey", F.expr(shape).alias("record")), "o_orderkey", "record")
    length = found.groupBy("path").agg(F.sum(F.length("value")).alias("chars"))
    return merged_schema(found).join(length, "path")


QUERIES = {f.__name__: f for f in (row_updates, collated_keys, drifting_records)}
ORACLES = {
    "row_updates": """
        WITH u AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
            CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE coalesce(o_custkey % 7 <> 0, true))
        SELECT * FROM u UNION ALL SELECT o_orderkey, o_custkey, 'N', o_totalprice FROM orders WHERE o_custkey % 7 = 0 AND o_orderstatus = 'O'""",
    "collated_keys": r"""
        WITH w AS (SELECT doc_id, lower(nullif(regexp_extract(text, '^\s*(\p{L}+)', 1), '')) AS first, lower(nullif(regexp_extract(text, '(\p{L}+)\P{L}*$', 1), '')) AS last FROM documents),
        f AS (SELECT first, count(*) AS n, min(doc_id) AS least FROM w GROUP BY ALL), l AS (SELECT last, count(*) AS n_last FROM w WHERE last IS NOT NULL GROUP BY ALL)
        SELECT n, least, coalesce(n_last, 0) AS n_last FROM f LEFT JOIN l ON first = last""",
    "drifting_records": """
        WITH o AS (SELECT o_orderkey::VARCHAR AS id, coalesce(o_custkey, -1)::VARCHAR AS c, coalesce(o_orderstatus, '?') AS s, coalesce(o_orderpriority, '?') AS p, o_orderkey % 4 AS k FROM orders),
        e AS (SELECT 'id' AS path, CASE k WHEN 1 THEN 'STRING' WHEN 3 THEN 'VOID' ELSE 'BIGINT' END AS type, CASE WHEN k <> 3 THEN id END AS value FROM o
            UNION ALL SELECT 'who.key', CASE k WHEN 0 THEN 'BIGINT' ELSE 'STRING' END, c FROM o WHERE k IN (0, 2)
            UNION ALL SELECT 'who', CASE k WHEN 1 THEN 'BIGINT' ELSE 'ARRAY' END, CASE k WHEN 1 THEN c ELSE '[]' END FROM o WHERE k IN (1, 3)
            UNION ALL SELECT 'who.tags[]', 'STRING', unnest([s, p]) FROM o WHERE k = 0
            UNION ALL SELECT 'who.tags[].t', 'STRING', s FROM o WHERE k = 2)
        SELECT path, string_agg(DISTINCT type, ',' ORDER BY type) AS types, CASE WHEN count(DISTINCT type) FILTER (type <> 'VOID') > 1 THEN 'STRING' ELSE max(type) FILTER (type <> 'VOID') END AS type,
               count(*) AS n, sum(length(value))::BIGINT AS chars FROM e GROUP BY path""",
}
