"""Nested records whose shape drifts: every leaf a row, and the types that each path has had."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.scratch import Scratch, materialise


def leaves(rows: DataFrame, key: str, record: str) -> DataFrame:
    """key, path, place, type, value: a row for each leaf of a JSON text.

    ``path`` joins the names by dots, with ``[]`` for the elements of an array, whose
    places are in ``place``.  ``type``: the variant's own (numbers as BIGINT,
    DECIMAL or DOUBLE, BOOLEAN, STRING, null as VOID); an empty object or array is a leaf
    too.  ``value`` is the leaf as text, null for null.  A null text has no leaves, a text
    that is not JSON is one leaf of type INVALID.  A level of nesting is a join with the
    exploded containers of that level, and nothing but whether one is left reaches the driver.
    """
    with Scratch(rows.sparkSession):
        parsed = rows.where(F.col(record).isNotNull()).select(F.col(key).alias("key"), F.col(record).cast("string").alias("text"))
        parsed = parsed.withColumn("v", F.expr("try_parse_json(text)"))
        invalid = parsed.where("v IS NULL").select("key", F.lit("").alias("path"), F.array().cast("array<int>").alias("place"), F.lit("INVALID").alias("type"), F.col("text").alias("value"))
        level = parsed.where("v IS NOT NULL").select("key", F.lit("").alias("path"), F.array().cast("array<int>").alias("place"), "v")
        found = [invalid]
        while True:
            level = level.withColumn("type", F.regexp_extract(F.expr("schema_of_variant(v)"), r"^([A-Z]+)", 1))
            level = level.withColumn("open", F.expr("type IN ('OBJECT', 'ARRAY') AND to_json(v) NOT IN ('{}', '[]')"))
            # Variants are written as text: Parquet keeps them, but not every reader does.
            held = materialise(level.select("key", "path", "place", "type", "open", F.expr("to_json(v)").alias("json"), F.expr("CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'VOID') THEN variant_get(v, '$', 'string') WHEN type <> 'VOID' THEN to_json(v) END").alias("value")), "level", keep=True)
            found.append(held.where("NOT open").select("key", "path", "place", "type", "value"))
            containers = held.where("open")
            if containers.isEmpty():
                break
            containers.createOrReplaceTempView("lakeloom_containers")
            level = rows.sparkSession.sql(
                """SELECT c.key, CASE WHEN c.type = 'ARRAY' THEN concat(c.path, '[]') WHEN c.path = '' THEN e.key ELSE concat(c.path, '.', e.key) END AS path,
                       CASE WHEN c.type = 'ARRAY' THEN array_append(c.place, e.pos) ELSE c.place END AS place, e.value AS v
                   FROM lakeloom_containers c, LATERAL variant_explode(parse_json(c.json)) e"""
            )
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return materialise(out, "leaves", keep=True)


def merged_schema(found: DataFrame) -> DataFrame:
    """path, types, type, n: the types each path has had, and one that holds every value of it.

    Whole numbers and others merge to DOUBLE (DECIMAL without doubles), anything else to
    STRING; nulls say nothing of a type.
    """
    types = found.groupBy("path", "type").agg(F.count("*").alias("n")).groupBy("path").agg(F.array_sort(F.collect_list("type")).alias("types"), F.sum("n").alias("n"))
    known = F.array_except("types", F.array(F.lit("VOID")))
    inside = lambda *names: F.size(F.array_except(known, F.array(*map(F.lit, names)))) == 0
    kind = F.when(F.size(known) == 0, "VOID").when(F.size(known) == 1, known[0]).when(inside("BIGINT", "DECIMAL"), "DECIMAL").when(inside("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "DOUBLE").otherwise("STRING")
    return types.select("path", F.array_join("types", ",").alias("types"), kind.alias("type"), "n")
