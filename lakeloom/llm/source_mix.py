"""Mixing sources to target weights by capped water-filling (DataFrame functions).

Targets share a total by weight; a source whose share exceeds its cap (maximum
epochs times its size) is clamped and the excess is reshared by weight among the
rest until none is above.  A source's documents then repeat ``floor(target /
size)`` whole times, and a seeded order of its documents takes one more
repetition each until the rest is filled; the last one takes a fraction of its
words, so a source meets its target to the word.

The seeded order is found without gathering a source: documents fall into 4096
hash buckets, prefix sums over a source's buckets find the bucket in which the
rest runs out, and only that bucket's documents are put in order.

Cases: a null text has size 0; a null source is a source, the last in order;
sources without words have target 0; equal rows are interchangeable; an empty
table gives no rows.  A document's rows beyond its size are never taken more
often than the maximum epochs rounded up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import SPACE, Scratch, materialise, pick, smallest_rank_base

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
WORD = rf"[^{SPACE}]+"


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def weights_by_rank(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight: weights repeat over the sources in code point order, null last."""
    ranked = smallest_rank_base(sources, "source")
    turn = (F.col("rank") % len(weights)).cast("int")
    return ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).alias("weight"))


def water_fill(weighted: DataFrame, total: float, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight).

    A source is clamped when the level (share of a unit of weight) lifts it above
    its cap.  Resharing only lifts the level, so the level alone is the state
    between rounds: one aggregated row a round reaches the driver.
    """
    cap = max_epochs * F.col("source_size")
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) > cap if level else F.lit(False)
        clamped, free = weighted.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if not free:
            return weighted.withColumn("target", cap.cast("double"))
        if (lifted := (total - clamped) / free) == level:
            return weighted.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))
        level = lifted


def mix(docs: DataFrame, seed: str = SEED, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, ``whole`` repetitions,
    ``part`` words of one more, ``taken`` words in all, and the ``keep`` columns."""
    rows = pick(docs, *dict.fromkeys(("doc_id", "source", "text", *keep)))
    rows = rows.select("doc_id", F.col("source").cast("string").alias("source"), words_in("text").alias("size"), *keep)
    rows = rows.withColumn("_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = rows.withColumn("_bucket", F.substring("_order", 1, 3))
    with Scratch(docs.sparkSession):
        sums = materialise(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_n")), "mix")
        sizes = materialise(sums.groupBy("source").agg(F.sum("_n").alias("source_size")), "mix-sources")
        weighted = materialise(weights_by_rank(sizes, weights), "mix-weights")
        total = weighted.agg(F.sum("source_size")).first()[0] or 0
        plan = water_fill(weighted, total_share * total, max_epochs)
        plan = plan.withColumn("whole", F.coalesce(F.expr("cast(floor(try_divide(target, source_size)) as long)"), F.lit(0).cast("long")))
        plan = plan.withColumn("_rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
        before = F.sum("_n").over(W.partitionBy("source").orderBy("_bucket")) - F.col("_n")
        last = (
            sums.withColumn("_before", before)
            .join(plan.select(F.col("source").alias("_source"), "_rest"), F.col("source").eqNullSafe(F.col("_source")))
            .where("_before < _rest AND _before + _n >= _rest")
            .select(F.col("source").alias("_s"), F.col("_bucket").alias("_last"), (F.col("_rest") - F.col("_before")).alias("_left"))
        )
        plan = materialise(plan.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_source"), "mix-plan", keep=True)
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    at_last = F.coalesce(F.col("_bucket") == F.col("_last"), F.lit(False))
    outside = placed.where(~at_last).withColumn("part", F.when(F.col("_bucket") < F.col("_last"), F.col("size")).otherwise(F.lit(0).cast("long")))
    own = F.sum("size").over(W.partitionBy("source").orderBy("_order", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    inside = placed.where(at_last).withColumn("part", F.least(F.col("size"), F.greatest(F.col("_left") - own, F.lit(0).cast("long"))))
    out = outside.unionByName(inside).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", "part", "taken", *keep)


def mixed_documents(docs: DataFrame, columns: tuple[str, ...] = ("text", "lang"), **options) -> DataFrame:
    """The mixed corpus: a row for each repetition, the fractional one cut after its words."""
    rows = mix(docs, keep=columns, **options)
    times = rows.withColumn("_words", F.explode(F.expr("concat(array_repeat(-1L, cast(whole as int)), CASE WHEN part = 0 THEN array() WHEN part = size THEN array(-1L) ELSE array(part) END)")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[{SPACE}]*[^{SPACE}]+"), 0), 1, F.col("_words").cast("int")), "")
    return times.withColumn("text", F.when(F.col("_words") < 0, F.col("text")).otherwise(F.expr("NULL") if "text" not in columns else cut))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("whole", "part")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents: repeated rows for repeated documents."""
    return mixed_documents(docs).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sql(docs: str) -> str:
    """DuckDB SQL of the mix: one row a document with its shares."""
    return rf"""
    WITH sized AS (SELECT row_number() OVER () AS rid, doc_id, source, text, lang, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))::BIGINT AS size,
                      md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS o FROM {docs}),
    src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    wt AS (SELECT *, {MAX_EPOCHS} * source_size AS cap, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight FROM src),
    ranked AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k,
                   coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                   sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM wt),
    level AS (SELECT (({TOTAL_SHARE} * (SELECT sum(source_size) FROM src))::DOUBLE - below::DOUBLE) / above::DOUBLE AS x FROM ranked
              WHERE (({TOTAL_SHARE} * (SELECT sum(source_size) FROM src))::DOUBLE - below::DOUBLE) / above::DOUBLE * weight <= cap ORDER BY k LIMIT 1),
    planned AS (SELECT source, source_size, least(cap::DOUBLE, weight::DOUBLE * (SELECT x FROM level)) AS target FROM wt),
    whole AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole FROM planned),
    rest AS (SELECT *, round(target - whole * source_size)::BIGINT AS rest FROM whole),
    filled AS (SELECT s.*, r.source_size, r.target, r.whole, least(s.size, greatest(r.rest - (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.size, s.rid ROWS UNBOUNDED PRECEDING) - s.size), 0))::BIGINT AS part
               FROM sized s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, source, text, lang, size, source_size, target, whole, part, whole * size + part AS taken FROM filled"""


ORACLE = f"SELECT doc_id, source, size, source_size, target, taken FROM ({mix_sql('documents')})"
