"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.scratch import Scratch, materialise, scratch_path, shared_dir

__all__ = ["Scratch", "materialise", "scratch_path", "shared_dir", "pick", "text_documents", "text_hash", "smallest_rank_base", "SPACE", "DOCUMENT_COLUMNS"]

#: ASCII white space as a Java/RE2 character class body.
SPACE = r"\x20\x09-\x0D"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name.

    Other columns may clash in case, or repeat a name (the first one counts); a
    missing column is null.  Spark's own resolution would call such names ambiguous.
    """
    have = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[(F.col(f"_c{have.index(n)}") if n in have else F.lit(None)).alias(n) for n in names])


def text_documents(docs: DataFrame, *names: str) -> DataFrame:
    """doc_id as long, text as string, then further columns."""
    out = pick(docs, "doc_id", "text", *names)
    return out.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})


def text_hash(text: Column) -> Column:
    """With doc_id, what tells a row from others: rows may have no doc_id, or repeat one with another text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def smallest_rank_base(df: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` (0-based, by ascending key, nulls last; keys are distinct).

    Range partitions are ranked one by one and shifted by prefix sums of the
    partitions' sizes, so no task holds all keys.
    """
    parts = df.repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last())
    # The id's high bits are the partition, its low 33 bits the row in it.
    held = materialise(parts.withColumn("_id", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("_id", 33)
    sizes = held.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # a row a partition
    base, bases = 0, []
    for r in sizes:
        bases.append((r["_part"], base))
        base += r["count"]
    base_of = df.sparkSession.createDataFrame(bases, "_part long, _base long")
    return (
        held.withColumn("_part", part)
        .join(F.broadcast(base_of), "_part")
        .withColumn("rank", F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1))
        .drop("_id", "_part", "_base")
    )
