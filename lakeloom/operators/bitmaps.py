"""Exact distinct counts of all levels of a roll-up from one pass, by bitmaps.

Distinct values do not add up, their bitmaps do: a value is a bit of one of many
buckets (32,768 values each), a state is a row a bucket, and states of finer groups are
merged by OR into those of coarser ones.  The rows are aggregated once, by the finest
groups; every other level reads these states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one bitmap, of which a group has as many as its values' range asks for.
BUCKET_VALUES = 32_768


def bitmap_states(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, bucket, bits: the values of each finest group; null values count nowhere.

    Values are whole numbers of any sign.  States are merged on any columns of ``by``
    with ``bitmap_or_agg``, and may be kept and merged with those of later rows.
    """
    v = F.col(value).cast("long")
    # The functions number buckets from 1 for positive values, from 0 on down for others.
    return rows.where(v.isNotNull()).groupBy(*by, F.bitmap_bucket_number(v).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits"))


def merged_states(states: list[DataFrame], by: list[str]) -> DataFrame:
    """One state of several, made of different rows."""
    together = states[0]
    for more in states[1:]:
        together = together.unionByName(more)
    return together.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(states: DataFrame, by: list[str], levels: list[list[str]]) -> DataFrame:
    """by, level, n_distinct: the exact count of each group of each level (its columns kept, the others null).

    ``level`` numbers as grouping_id does.  A level without columns is one group; if
    there are no states it has no row, as have all other levels.
    """
    sets = states.groupingSets([[*level, "bucket"] for level in levels], *by, "bucket")
    buckets = sets.agg(F.grouping_id().alias("level"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    # The bucket is in every set, so its bit of the id is the lowest and unset.
    return buckets.groupBy(*by, F.shiftright("level", 1).alias("level")).agg(F.sum("n").alias("n_distinct"))
