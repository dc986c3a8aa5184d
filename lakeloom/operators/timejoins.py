"""As-of, interval and range joins by equi-joins, sorts and windows: never a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of one key's history that one task sorts in an as-of join.
AS_OF_BUCKET = 7 * 24 * 3600
#: Least and largest power of two of a range join's steps; wider ranges cover more steps.
LEVELS = (-20, 60)


def _bucket(time: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(seconds * 1_000_000))


def as_of_join(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], bucket: int = AS_OF_BUCKET) -> DataFrame:
    """Each left row with ``values`` of the last right row of its ``by`` at or before its ``on``.

    Both sides are stacked and sorted by key, stretch of time and time, and the
    last right values are carried forward, so a key with a third of all rows is
    spread over its stretches.  What a stretch begins with is the last right row of
    the stretches before it: a window over one row a key and stretch.  Of right
    rows at one time the largest values count.  Left rows whose key or time is
    null match nothing and are not moved.
    """
    carried = F.struct(*[F.col(v) for v in values])
    known = F.col(by).isNotNull() & F.col(on).isNotNull()
    a = left.where(known).withColumns({"_side": F.lit(1), "_right": F.lit(None), "_bucket": _bucket(on, bucket)})
    b = right.where(known).select(by, on, F.lit(0).alias("_side"), carried.alias("_right"), _bucket(on, bucket).alias("_bucket"))
    stacked = a.unionByName(b, allowMissingColumns=True)
    order = W.partitionBy(by, "_bucket").orderBy(on, "_side", "_right").rowsBetween(W.unboundedPreceding, 0)
    inside = stacked.withColumn("_right", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    ends = stacked.groupBy(by, "_bucket").agg(F.max(F.when(F.col("_side") == 0, F.struct(on, "_right"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    out = inside.join(ends.select(by, "_bucket", before["_right"].alias("_before")), [by, "_bucket"])
    found = F.coalesce("_right", "_before")
    matched = out.select(*left.columns, *[found[v].alias(f"last_{v}") for v in values])
    types = dict(right.dtypes)
    return matched.unionByName(left.where(~known).select(*left.columns, *[F.lit(None).cast(types[v]).alias(f"last_{v}") for v in values]))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, before: int) -> DataFrame:
    """Pairs with equal ``by`` and right_time in [left_time - before seconds, left_time].

    Times fall into buckets of that length; a left row looks into its own bucket
    and the one before, so the join is on keys and no pair outside two buckets is met.
    """
    own = left.withColumn("_bucket", F.explode(F.array(_bucket(left_time, before), _bucket(left_time, before) - 1)))
    other = right.withColumn("_bucket", _bucket(right_time, before))
    span: Column = F.expr(f"{right_time} <= {left_time} AND {right_time} >= {left_time} - INTERVAL {before} SECONDS")
    return own.join(other, [*by, "_bucket"]).where(span).drop("_bucket")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Pairs with low <= point <= high, for numbers; null or NaN bounds and points match nothing, bounds may be infinite.

    A range falls on the level of the power of two at or above its width and
    covers two or three steps of that level; a point looks into its step on each level
    that has ranges (there are under a hundred), so the join is on a key however the
    widths differ.  Ranges that no level of ``LEVELS`` holds, by their width or because
    their bounds lie beyond the last level's numbered steps, stand on one more level of
    a single step, which all points look into.
    """
    first, last = LEVELS
    is_number = lambda df, *names: df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(cast(`{c}` AS double))" for c in names))
    least, most = (F.col(c).cast("double") for c in (low, high))
    width = F.greatest(most - least, F.lit(2.0**first))
    level = F.greatest(F.lit(first), F.ceil(F.log2(width))).cast("int")
    kept = is_number(ranges, low, high).where(F.col(high) >= F.col(low))
    at = lambda x, level: F.floor(x / F.pow(F.lit(2.0), level))
    # Steps are numbered exactly where the bounds are below 2**52 of them.
    fits = (width < F.lit(2.0**last)) & (F.greatest(F.abs(least), F.abs(most)) / F.pow(F.lit(2.0), level) < F.lit(2.0**52))
    kept = kept.withColumn("_level", F.when(fits, level).otherwise(last + 1))
    levels = sorted(r["_level"] for r in kept.select("_level").distinct().collect())  # bounded by LEVELS
    own_level = F.col("_level")
    steps = F.when(own_level <= last, F.sequence(at(least, own_level), at(most, own_level))).otherwise(F.array(F.lit(0).cast("long")))
    covered = kept.withColumn("_step", F.explode(steps))
    own = is_number(points, point).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    place = F.col(point).cast("double") / F.pow(F.lit(2.0), own_level)
    # A point beyond the numbered steps meets no range of this level.
    step = F.when(own_level > last, F.lit(0).cast("long")).when(F.abs(place) < F.lit(2.0**53), F.floor(place))
    return own.withColumn("_step", step).join(covered, ["_level", "_step"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_level", "_step")
