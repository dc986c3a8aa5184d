"""Exact percentiles by selection: brackets around the wanted ranks narrow, round by round.

A group's percentile asks for one or two ranks among its values.  Each rank has a
bracket, the least and largest value it can be, and the number of values below.  A round
counts the bracket's rows in bins, and the bin that holds the rank becomes the bracket,
cut to the values that occur in it, until they are one.  So one group may hold all
rows: what is shuffled are counts of bins, and only the number of open brackets
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.scratch import Scratch, materialise

BINS = 1024


def _bin(x: Column, low: Column, high: Column) -> Column:
    """0 to BINS: first by sign, then by the logarithm where values differ widely, else evenly.  It never falls as x rises."""
    wide = (F.greatest(F.abs(low), F.abs(high)) > F.lit(1024.0) * F.least(F.abs(low), F.abs(high))) & (F.least(F.abs(low), F.abs(high)) > 0)
    by_log = (F.log2(F.abs(x)) - F.log2(F.abs(low))) / (F.log2(F.abs(high)) - F.log2(F.abs(low)))
    # Halves, since a difference of two large values may be beyond a double.
    evenly = (x / 2 - low / 2) / (high / 2 - low / 2)
    mixed = F.signum(x) + 1
    share = F.when(low == high, 0.0).when(wide, by_log).otherwise(evenly)
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * BINS))).cast("int")
    return F.when((low < 0) & (high > 0) | (low < 0) & (high == 0) | (low == 0) & (high > 0), mixed.cast("int")).otherwise(place)


def exact_percentiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by, and a double for each name of ``wanted``: ("cont", p) interpolates between two ranks, ("disc", p) is the first value whose share of rows reaches p.

    Null and NaN values do not count; infinite ones do, as the least and largest.
    Groups without other values have nulls; null groups are groups.
    """
    with Scratch(rows.sparkSession):
        x = F.col(value).cast("double")
        # Infinite values are ranked as the largest finite ones and set back at the end.
        edge = 1.7976931348623157e308
        held = rows.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.when(x == float("inf"), edge).when(x == float("-inf"), -edge).when(~F.isnan(x), x).alias("x"))
        groups = [f"g{i}" for i in range(len(by))]
        sizes = materialise(held.groupBy(*groups).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "sizes")
        asked = []
        for name, (kind, p) in wanted.items():
            at = F.lit(float(p)) * (F.col("n") - 1)
            ranks = [F.floor(at), F.ceil(at)] if kind == "cont" else [F.greatest(F.lit(0), F.ceil(F.lit(float(p)) * F.col("n") - 1e-9) - 1)]
            asked += [F.struct(F.lit(f"{name}{i}").alias("name"), r.cast("long").alias("rank")) for i, r in enumerate(ranks)]
        brackets = sizes.where("n > 0").select(*groups, "low", "high", F.explode(F.array(*asked)).alias("a")).select(*groups, "low", "high", "a.name", "a.rank", F.lit(0).cast("long").alias("below"))
        brackets = materialise(brackets, "brackets")
        same = lambda a, b: [a[g].eqNullSafe(b[g]) for g in groups]
        while True:
            open_ = brackets.where("low < high")
            if not open_.count():
                break
            # Ranks of a group that share a bracket are counted once.
            spans = open_.select(*groups, "low", "high").distinct()
            inside = held.alias("h").join(F.broadcast(spans).alias("s") if spans.count() <= 100_000 else spans.alias("s"), [*same_names(groups), F.expr("h.x >= s.low AND h.x <= s.high")])
            bins = inside.select(*[F.col(f"s.{g}").alias(g) for g in groups], "s.low", "s.high", F.col("h.x").alias("x")).groupBy(*groups, "low", "high", _bin(F.col("x"), F.col("low"), F.col("high")).alias("bin")).agg(
                F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")
            )
            near = open_.alias("b").join(bins.alias("c"), [*(F.col(f"b.{g}").eqNullSafe(F.col(f"c.{g}")) for g in groups), F.expr("b.low = c.low AND b.high = c.high")])
            near = near.select(*[F.col(f"b.{g}").alias(g) for g in groups], "b.name", "b.rank", "b.below", "c.bin", "c.n", "c.least", "c.most")
            # At most BINS rows a bracket.
            lists = near.groupBy(*groups, "name", "rank", "below").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "least", "most"))).alias("bins"))
            start = F.struct(F.col("below").alias("upto"), F.col("below").alias("below"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
            found = F.aggregate(
                "bins",
                start,
                lambda s, b: F.when(s["low"].isNotNull(), s).otherwise(
                    F.struct((s["upto"] + b["n"]).alias("upto"), s["upto"].alias("below"), F.when(s["upto"] + b["n"] > F.col("rank"), b["least"]).alias("low"), F.when(s["upto"] + b["n"] > F.col("rank"), b["most"]).alias("high"))
                ),
            )
            narrowed = lists.select(*groups, "name", "rank", found.alias("f")).select(*groups, "f.low", "f.high", "name", "rank", "f.below")
            brackets = materialise(brackets.where("low >= high").unionByName(narrowed), "brackets")
        back = F.when(F.col("low") == edge, float("inf")).when(F.col("low") == -edge, float("-inf")).otherwise(F.col("low"))
        ranked = brackets.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("name", back.alias("v")))).alias("v"))
        joined = sizes.alias("z").join(ranked.alias("r"), [*(F.col(f"z.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups)] or F.lit(True), "left")
        out = []
        for name, (kind, p) in wanted.items():
            low, high = F.col("r.v")[f"{name}0"], F.col("r.v")[f"{name}1"]
            part = F.lit(float(p)) * (F.col("z.n") - 1)
            part = part - F.floor(part)
            between = F.when(low == high, low).when(part == 0, low).otherwise(low + (high - low) * part)
            out.append((between if kind == "cont" else low).alias(name))
        return materialise(joined.select(*[F.col(f"z.g{i}").alias(c) for i, c in enumerate(by)], *out), "percentiles", keep=True)


def same_names(groups: list[str]) -> list[Column]:
    return [F.col(f"h.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
