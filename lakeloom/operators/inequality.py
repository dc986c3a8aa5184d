"""Joins on two inequalities, ``left.x < right.x AND left.y > right.y``, without comparing all pairs.

Both sides are stacked and put in one order of x and one of y, such that a right row
stands behind a left one in x, and before it in y, exactly where the conditions hold:
of equal values the side that must not match comes first (x) or last (y).  Each
order is cut into strips of equally many rows, whatever the values are, so a value
that a third of the rows share is cut as well.  Strips make a grid:

* A right row in a later strip of x and an earlier strip of y matches: counted from a
  table of the grid's cells, or met by an equi-join of dyadic blocks of strips.
* Only rows that share a strip of x, or of y, are looked at one by one, sorted inside
  that strip.

``matching_rows`` counts the matches of each left row in n log n steps without making
a pair, ``matching_sums`` counts and sums them by a column of the left rows in as many;
``inequality_pairs`` returns the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.scratch import Scratch, materialise

#: Rows of a strip, about, and strips at most: their cells are a matrix of 8 MB that tasks share.
STRIP_ROWS = 250_000
MOST_STRIPS = 1024
#: Rows of a strip of ``inequality_pairs``, and of one block of a join key.
PAIR_STRIP_ROWS = 256
PAIR_BLOCK = 4096


def _stacked(left: DataFrame, right: DataFrame, x: str, y: str, keep_left: str, keep_right: str, of_left: tuple[Column, ...] = (), of_right: tuple[Column, ...] = ()) -> DataFrame:
    """id, x, y, is_right and further columns of a side; rows with a null in x or y match nothing and are left out."""
    side = lambda df, key, flag, more: df.select(F.col(key).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(flag).alias("is_right"), *more)
    rows = side(left, keep_left, False, of_left).unionByName(side(right, keep_right, True, of_right), allowMissingColumns=True)
    return rows.where("x IS NOT NULL AND y IS NOT NULL")


def _strips(rows: DataFrame, n: int) -> DataFrame:
    """Adds xs, ys (strips) and xi, yi (places inside the strip, for rows of one strip)."""
    spread = F.xxhash64("id", "is_right")  # cuts a run of equal values
    for name, order in (("x", [F.col("x"), F.col("is_right").desc(), spread]), ("y", [F.col("y"), F.col("is_right"), spread])):
        placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        # The id's high bits are the partition, its low 33 bits the row in it; written, since cuts are drawn anew when recomputed.
        rows = materialise(placed.withColumn("_at", F.monotonically_increasing_id()), f"strips-{name}")
        rows = rows.withColumns({f"{name}s": F.shiftright("_at", 33).cast("int"), f"{name}i": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")
    return rows


def _dominated(first: np.ndarray, second: np.ndarray, is_right: np.ndarray, weight: np.ndarray | int = 1) -> np.ndarray:
    """For each left row the number (or sum of weights) of right rows behind it in ``first`` and before it in ``second``.

    Ranks in ``second`` are split bit by bit: rows that agree in the higher bits form a group
    in order of ``first``, and a left row with the bit set counts the right rows
    behind it in its group without it.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    rank[np.argsort(second, kind="stable")] = np.arange(n)
    rank, right = rank[order], np.where(is_right, weight, 0)[order]
    left = ~is_right[order]
    found, place = np.zeros(n, np.int64), np.arange(n)
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        group = rank >> (bit + 1)
        zero = (rank >> bit) & 1 == 0
        upto = np.cumsum(right * zero)
        end = np.searchsorted(group, group, "right") - 1
        asks = left & ~zero
        found[place[asks]] += (upto[end] - upto)[asks]
        step = np.argsort(rank >> bit, kind="stable")  # keeps the order of ``first`` within the new groups
        rank, right, left, place = rank[step], right[step], left[step], place[step]
    out = np.empty(n, np.int64)
    out[order] = found
    return out


def _inside(rows: DataFrame, by: str, key: str, sums: list[str]) -> DataFrame:
    """``key`` and ``sums`` (``n`` first): matches of left rows among the right rows of their own strip ``by``.

    In a strip of x all pairs count, in a strip of y those of different strips of x: the
    others were counted there.
    """

    def count(strip: pa.Table) -> pa.Table:
        right = strip["is_right"].to_numpy()
        xs, ys, x, y = (strip[c].to_numpy() for c in ("xs", "ys", "xi", "yi"))
        if by == "xs":
            first, second = x, np.argsort(np.argsort(ys * (np.int64(1) << 33) + y, kind="stable"), kind="stable")
        else:
            # Behind it in strips of x: inside a strip left rows are put behind right ones, so none of it counts.
            first, second = xs.astype(np.int64) * 2 + ~right, y
        got = [_dominated(first, second, right, strip[c].to_numpy()) for c in sums]
        keep = ~right & (got[0] > 0)
        return pa.table({key: strip[key].filter(pa.array(keep)), **{c: g[keep] for c, g in zip(sums, got)}})

    longs = "".join(f", {c} long" for c in sums)
    return rows.select(key, "is_right", "xs", "ys", "xi", "yi", *sums).groupBy(by).applyInArrow(count, f"{key} {dict(rows.dtypes)[key]}{longs}")


def _matched(rows: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """``key`` and ``sums`` of left rows, in several rows: of the right rows' columns ``sums``, long without nulls, over their matches; ``n`` is first and 1."""
    spark = rows.sparkSession
    strips = max(1, min(MOST_STRIPS, -(-rows.count() // STRIP_ROWS)))
    rows = _strips(rows, strips)
    cells = np.zeros((len(sums), strips + 1, strips + 1), np.int64)
    for r in rows.where("is_right").groupBy("xs", "ys").agg(*[F.sum(c).alias(c) for c in sums]).collect():  # MOST_STRIPS squared at most
        cells[:, r["xs"], r["ys"]] = [r[c] for c in sums]
    # Right rows in later strips of x and earlier strips of y.
    later = np.cumsum(cells[:, ::-1], axis=1)[:, ::-1]
    whole = np.zeros((len(sums), strips, strips), np.int64)
    whole[:, :, 1:] = np.cumsum(later[:, 1:, : strips - 1], axis=2)[:, :strips]
    sent = spark.sparkContext.broadcast(whole)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value[:, batch.column(1).to_numpy(), batch.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], [key, *sums])

    longs = "".join(f", {c} long" for c in sums)
    outside = rows.where("NOT is_right").select(key, "xs", "ys").mapInArrow(looked_up, f"{key} {dict(rows.dtypes)[key]}{longs}")
    return outside.unionByName(_inside(rows, "xs", key, sums)).unionByName(_inside(rows, "ys", key, sums))


def matching_rows(left: DataFrame, right: DataFrame, x: str, y: str, left_key: str, right_key: str) -> DataFrame:
    """Each left row's key (``id``) and ``n``, the right rows with ``left.x < right.x AND left.y > right.y``.

    Keys are distinct on either side.  Left rows without x, y or matches have n = 0.
    """
    with Scratch(left.sparkSession):
        parts = _matched(_stacked(left, right, x, y, left_key, right_key).withColumn("n", F.lit(1).cast("long")), "id", ["n"])
        parts = parts.unionByName(left.where(F.col(x).isNull() | F.col(y).isNull()).select(F.col(left_key).alias("id"), F.lit(0).cast("long").alias("n")))
        return materialise(parts.groupBy("id").agg(F.sum("n").alias("n")), "matching", keep=True)


def matching_sums(left: DataFrame, right: DataFrame, x: str, y: str, left_key: str, right_key: str, by: str, value: str) -> DataFrame:
    """Of each value of the left rows' ``by`` (``by``) the pairs with ``left.x < right.x AND left.y > right.y`` (``n``) and the sum of their right rows' ``value``, an integer without nulls (``total``).

    Values without pairs have no row.  Keys are distinct on either side, or nearly so: they cut runs of equal x or y.
    """
    with Scratch(left.sparkSession):
        held = F.col(value).cast("long")
        # Halves of the value: their sums over right rows stay within 64 bits whatever the values are.
        halves = (F.shiftright(held, 32).alias("high"), held.bitwiseAND((1 << 32) - 1).alias("low"))
        rows = _stacked(left, right, x, y, left_key, right_key, (F.col(by).alias("by"),), halves)
        rows = rows.withColumn("n", F.lit(1).cast("long")).fillna(0, ["high", "low"])
        sums = ["n", "high", "low"]
        found = _matched(rows, "by", sums).groupBy("by").agg(*[F.sum(F.col(c).cast("decimal(20, 0)")).alias(c) for c in sums]).where("n > 0")
        found = found.select("by", F.col("n").cast("long").alias("n"), F.expr("cast(high * 4294967296BD + low as bigint)").alias("total"))
        return materialise(found, "matching-sums", keep=True)


def _nodes(at: str, bits: int) -> Column:
    """All dyadic blocks that hold a strip: level * 2**20 + number."""
    return F.array(*[F.lit(level << 20) + F.shiftright(F.col(at), level) for level in range(bits)])


def _beside(at: str, bits: int, later: bool) -> Column:
    """The dyadic blocks that make up all strips after (or before) this one: at each level the sibling on that side."""
    wanted = 0 if later else 1
    blocks = [F.when(F.shiftright(F.col(at), level).bitwiseAND(1) == wanted, F.lit(level << 20) + F.shiftright(F.col(at), level).bitwiseXOR(F.lit(1))) for level in range(bits)]
    return F.array_compact(F.array(*blocks))


def inequality_pairs(left: DataFrame, right: DataFrame, x: str, y: str, left_key: str, right_key: str) -> DataFrame:
    """left_id, right_id of all pairs with ``left.x < right.x AND left.y > right.y``, each once.

    A left row asks for the dyadic blocks of later strips of x and of earlier strips of y,
    a right row stands in all blocks that hold it, so each pair of different strips
    meets under exactly one key and nothing else meets there.  Keys of many rows are
    cut into blocks on both sides.
    """
    with Scratch(left.sparkSession):
        rows = _stacked(left, right, x, y, left_key, right_key)
        strips = max(1, min(MOST_STRIPS, -(-rows.count() // PAIR_STRIP_ROWS)))
        rows = _strips(rows, strips)
        bits = max(1, (strips - 1).bit_length())
        of_left = rows.where("NOT is_right").select(F.col("id").alias("left_id"), F.col("x").alias("lx"), F.col("y").alias("ly"), "xs", "ys")
        of_right = rows.where("is_right").select(F.col("id").alias("right_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), "xs", "ys")
        far = _dealt(of_left.withColumn("kx", F.explode(_beside("xs", bits, True))).withColumn("ky", F.explode(_beside("ys", bits, False))), of_right.withColumn("kx", F.explode(_nodes("xs", bits))).withColumn("ky", F.explode(_nodes("ys", bits))))
        # Rows of one strip of x, then those of one strip of y and different strips of x, by their values.
        holds = "lx < rx AND ly > ry"
        near = _dealt(of_left.withColumn("kx", F.col("xs")).withColumn("ky", F.lit(0)), of_right.withColumn("kx", F.col("xs")).withColumn("ky", F.lit(0))).where(holds)
        beside = _dealt(of_left.withColumn("ky", F.col("ys")).withColumn("kx", F.explode(_beside("xs", bits, True))), of_right.withColumn("ky", F.col("ys")).withColumn("kx", F.explode(_nodes("xs", bits)))).where(holds)
        return materialise(far.unionByName(near).unionByName(beside).select("left_id", "right_id"), "pairs", keep=True)


def _dealt(of_left: DataFrame, of_right: DataFrame) -> DataFrame:
    """Equi-join on (kx, ky); a key's rows are cut into blocks of about ``PAIR_BLOCK`` on both sides, each pair of blocks a key of its own."""
    sizes = of_left.groupBy("kx", "ky").agg(F.count("*").alias("nl")).join(of_right.groupBy("kx", "ky").agg(F.count("*").alias("nr")), ["kx", "ky"])
    sizes = sizes.select("kx", "ky", F.ceil(F.col("nl") / PAIR_BLOCK).cast("int").alias("bl"), F.ceil(F.col("nr") / PAIR_BLOCK).cast("int").alias("br"))
    own = of_left.select("left_id", "lx", "ly", "kx", "ky").join(sizes, ["kx", "ky"])
    own = own.withColumn("_l", F.pmod(F.xxhash64("left_id"), F.col("bl")).cast("int")).withColumn("_r", F.explode(F.expr("sequence(0, br - 1)")))
    other = of_right.select("right_id", "rx", "ry", "kx", "ky").join(sizes, ["kx", "ky"])
    other = other.withColumn("_r", F.pmod(F.xxhash64("right_id"), F.col("br")).cast("int")).withColumn("_l", F.explode(F.expr("sequence(0, bl - 1)")))
    return own.drop("bl", "br").join(other.drop("bl", "br"), ["kx", "ky", "_l", "_r"])
