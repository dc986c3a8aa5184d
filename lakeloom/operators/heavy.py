"""Frequent values by count-min matrices and bounded counters, both mergeable.

A task makes one matrix of ``depth`` rows by ``width`` counters, to which each of its
values adds one in every row, and keeps at most ``1 / share`` candidates
(Misra-Gries: a value above that share of the task's rows is among them).  Matrices
add up cell by cell, candidates by value, so both survive merging in any order and may
be kept and merged with those of later rows.

An estimate is the least of a value's counters: never below its true count, and above
it by at most ``e / width`` of all rows with a probability of ``1 - exp(-depth)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.scratch import Scratch, materialise

DEPTH = 5
WIDTH = 4096


def _cell(code: Column, row: int | Column, width: int) -> Column:
    """The counter of a value's hash in a row of the matrix, from 0 to width - 1."""
    return F.pmod(F.xxhash64(code, F.lit(row) if isinstance(row, int) else row), F.lit(width)).cast("int")


def sketch(rows: DataFrame, value: str, share: float, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """kind, row, cell, value, n: counters (kind 0) and candidates (kind 1) of all tasks, merged.

    Null values are not counted.  Values are taken as strings.
    """
    most = int(np.ceil(1 / share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((depth, width), np.int64)
        held: pd.Series | None = None
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            code, values = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            n = np.bincount(code, minlength=len(values))
            # Equal values have equal cells: one row of each is enough.
            first = np.unique(code, return_index=True)[1]
            for row in range(depth):
                np.add.at(matrix[row], batch.column(1 + row).to_numpy()[first], n)
            own = pd.Series(n, values.to_pylist())
            held = own if held is None else held.add(own, fill_value=0)
            if len(held) > most:
                # Taking the same from all counters keeps every value above 1 / most of the rows so far.
                held = held - np.sort(held.to_numpy())[-most - 1]
                held = held[held > 0]
        row, cell = np.nonzero(matrix)
        held = pd.Series([], dtype="int64") if held is None else held
        yield pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([0] * len(row) + [1] * len(held), pa.int32()),
                "row": pa.array([*row.tolist(), *[None] * len(held)], pa.int32()),
                "cell": pa.array([*cell.tolist(), *[None] * len(held)], pa.int32()),
                "value": pa.array([None] * len(row) + list(held.index), pa.string()),
                "n": pa.array([*matrix[row, cell].tolist(), *held.astype("int64").tolist()], pa.int64()),
            }
        )

    own = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("value"))
    parts = own.select("value", *[_cell(F.col("value"), i, width).alias(f"c{i}") for i in range(depth)]).mapInArrow(run, "kind int, row int, cell int, value string, n long")
    return merged([parts])


def merged(sketches: list[DataFrame]) -> DataFrame:
    """One sketch of several with the same depth and width."""
    together = sketches[0]
    for more in sketches[1:]:
        together = together.unionByName(more)
    return together.groupBy("kind", "row", "cell", "value").agg(F.sum("n").alias("n"))


def estimates(found: DataFrame, values: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """value, estimate: of each row of ``values`` (column value)."""
    asked = values.select("value").distinct().withColumn("row", F.explode(F.expr(f"sequence(0, {depth - 1})")))
    asked = asked.withColumn("cell", _cell(F.col("value"), F.col("row"), width))
    counters = found.where("kind = 0").select("row", "cell", "n")
    return asked.join(counters, ["row", "cell"], "left").groupBy("value").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def heavy_hitters(rows: DataFrame, value: str, share: float, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """value, n, estimate: every value with more than ``share`` of all non-null rows, with its exact count.

    The sketch leaves a bounded number of candidates, none of the values sought is
    missing among them, and a second pass counts those alone.
    """
    with Scratch(rows.sparkSession):
        found = materialise(sketch(rows, value, share, depth, width), "sketch")
        total = found.where("kind = 0 AND row = 0").agg(F.sum("n")).first()[0] or 0
        near = estimates(found, found.where("kind = 1"), depth, width).where(F.col("estimate") > F.lit(share * total))
        near = materialise(near, "candidates")  # at most the counters of all tasks, those with too low an estimate left out
        exact = rows.select(F.col(value).cast("string").alias("value")).join(F.broadcast(near) if near.count() <= 100_000 else near, "value").groupBy("value", "estimate").agg(F.count("*").alias("n"))
        return materialise(exact.where(F.col("n") > F.lit(share * total)).select("value", "n", "estimate"), "heavy", keep=True)
