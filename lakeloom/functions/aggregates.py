"""User aggregates with partial states in Arrow: no group is ever whole in one worker.

An aggregate names the columns of its state and says, each over a whole Arrow table of
many groups, how rows become states (``start``), how states of one group are merged
(``merge``) and how states become results (``finish``).  Tasks start states from their
batches and merge them as they go, a shuffle deals the states by group and a salt, and
two more merges, by salt and then by group, end it.  So a group with all rows costs a
task no more than one state at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that a task holds before it passes their states on, and states that are merged at once.
HELD_GROUPS = 100_000
#: Salts of a group: the states of one group are merged by so many tasks first.
SALTS = 16


class MergeableAggregate(Protocol):
    """``state`` and ``result``: SQL types by column name."""

    state: dict[str, str]
    result: dict[str, str]

    def start(self, group: np.ndarray, n: int, columns: list[np.ndarray]) -> dict[str, np.ndarray]:
        """The states of groups 0 to n - 1 from rows: the group of each row, and the columns' values without nulls."""

    def merge(self, group: np.ndarray, n: int, state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The states of groups 0 to n - 1 from states: the group of each state."""

    def finish(self, state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The results, a row a state."""


class Spread:
    """Largest less least value."""

    state = {"low": "double", "high": "double"}
    result = {"spread": "double"}

    def start(self, group, n, columns):
        return self.merge(group, n, {"low": columns[0], "high": columns[0]})

    def merge(self, group, n, state):
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(low, group, state["low"])
        np.maximum.at(high, group, state["high"])
        return {"low": low, "high": high}

    def finish(self, state):
        return {"spread": state["high"] - state["low"]}


class WeightedMoments:
    """Mean and variance of values under weights, merged without loss of digits (deviations are kept about each state's own mean)."""

    state = {"w": "double", "mean": "double", "dev": "double"}
    result = {"w_mean": "double", "w_var": "double"}

    def start(self, group, n, columns):
        value, weight = columns
        return self.merge(group, n, {"w": weight, "mean": value, "dev": np.zeros(len(value))})

    def merge(self, group, n, state):
        w = np.bincount(group, state["w"], n)
        mean = np.bincount(group, state["w"] * state["mean"], n) / np.where(w > 0, w, 1)
        dev = np.bincount(group, state["dev"] + state["w"] * (state["mean"] - mean[group]) ** 2, n)
        return {"w": w, "mean": mean, "dev": dev}

    def finish(self, state):
        some = np.where(state["w"] > 0, state["w"], np.nan)
        return {"w_mean": np.where(state["w"] > 0, state["mean"], np.nan), "w_var": state["dev"] / some}


def _groups(rows: pa.Table, keys: list[str]) -> tuple[np.ndarray, pa.Table, int]:
    """The group of each row, the groups' keys, and how many there are."""
    if not keys:
        return np.zeros(rows.num_rows, np.int64), pa.table({}), min(rows.num_rows, 1)
    found = rows.select(keys).append_column("_at", pa.array(np.arange(rows.num_rows))).group_by(keys, use_threads=False).aggregate([("_at", "list")])
    lists = found["_at_list"].combine_chunks()
    group = np.empty(rows.num_rows, np.int64)
    group[lists.flatten().to_numpy()] = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return group, found.select(keys), len(lists)


def aggregated(rows: DataFrame, by: list[str], columns: list[str], aggregate: MergeableAggregate) -> DataFrame:
    """by and the aggregate's results; rows with a null in one of the columns do not count, groups of no other rows have no row."""
    kinds = dict(rows.dtypes)
    states, width = list(aggregate.state), len(by)
    names = [*(f"k{i}" for i in range(width)), *states]
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(by)), *(f"{c} {t}" for c, t in aggregate.state.items())])

    def table(keys: pa.Table, state: dict[str, np.ndarray]) -> pa.Table:
        return pa.table({**{c: keys[c] for c in names[:width]}, **state})

    def merged(parts: list[pa.Table]) -> pa.Table:
        together = pa.concat_tables(parts)
        group, keys, n = _groups(together, names[:width])
        return table(keys, aggregate.merge(group, n, {c: together[c].to_numpy() for c in states}))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).rename_columns([*names[:width], *(f"c{i}" for i in range(len(columns)))])
            group, keys, n = _groups(rows, names[:width])
            held.append(table(keys, aggregate.start(group, n, [c.to_numpy() for c in rows.columns[width:]])))
            if sum(t.num_rows for t in held) > HELD_GROUPS:
                held = [merged(held)]
                if held[0].num_rows > HELD_GROUPS // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged(held).to_batches()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States come in order of their groups; those of one group stand side by side."""
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch.select(names)]))
                if sum(t.num_rows for t in held) > HELD_GROUPS:
                    held = [merged(held)]
                    if held[0].num_rows > 1:  # all but the last group are complete
                        last = held[0].slice(held[0].num_rows - 1)
                        yield from held[0].slice(0, held[0].num_rows - 1).to_batches()
                        held = [last]
        if held:
            yield from merged(held).to_batches()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = aggregate.finish({c: batch.column(c).to_numpy() for c in states})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:width]), *(pa.array(v, from_pandas=True) for v in out.values())], [*names[:width], *out])

    known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)) if columns else rows
    keys = names[:width]
    parts = known.select(*by, *columns).mapInArrow(start, schema)
    # The salt is the task's, so a repeated task deals its states as before.
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.repartition(*keys, "_salt")
    some = (some.sortWithinPartitions(*keys) if keys else some).mapInArrow(again, schema)
    whole = (some.repartition(*keys).sortWithinPartitions(*keys) if keys else some.coalesce(1)).mapInArrow(again, schema)
    kept = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(by)), *(f"{c} {t}" for c, t in aggregate.result.items())])
    return whole.mapInArrow(finish, kept).toDF(*by, *aggregate.result)
