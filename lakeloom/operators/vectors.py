"""Nearest vectors by an inverted file: cells around centroids, probed from the nearest on.

Centroids are fitted on a bounded sample (``SAMPLE`` rows at most, those with the
least hash of their id); every row is put into the cell of its nearest centroid.  A
query is compared with the rows of its nearest cells only, by exact cosine.  How many
cells are probed is settled on the sample: enough that ``SHARE`` of the sample's own
nearest rows lie in them.

With ``exact``, a second step adds each cell whose bound leaves it a chance: rows of a
cell lie within its angle of the centroid, so no row's angle to the query is below the
difference of the two.  Then the result equals a comparison with all rows.

Cells are cut into buckets of about ``BUCKET`` rows and the queries that visit one
into blocks of about ``QUERIES``, so a cell with a third of all rows is many tasks, and
a task holds one bucket and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.scratch import Scratch, materialise

SAMPLE = 32_768
MOST_CELLS = 1024
ROUNDS = 8
SHARE = 0.97
BUCKET = 16_384
QUERIES = 2_048
#: Above the rounding of a cosine of unit vectors.
SLACK = 1e-9


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: vectors of length one, one row an id.

    Rows without id or vector, with a null or non-finite component, of length zero
    or of another dimension than most rows take no part; of rows that repeat an id
    the one with the least vector counts.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e150)")
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()  # a row a dimension
    rows = rows.where(F.size("v") == (most["n"] if most else 0))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("_length", length).where("_length > 0").select("id", F.transform("v", lambda x: x / F.col("_length")).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit length, by spherical k-means from rows spread over the sample."""
    centre = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        cell = np.argmax(sample @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, cell, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(length > 0, sums / np.where(length > 0, length, 1), centre)
    return centre


def _probes(sample: np.ndarray, centre: np.ndarray, k: int) -> int:
    """Cells to probe so that they hold ``SHARE`` of the nearest rows of some of the sample's rows."""
    cell = np.argmax(sample @ centre.T, axis=1)
    asked = np.linspace(0, len(sample) - 1, min(len(sample), 256)).astype(int)
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(sample[asked] @ centre.T), axis=1), axis=1)
    of_best = np.sort(place[np.arange(len(asked))[:, None], cell[best]].ravel())
    return int(of_best[min(len(of_best) - 1, int(SHARE * len(of_best)))]) + 1 if len(of_best) else 1


class VectorIndex:
    """The rows by cell, written to the shared folder; made inside a ``Scratch`` block.

    ``centre``: centroids; ``count`` and ``angle``: rows of each cell and the largest
    angle of one to its centroid; ``probes``: cells that a query visits.
    """

    def __init__(self, vectors: DataFrame, k: int):
        vectors = materialise(vectors, "vectors")
        n = vectors.count()
        sample = _matrix(vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"])
        cells = max(1, min(MOST_CELLS, int(n**0.5), len(sample)))
        self.dimension = sample.shape[1]
        self.centre = _fit(sample, cells) if len(sample) else np.zeros((1, self.dimension))
        self.probes = _probes(sample, self.centre, k) if len(sample) > 1 else 1
        centre = vectors.sparkSession.sparkContext.broadcast(self.centre)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _matrix(batch.column(1)) @ centre.value.T
                    cell = np.argmax(near, axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(cell)), cell])], ["id", "v", "cell", "near"])

        self.rows = materialise(vectors.mapInArrow(place, "id long, v array<double>, cell int, near double"), "cells")
        self.count, self.angle = np.zeros(len(self.centre), np.int64), np.zeros(len(self.centre))
        for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("low")).collect():  # a row a cell
            self.count[r["cell"]], self.angle[r["cell"]] = r["n"], np.arccos(np.clip(r["low"] - SLACK, -1, 1))

    def nearest_cells(self, queries: DataFrame) -> DataFrame:
        """id, v, cell: the ``probes`` nearest cells of each query."""
        return self._visits(queries, None)

    def other_cells(self, queries: DataFrame) -> DataFrame:
        """The same for cells beyond those that may hold a row as good as the query's column ``last``."""
        return self._visits(queries, "last")

    def _visits(self, queries: DataFrame, last: str | None) -> DataFrame:
        sent = queries.sparkSession.sparkContext.broadcast((self.centre, self.angle, self.count))
        probes = self.probes

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, angle, count = sent.value
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    own = batch.slice(a, 1024)
                    near = _matrix(own.column("v")) @ centre.T
                    first = np.argsort(np.argsort(-near, axis=1), axis=1) < probes
                    if last is None:
                        row, cell = np.nonzero(first & (count > 0))
                    else:
                        best = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - angle)) + SLACK
                        row, cell = np.nonzero(~first & (count > 0) & (best >= own.column(last).to_numpy()[:, None]))
                    ids = own.select(["id", "v"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

        return queries.mapInArrow(visit, "id long, v array<double>, cell int")

    def compared(self, visits: DataFrame, k: int) -> DataFrame:
        """query_id, id, cosine: of each group of rows and visiting queries the first k of each query."""
        spark = visits.sparkSession
        visits = materialise(visits, "visits")
        sizes = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row a cell
        cut = [(c, -(-int(self.count[c]) // BUCKET), -(-n // QUERIES)) for c, n in sizes.items()]
        cuts = F.broadcast(spark.createDataFrame(cut, "cell int, buckets int, blocks int"))
        mod = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        rows = self.rows.select("id", "v", "cell").join(cuts, "cell").select("id", "v", "cell", mod("buckets").alias("bucket"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
        asking = visits.join(cuts, "cell").select("id", "v", "cell", F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"), mod("blocks").alias("block"))

        def best(own: pa.Table, queries: pa.Table) -> pa.Table:
            none = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
            if not own.num_rows or not queries.num_rows:
                return none
            ids, asked = own["id"].to_numpy(), queries["id"].to_numpy()
            order = np.argsort(ids)  # of equal cosines the least id comes first
            ids, vectors = ids[order], _matrix(own["v"])[order]
            out = []
            for a in range(0, len(asked), 256):
                near = _matrix(queries["v"].slice(a, 256)) @ vectors.T
                near[asked[a : a + 256, None] == ids] = -2
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(top)), top.shape[1])
                cosine = near[row, top.ravel()]
                keep = cosine > -2
                out.append(pa.table({"query_id": asked[a : a + 256][row][keep], "id": ids[top.ravel()][keep], "cosine": cosine[keep]}))
            return pa.concat_tables(out)

        keys = ["cell", "bucket", "block"]
        return rows.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(best, "query_id long, id long, cosine double")


def nearest_vectors(df: DataFrame, key: str, vector: str, asks: str, k: int = 10, exact: bool = True) -> DataFrame:
    """query_id, rank (from 1), id, cosine: the k nearest other rows of each row for which the condition ``asks`` holds on ``id``.

    Ties go by id.  Without ``exact`` only the probed cells are compared.  An empty table gives no rows.
    """
    first = W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    with Scratch(df.sparkSession):
        index = VectorIndex(unit_vectors(df, key, vector), k)
        queries = index.rows.where(asks).select("id", "v")
        found = materialise(ranked(index.compared(index.nearest_cells(queries), k)), "nearest", keep=not exact)
        if exact:
            last = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("cosine")).otherwise(-1.0).alias("last"))
            asked = queries.join(last, "id", "left").fillna(-1.0, ["last"])
            more = index.compared(index.other_cells(asked), k)
            found = materialise(ranked(found.drop("rank").unionByName(more)), "nearest", keep=True)
        return found.select("query_id", "rank", "id", "cosine")
