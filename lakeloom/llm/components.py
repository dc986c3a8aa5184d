"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, materialise

#: A node with more than one in so many edges is joined by broadcast: there are fewer than this.
HOT_SHARE = 500


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (x, y) of long nodes; label: the least node reachable.

    Each round joins every node's neighbours to its least neighbour: first the
    larger ones (large star), then the smaller ones (small star).  Rounds grow
    with the logarithm of the longest path.  Least neighbours are partial minima
    before any shuffle; nodes with over 1 / HOT_SHARE of all edges are fewer than
    HOT_SHARE, so they reach their edges by a broadcast and no task gathers them.
    Rounds are written to the shared folder; no edge reaches the driver.
    The result reads one table, which belongs to the ``Scratch`` block around.
    """
    with Scratch(edges.sparkSession):
        held = materialise(_oriented(edges.select("x", "y")), "edges")
        before = None
        while True:
            with Scratch(edges.sparkSession):
                both = held.unionByName(held.select(F.col("y").alias("x"), F.col("x").alias("y")))
                large = _with_least(both).where("y > x").select(F.col("y").alias("x"), F.least("x", "_low").alias("y"))
                large = materialise(_oriented(large), "large-star")
                small = _with_least(large).select(F.explode(F.array("x", "y")).alias("x"), F.col("_low").alias("y"))
                held = materialise(_oriented(small), "small-star", keep=True)
            state = held.agg(F.count("*"), F.expr("sum(cast(xxhash64(x, y) as decimal(38, 0)))")).first()
            if state == before:
                break
            before = state
        own = held.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(held.select(F.col("y").alias("node"), F.col("y").alias("label")))
        return materialise(own.groupBy("node").agg(F.min("label").alias("label")), "labels", keep=True)


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds ``_low``, the least y of each x."""
    low = materialise(edges.groupBy("x").agg(F.min("y").alias("_low"), F.count("*").alias("_n")), "least")
    total = low.agg(F.sum("_n")).first()[0] or 0
    hot = low.where(F.col("_n") * HOT_SHARE > total).select("x", F.col("_low").alias("_hot"))
    marked = edges.join(F.broadcast(hot), "x", "left")
    rest = marked.where("_hot IS NULL").drop("_hot").join(low.select("x", "_low"), "x")
    return marked.where("_hot IS NOT NULL").withColumnRenamed("_hot", "_low").unionByName(rest)


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller."""
    return edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
