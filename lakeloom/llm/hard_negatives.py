"""Hard negatives by a vector-approximation file.

Each dimension is cut into 16 cells of about equally many values.  The file holds,
for each row, the cells of its components (four bits each, two a byte) beside the
integer vector.  For an anchor a table says, for each byte of two cells, the least and
the largest share of the score that values in those cells can have; a row's lower and
upper score bound are sums of looked-up shares, and only rows whose bounds leave
them a chance are scored exactly.

1. Positives: rows of the anchor's label.  A row is scored if its upper bound reaches
   the fifth best score of the task so far and the fifth best lower bound beside it.
2. Negatives: rows of other labels.  For each positive a row is scored if its bounds
   meet the window of scores, and its upper bound reaches the fifth best that is
   already known to lie in the window.

Anchors are a stated query set against all rows.  They are sent in blocks of about
``BLOCK_ANCHORS``, a pass over the file each; a task keeps the best few rows of each
anchor, and a shuffle by anchor merges them.  Nothing is dealt by label, so one label
may hold any share of the rows.

Cases: rows with a null label, vector or vec_id, or a null or non-finite component
take no part, nor do rows with a component of magnitude ``LARGEST`` or more, whose
scores could leave 64 bits; of rows that repeat a vec_id the one with the least
(label, vector) counts; a shorter vector counts as filled up with zeros; ties go by
vec_id; an empty table, an anchor without positives and a window without rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, materialise, pick, scratch_path

N_POSITIVES = 5
N_NEGATIVES = 5
#: A negative has so many percent of the positive's score at least, and all of it at most.
LEAST_PERCENT = 80
ANCHOR_EVERY = 100
SCALE = 256
CELLS = 16
LARGEST = 1 << 20
BLOCK_ANCHORS = 16_384
#: Rows whose bounds are looked up at once.
ROWS = 1 << 15
#: Less than any score, and so is its negative a number.
_NONE = np.iinfo(np.int64).min + 1


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (as the contract changes it), v: integer components; one row a vec_id."""
    rows = pick(embeddings, "vec_id", "label", "embedding").withColumns({"vec_id": F.col("vec_id").cast("long"), "label": F.col("label").cast("int")})
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(f"forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < {LARGEST})")
    rows = rows.select(
        "vec_id", F.expr("CASE WHEN vec_id % 7 = 0 THEN cast((cast(label AS long) + 1) % 10 AS int) ELSE label END AS label"), F.expr(f"transform(embedding, x -> cast(floor(cast(x AS double) * {SCALE}) AS int)) AS v")
    )
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


class Cells:
    """The cells of each dimension: ``low`` and ``high`` are the least and largest value of each."""

    def __init__(self, rows: DataFrame):
        shares = [i / CELLS for i in range(1, CELLS)]
        stats = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", shares, 1000).alias("cuts"))
        found = stats.orderBy("d").collect()  # a row a dimension
        self.n = len(found) + len(found) % 2
        low, high = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)  # zero is in every dimension's range: vectors may be filled up
        self.cuts = np.zeros((self.n, CELLS - 1), np.int64)
        for r in found:
            low[r["d"]], high[r["d"]], self.cuts[r["d"]] = min(r["low"], 0), max(r["high"], 0), r["cuts"]
        self.low = np.maximum(np.hstack([low[:, None], self.cuts + 1]), low[:, None])
        self.high = np.minimum(np.hstack([self.cuts, high[:, None]]), high[:, None])
        # Two equal cuts leave an empty cell between; its bounds are never looked up.
        self.high = np.maximum(self.high, self.low)
        self.packed = bool((np.abs(np.hstack([low, high])).max(initial=0) ** 2) * max(self.n, 1) < 1 << 30)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A byte for each two dimensions."""
        cell = np.empty(vectors.shape, np.uint8)
        for d in range(self.n):
            cell[:, d] = np.searchsorted(self.cuts[d], vectors[:, d], "left")
        return cell[:, ::2] * CELLS + cell[:, 1::2]

    def bounds(self, anchor: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper score bounds of rows, by table lookup; ``codes`` has a line for each two dimensions."""
        one, other = anchor[:, None] * self.low, anchor[:, None] * self.high
        tables = []
        for share in (np.minimum(one, other), np.maximum(one, other)):
            tables.append((share[::2, :, None] + share[1::2, None, :]).reshape(-1, CELLS * CELLS))
        if not self.packed:
            return self._sum(tables[0], codes), self._sum(tables[1], codes)
        both = self._sum((tables[0] << 32) + tables[1], codes)  # both fit in 32 bits with their signs
        high = both.astype(np.int32).astype(np.int64)
        return (both - high) >> 32, high

    @staticmethod
    def _sum(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(codes.shape[1], np.int64)
        share = np.empty_like(total)
        for line, at in zip(table, codes):
            total += np.take(line, at, out=share, mode="clip")
        return total


def approximation_file(rows: DataFrame, cells: Cells) -> DataFrame:
    """vec_id, label, codes and vector (32-bit integers), written to the shared folder."""
    n = cells.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            offsets = np.asarray(lists.offsets).astype(np.int64)
            offsets -= offsets[0]
            vectors = np.zeros((batch.num_rows, n), np.int32)
            sizes = np.diff(offsets)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            vectors[row, np.arange(len(row)) - np.repeat(offsets[:-1], sizes)] = lists.flatten().to_numpy()
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "codes": _binary(cells.codes(vectors)), "vector": _binary(vectors)})

    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    return materialise(spread.mapInArrow(run, "vec_id long, label int, codes binary, vector binary"), "approximations")


def _binary(values: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize * values.shape[1]
    offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(dtype).reshape(len(column), width)


class _Rows:
    """Some rows of the file, put in order of their labels."""

    def __init__(self, batches: list[pa.RecordBatch], n: int):
        table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        label = table.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        self.label, self.vec_id = label[order], table.column("vec_id").to_numpy()[order]
        self.vectors = _matrix(table.column("vector"), np.int32, n)[order]
        self.codes = np.ascontiguousarray(_matrix(table.column("codes"), np.uint8, n // 2)[order].T).astype(np.intp)

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))


def _blocks_of_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[_Rows]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            if held and sum(b.num_rows for b in held) + min(ROWS, batch.num_rows - a) > ROWS:
                yield _Rows(held, n)
                held = []
            held.append(batch.slice(a, ROWS))
    if sum(b.num_rows for b in held):
        yield _Rows(held, n)


class _Best:
    """The first k rows of each of n lists, by score from high to low, then by vec_id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.vec_id = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)

    def last(self, i: int) -> int:
        """The score that a further row must reach."""
        return int(self.score[i, -1])

    def add(self, i: int, score: np.ndarray, vec_id: np.ndarray) -> None:
        score, vec_id = np.concatenate([self.score[i], score]), np.concatenate([self.vec_id[i], vec_id])
        best = np.lexsort([vec_id, -score])[: self.k] if score.max(initial=_NONE) > _NONE else np.arange(self.k)
        self.score[i], self.vec_id[i] = score[best], vec_id[best]

    def batch(self, keys: dict[str, np.ndarray]) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > _NONE)
        return pa.RecordBatch.from_pydict({k: v[i] for k, v in keys.items()} | {"vec_id": self.vec_id[i, j], "score": self.score[i, j]})


def _kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, or less than any if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else _NONE


def _positives(file: DataFrame, anchors: dict[str, np.ndarray], cells: Cells, k: int) -> DataFrame:
    sent = file.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = (sent.value[x] for x in ("vec_id", "label", "vector"))
        best = _Best(len(ids), k)
        for rows in _blocks_of_rows(batches, cells.n):
            for i in range(len(ids)):
                a, b = rows.of_label(labels[i])
                if a == b:
                    continue
                low, high = cells.bounds(vectors[i], rows.codes[:, a:b])
                # The anchor itself may be among them, so one more must be known to be as good.
                at = a + np.flatnonzero(high >= max(best.last(i), _kth(low, k + 1)))
                at = at[rows.vec_id[at] != ids[i]]
                if len(at):
                    best.add(i, rows.vectors[at].astype(np.int64) @ vectors[i], rows.vec_id[at])
        yield best.batch({"anchor_id": ids})

    return file.mapInArrow(run, "anchor_id long, vec_id long, score long")


def _negatives(file: DataFrame, anchors: dict[str, np.ndarray], cells: Cells, k: int, percent: int) -> DataFrame:
    """For each window (an anchor's positive) the first k rows of other labels; ``first``: each anchor's windows."""
    sent = file.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        labels, vectors, first = (own[x] for x in ("label", "vector", "first"))
        top = own["positive_score"].tolist()
        least = [-((-percent * s) // 100) for s in top]
        best = _Best(len(top), k)
        for rows in _blocks_of_rows(batches, cells.n):
            for i in range(len(labels)):
                windows = [w for w in range(first[i], first[i + 1]) if least[w] <= top[w]]
                if not windows:
                    continue
                a, b = rows.of_label(labels[i])
                low, high = cells.bounds(vectors[i], rows.codes)
                high[a:b] = _NONE  # the anchor's label
                chance = np.zeros(len(low), bool)
                for w in windows:
                    reach = max(least[w], best.last(w))
                    inside = low <= top[w]
                    inside &= high >= reach
                    if best.last(w) == _NONE:  # rows that must lie in the window
                        inside &= high >= _kth(low[inside & (high <= top[w]) & (low >= least[w])], k)
                    chance |= inside
                at = np.flatnonzero(chance)
                if not len(at):
                    continue
                score, ids = rows.vectors[at].astype(np.int64) @ vectors[i], rows.vec_id[at]
                for w in windows:
                    fits = (score <= top[w]) & (score >= max(least[w], best.last(w)))
                    if fits.any():
                        best.add(w, score[fits], ids[fits])
        yield best.batch({"anchor_id": own["vec_id"][own["window_of"]], "positive_id": own["positive_id"], "positive_score": own["positive_score"]})

    return file.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, vec_id long, score long")


def _anchors(own: DataFrame, n: int) -> dict[str, np.ndarray]:
    """One block of anchors, in order of vec_id."""
    table = own.select("vec_id", "label", "vector").orderBy("vec_id").toArrow().combine_chunks()
    vectors = [np.frombuffer(v.as_py(), np.int32) for v in table.column("vector")]
    return {"vec_id": table.column("vec_id").to_numpy(), "label": table.column("label").to_numpy(), "vector": np.array(vectors, np.int64).reshape(len(vectors), n)}


def hard_negatives(
    embeddings: DataFrame, anchor_every: int = ANCHOR_EVERY, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, least_percent: int = LEAST_PERCENT
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    with Scratch(spark):
        rows = materialise(integer_rows(embeddings), "vectors")
        cells = Cells(rows)
        file = approximation_file(rows, cells)
        anchors = file.where(f"vec_id % {anchor_every} = 0")
        blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
        out = scratch_path(spark, "negatives", keep=True)
        for block in range(blocks):
            own = _anchors(anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block), cells.n)
            best = W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
            ranked = _positives(file, own, cells, n_positives).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_positives)
            found = ranked.select("anchor_id", "vec_id", "score").orderBy("anchor_id", F.desc("score"), "vec_id").toArrow()  # n_positives rows an anchor of the block
            place = np.searchsorted(own["vec_id"], found.column("anchor_id").to_numpy())
            own |= {"positive_id": found.column("vec_id").to_numpy(), "positive_score": found.column("score").to_numpy(), "window_of": place, "first": np.searchsorted(place, np.arange(len(own["vec_id"]) + 1))}
            best = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
            ranked = _negatives(file, own, cells, n_negatives, least_percent).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
            ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(out)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def negatives_sql(table: str) -> str:
    """DuckDB SQL of hard_negatives."""
    return f"""
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v
               FROM {table} WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    a AS (SELECT vec_id AS anchor_id, label, v FROM r WHERE vec_id % {ANCHOR_EVERY} = 0),
    p AS (SELECT anchor_id, a.label, a.v, r.vec_id AS positive_id, list_inner_product(a.v, r.v)::BIGINT AS positive_score FROM a JOIN r ON a.label = r.label AND anchor_id <> r.vec_id
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY positive_score DESC, r.vec_id) <= {N_POSITIVES}),
    n AS (SELECT anchor_id, r.vec_id AS negative_id, list_inner_product(a.v, r.v)::BIGINT AS negative_score FROM a JOIN r ON a.label <> r.label)
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INT AS rank, negative_id, positive_score, negative_score
    FROM p JOIN n USING (anchor_id) WHERE {LEAST_PERCENT} * positive_score <= 100 * negative_score AND negative_score <= positive_score
    QUALIFY rank <= {N_NEGATIVES}"""


ORACLE = negatives_sql("embeddings")
