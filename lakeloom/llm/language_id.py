"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: counts of each byte after each
context of up to ``ORDER`` bytes.  With frozen counts, a byte costs its code length
in the longest context that has seen it, plus the escapes from the longer contexts
that were seen without it (method C: a context seen n times with d distinct bytes
gives a byte seen c times c / (n + d), an escape d / (n + d)); a context that was
never seen costs nothing, and below the empty one all 256 bytes cost alike.  A
text's language is the one with the shortest code.

Bytes are taken as they are and all counts are kept.  Counts are gathered by
Spark: tasks count byte runs per language with numpy, one grouped sum merges them.
The trees are sparse (sorted runs and contexts of each length).  Languages are
dealt by hash into blocks of about ``BLOCK_RUNS`` runs (one language at least), and each
block is a pass over the texts with tasks of its own, so neither the driver nor a
task holds more than a block, however many languages there are; the blocks' codes of a
text meet in a grouped aggregate.

Training: documents with a text and a language whose crc32(doc_id) mod 4 is not
2; of a language with more than ``MAX_TRAINING_DOCS`` such documents, or
``MAX_TRAINING_BYTES`` of their text, those whose hash falls under the matching share
(a bound on a labelled sample, nothing else is capped).  Every whole text is predicted, a slice at a time if it is long.

Cases: a null text or one without a letter is ``und`` with score 0; a null lang or
doc_id trains nothing; ties go to the first language by name; with nothing to
learn from all texts are ``und``; repeated rows are predicted one by one; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, materialise, pick, text_documents, text_hash
from lakeloom.llm.textkernels import buffer_of, text_blocks

ORDER = 4
#: Labelled documents a language is learned from, about.
MAX_TRAINING_DOCS = 20_000
MAX_TRAINING_BYTES = 96 << 20
#: Runs of the languages of one pass, about.
BLOCK_RUNS = 4_000_000
#: Languages whose table is broadcast to the rows it samples; more are joined by a shuffle.
BROADCAST_LANGS = 100_000
#: Bytes of text that are scored at once.
SLICE_BYTES = 1 << 21
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _runs(raw: np.ndarray, offsets: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each byte from low to high the run of ORDER + 1 bytes of its text that ends with it; before a text stand spaces."""
    begin = max(0, low - ORDER)
    part = raw[begin:high].astype(np.int64)
    place = np.arange(low, high)
    inside = place - offsets[np.searchsorted(offsets, place, "right") - 1]  # bytes of the text before this one
    run = np.zeros(high - low, np.int64)
    for back in range(ORDER, -1, -1):
        byte = part[np.maximum(place - back - begin, 0)]
        run = run << 8 | np.where(inside >= back, byte, 0x20)
    return run


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """The runs of all texts slice by slice: (runs, the texts' offsets, low, high)."""
    raw, offsets = buffer_of(texts)
    for low in range(0, len(raw), SLICE_BYTES):
        high = min(len(raw), low + SLICE_BYTES)
        yield _runs(raw, offsets, low, high), offsets, low, high


def count_runs(docs: DataFrame) -> DataFrame:
    """lang, run, n: counts of byte runs over all texts given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block in text_blocks(batch, "text"):
                langs = np.array(block.column(2).to_pylist(), object)
                for lang in sorted(set(langs)):
                    for run, *_ in _slices(block.column(1).filter(pa.array(langs == lang))):
                        held[lang] = _merged(held.get(lang), *np.unique(run, return_counts=True))
                if sum(len(run) for run, _ in held.values()) > BLOCK_RUNS:
                    yield from _count_rows(held)
                    held.clear()
        yield from _count_rows(held)

    return text_documents(docs, "lang").mapInArrow(count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def _count_rows(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, (run, times) in held.items():
        for a in range(0, len(run), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(run[part]), pa.string()), pa.array(run[part]), pa.array(times[part])], ["lang", "run", "n"])


def _merged(held: tuple[np.ndarray, np.ndarray] | None, run: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if held is None:
        return run, times
    both, place = np.unique(np.concatenate([held[0], run]), return_inverse=True)
    return both, np.bincount(place, np.concatenate([held[1], times])).astype(np.int64)


def _sample(docs: DataFrame, most: int) -> DataFrame:
    """Training documents: all of a language, or a share by hash of about ``most`` and of the bytes allowed."""
    rows = text_documents(docs, "lang").withColumn("lang", F.col("lang").cast("string"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    share = F.least(F.lit(float(most)) / F.col("n"), F.lit(float(MAX_TRAINING_BYTES)) / F.greatest("bytes", F.lit(1)))
    many = materialise(sizes.select(F.col("lang").alias("_lang"), share.alias("_share")).where("_share < 1"), "langs")
    few = many.count() <= BROADCAST_LANGS
    rows = rows.join(F.broadcast(many) if few else many, F.col("lang") == F.col("_lang"), "left")
    return rows.where(F.col("_share").isNull() | (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("_share") * (1 << 20))).select("doc_id", "text", "lang")


class Tree:
    """The context tree of one language: for each length the sorted runs with their
    code lengths, and the sorted contexts with the code lengths of their escapes."""

    def __init__(self, run: np.ndarray, n: np.ndarray):
        self.levels = []  # from the longest context to the empty one
        for order in range(ORDER, -1, -1):
            runs, place = np.unique(run & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.bincount(place, n)
            context, inside = np.unique(runs >> 8, return_inverse=True)
            # The byte comes last in a run: what stands before it is its context.
            total, distinct = np.bincount(inside, counts), np.bincount(inside)
            seen = total + distinct
            self.levels.append((runs, (np.log2(seen[inside]) - np.log2(counts)).astype(np.float32), context, (np.log2(seen) - np.log2(distinct)).astype(np.float32)))

    def costs(self, run: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each run."""
        bits = np.zeros(len(run))
        left = np.arange(len(run))  # runs whose byte no longer context has seen
        for order, (runs, cost, context, escape) in zip(range(ORDER, -1, -1), self.levels):
            own = run[left] & ((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
            hit = runs[at] == own
            bits[left[hit]] += cost[at[hit]]
            left, own = left[~hit], own[~hit] >> 8
            at = np.minimum(np.searchsorted(context, own), len(context) - 1)
            bits[left] += np.where(context[at] == own, escape[at], 0)
        bits[left] += 8
        return bits


class Model:
    """The trees of a block of languages."""

    def __init__(self, langs: np.ndarray, run: np.ndarray, n: np.ndarray):
        self.langs = sorted(set(langs))
        self.trees = [Tree(run[langs == lang], n[langs == lang]) for lang in self.langs]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code length of each text (rows) under each language (columns)."""
        sums = np.zeros((len(texts), len(self.langs)))
        for run, offsets, low, high in _slices(texts):
            runs, place = np.unique(run, return_inverse=True)
            begin = np.clip(offsets, low, high) - low
            full = np.flatnonzero(begin[1:] > begin[:-1])
            for i, tree in enumerate(self.trees):
                sums[full, i] += np.add.reduceat(tree.costs(runs)[place], begin[:-1][full])
        return sums


def train(docs: DataFrame, most: int = MAX_TRAINING_DOCS) -> list[Broadcast]:
    """The counts of each block of languages, as (lang, run, n) in a broadcast."""
    spark = docs.sparkSession
    with Scratch(spark):
        counts = materialise(count_runs(_sample(docs, most)), "runs")
        blocks = -(-counts.count() // BLOCK_RUNS)
        own = F.pmod(F.xxhash64("lang"), F.lit(max(1, blocks)))
        return [spark.sparkContext.broadcast(counts.where(own == block).toArrow()) for block in range(blocks)]


def _scored(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """doc_id, _hash, _letter, and of a block of languages the shortest code, its language, and the sum of 2 ** (shortest - length) over all."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for block in text_blocks(batch, "text", SLICE_BYTES):
                if model is None:
                    table = sent.value
                    model = Model(table["lang"].to_numpy(), table["run"].to_numpy(), table["n"].to_numpy())
                bits = model.lengths(block.column(1)) if model.langs else np.full((block.num_rows, 1), np.inf)
                best = bits.min(axis=1)
                name = np.array(model.langs or [UNKNOWN], object)[bits.argmin(axis=1)]
                total = np.exp2(np.maximum(np.where(np.isinf(bits), 0, best[:, None] - bits), -1000)).sum(axis=1)
                columns = [block.column(0), *block.columns[2:], pa.array(best), pa.array(name, pa.string()), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_hash", "_letter", "_bits", "_lang", "_sum"])

    return rows.mapInArrow(score, "doc_id long, _hash long, _letter boolean, _bits double, _lang string, _sum double")


def predict(docs: DataFrame, models: list[Broadcast]) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the score is the language's posterior per text, all alike before."""
    letter = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    rows = text_documents(docs).withColumns({"_hash": text_hash(F.col("text")), "_letter": letter})
    if not models:
        out = rows.select("doc_id", F.lit(False).alias("_letter"), F.lit(0.0).alias("_bits"), F.lit(UNKNOWN).alias("_lang"), F.lit(1.0).alias("_sum"))
    elif len(models) == 1:
        out = _scored(rows, models[0])
    else:
        parts = None
        for i, sent in enumerate(models):
            own = _scored(rows, sent).withColumn("_block", F.lit(i))
            parts = own if parts is None else parts.unionByName(own)
        # Rows that agree in doc_id and text have the same codes: one of them stands for all, as often as they are.
        one = parts.groupBy("doc_id", "_hash", "_letter", "_block").agg(F.count("*").alias("_n"), F.min(F.struct("_bits", "_lang", "_sum")).alias("_b"))
        met = one.groupBy("doc_id", "_hash", "_letter").agg(F.max("_n").alias("_n"), F.min("_b").alias("_best"), F.collect_list("_b").alias("_all"))  # a block an entry
        total = F.aggregate("_all", F.lit(0.0), lambda s, b: s + b["_sum"] * F.pow(F.lit(2.0), F.greatest(F.col("_best._bits") - b["_bits"], F.lit(-1000.0))))
        out = met.select("doc_id", "_letter", "_best._bits", "_best._lang", total.alias("_sum"), F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    known = F.col("_letter") & (F.col("_bits") < float("inf"))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.when(known, F.col("_lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.lit(1.0) / F.col("_sum")).otherwise(0.0).alias("score"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    return predict(docs, train(docs))
