"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased (A-Z) sequences of alphanumeric words; each kana
or Han character is a word.  An item of n words may occur with up to e word
edits, a fifth of n.  It is cut into e + 1 pieces: an occurrence with e edits
leaves one piece whole, so every occurrence has an exact piece hit.  Whole pieces
are found by their rolling hash, and each hit's window is verified with Myers'
bit-parallel edit distance.  Items of one to four words are one piece (e = 0) and
must stand there exactly.

The benchmark is a stated query set: it is sent to the tasks in blocks of about
``BLOCK_BYTES`` of text, one pass over the documents a block, so what is broadcast
has a fixed bound (or is one item).  Nothing of the documents is shuffled.

Cases: null or empty texts match nothing; items without words match nothing;
equal items all match, at the cost of one; repeated documents each match; a piece
of many items or places is worked through in slices of ``MOST_HITS``; of equal
distances the first place in the text counts; a text of any length takes eight
bytes a word beyond itself; empty tables give no rows; a null doc_id is kept;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, materialise, pick, text_documents
from lakeloom.llm.textkernels import WORD_BY_ALNUM, Words, text_blocks

#: Share of an item's words that may be edited.
ERROR_SHARE = 0.2
#: Item text that one pass over the documents looks for, about.
BLOCK_BYTES = 8 << 20
#: Texts with a hit that are broadcast at most; more are joined by a shuffle.
BROADCAST_HITS = 1_000_000
#: Words and hits that are worked on at once.
SLICE_WORDS = 1 << 18
MOST_HITS = 1 << 20
#: Items whose bit masks a task keeps.
KEPT_MASKS = 4096

MATCHES = "doc_id long, item_id long, distance int, first_word long, last_word long"


def error_budget(n: int) -> int:
    """Word edits allowed in an item of n words."""
    return int(ERROR_SHARE * n)


def myers(masks: dict[int, int], n: int, words: list[int], most: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any run of words, and the run's last word.

    ``masks``: bit i of masks[w] is set if pattern word i is w.  The first least
    distance counts; (most + 1, -1) if none is within ``most``.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, at = most + 1, -1
    for j, w in enumerate(words):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a run may start anywhere: the top row stays 0
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Pieces:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        words = _words(pa.array([t for _, t in items], pa.string()))
        self.ids: list[list[int | None]] = []  # of each distinct sequence of words
        self.hashes: list[np.ndarray] = []
        known: dict[bytes, int] = {}
        pieces: dict[int, list[tuple[int, int, int]]] = {}  # words of a piece: its place in the block, item, offset
        for r, (item_id, _) in enumerate(items):
            own = words.hash[words.first[r] : words.first[r + 1]]
            n = len(own)
            if not n:
                continue
            m = known.setdefault(own.tobytes(), len(self.ids))
            if m < len(self.ids):
                self.ids[m].append(item_id)
                continue
            self.ids.append([item_id])
            self.hashes.append(own)
            cuts = [i * n // (error_budget(n) + 1) for i in range(error_budget(n) + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(b - a, []).append((int(words.first[r]) + a, m, a))
        self.pieces = []
        for length, found in sorted(pieces.items()):
            place, item, offset = np.array(found, np.int64).T
            at, value = words.grams(length)
            key = value[np.searchsorted(at, place)]
            order = np.argsort(key, kind="stable")
            self.pieces.append((length, key[order], item[order], offset[order]))
        self.size = np.array([len(h) for h in self.hashes], np.int64)
        self.budget = np.array([error_budget(n) for n in self.size.tolist()], np.int64)
        self._masks: dict[int, dict[int, int]] = {}

    def masks(self, item: int) -> dict[int, int]:
        have = self._masks.get(item)
        if have is None:
            if len(self._masks) >= KEPT_MASKS:
                self._masks.clear()
            have = self._masks[item] = {}
            for i, w in enumerate(self.hashes[item].tolist()):
                have[w] = have.get(w, 0) | 1 << i
        return have

    def _hits(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of (text, item, where the item would start if no edit came before)."""
        for low in range(0, len(words.hash), SLICE_WORDS):
            for length, keys, items, offsets in self.pieces:
                at, value = words.grams(length, low, low + SLICE_WORDS)
                left = np.searchsorted(keys, value, "left")
                hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == value)
                many = np.searchsorted(keys, value[hit], "right") - left[hit]
                turn = np.cumsum(many) // MOST_HITS
                for t in np.unique(turn):
                    own, times = hit[turn == t], many[turn == t]
                    entry = np.repeat(left[own], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    place = np.repeat(at[own], times)
                    yield words.text_of(place), items[entry], place - offsets[entry]

    def matches(self, words: Words) -> Iterator[tuple[int, int | None, int, int, int]]:
        """(text, item_id, distance, first word, last word) of each text's best match with each item."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for row, item, begin in self._hits(words):
            # Windows of one text and item that touch are one.
            order = np.lexsort((begin, item, row))
            row, item, begin = row[order], item[order], begin[order]
            n, e = self.size[item], self.budget[item]
            a, b = begin - e, begin + n + e
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (a[1:] > b[:-1])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(row)) - 1
            rows, items = row[first], item[first]
            low = np.maximum(a[first], words.first[rows]).tolist()
            high = np.minimum(b[last], words.first[rows + 1]).tolist()
            for r, m, x, y in zip(rows.tolist(), items.tolist(), low, high):
                e = int(self.budget[m])
                distance, at = myers(self.masks(m), int(self.size[m]), words.hash[x:y].tolist(), e)
                if distance <= e:
                    found = distance, x + at - int(words.first[r])
                    best[r, m] = min(best.get((r, m), found), found)
        for (r, m), (distance, last) in best.items():
            for item_id in self.ids[m]:
                yield r, item_id, distance, max(0, last - int(self.size[m]) + 1), last


def _words(texts: pa.Array) -> Words:
    return Words(texts, WORD_BY_ALNUM, unspaced=True)


def _sent_blocks(items: DataFrame) -> Iterator[Broadcast]:
    """The items in broadcasts of about BLOCK_BYTES of text."""
    spark = items.sparkSession
    wanted = pick(items, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    with Scratch(spark):
        if blocks > 1:
            wanted = materialise(wanted.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
        for block in range(blocks):
            own = wanted.where(F.col("_block") == block) if blocks > 1 else wanted
            yield spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, first_word, last_word of each document's best match with each item.

    first_word is where the item would start without insertions or deletions.
    """
    rows, out = text_documents(docs), None
    for sent in list(_sent_blocks(items)):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces = Pieces(sent.value)
            for batch in batches:
                for part in text_blocks(batch, "text"):
                    found = list(pieces.matches(_words(part.column(1))))
                    if found:
                        r, item, distance, first, last = zip(*found)
                        columns = [part.column(0).take(pa.array(r)), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "first_word", "last_word"])

        found = rows.mapInArrow(search, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def without_items(rows: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds no item, each judged by its own text.

    With one block of items no row moves between tasks.  With several, each block is a
    pass of its own tasks that yields the hashes of texts with a hit, and rows with
    such a text are dropped by a join: one pass on another would hold all blocks at once.
    """
    sent = list(_sent_blocks(items))

    def hits(block: Broadcast, texts: pa.Array, pieces: list[Pieces]) -> np.ndarray:
        if not pieces:
            pieces.append(Pieces(block.value))
        hit = np.zeros(len(texts), bool)
        hit[[r for r, *_ in pieces[0].matches(_words(texts))]] = True
        return hit

    if len(sent) == 1:

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces: list[Pieces] = []
            for batch in batches:
                for part in text_blocks(batch, text):
                    yield part.filter(pa.array(~hits(sent[0], part.column(part.schema.get_field_index(text)), pieces)))

        return rows.mapInArrow(clean, rows.schema)
    keyed = rows.withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(7), text)})
    found = None
    for block in sent:

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            pieces: list[Pieces] = []
            for batch in batches:
                for part in text_blocks(batch, text):
                    yield part.select(["_h1", "_h2"]).filter(pa.array(hits(block, part.column(0), pieces)))

        own = keyed.select(text, "_h1", "_h2").mapInArrow(search, "_h1 long, _h2 long")
        found = own if found is None else found.unionByName(own)
    found = materialise(found.distinct(), "hits", keep=True)
    few = found.count() <= BROADCAST_HITS
    return keyed.join(F.broadcast(found) if few else found, ["_h1", "_h2"], "left_anti").drop("_h1", "_h2")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item.

    Rows with null or empty texts stay, repeated rows are judged one by one and
    doc_ids play no part; an empty table gives no rows; of other columns than the
    documents' own none is kept.
    """
    rows = pick(docs, "doc_id", "text", "lang", "source", "n_chars").withColumn("text", F.col("text").cast("string"))
    return without_items(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
