"""Removal of repeated word sequences, found by recompression.

A text is a string of words.  Rounds of recompression replace maximal runs of one
symbol, then pairs of a left and a right symbol (a bit of the symbol's name decides
its side in a round), by new symbols.  Names are 64-bit hashes of what they name, so
equal runs and pairs have one name in all tasks and a round needs no exchange of a
dictionary.  With each symbol goes the stretch of words that settles it: wherever
those words stand, the symbol stands too.  So the symbols settled inside a window of
``WINDOW`` words are the same in each of its occurrences.  Among those that fewer
than half as many words settle, the highest (then by a hash of the words that settle
it, which also tells equal names apart, then from the left) is the window's anchor.  Two
equal windows have the same anchor at the same place, whatever stands around them.

1. A pass over the texts writes, for each run of windows with one anchor, the
   anchor's symbol and a hash of the run's words (its span).
2. Symbols that anchor one run only are in no repeated window.  If all runs of a
   symbol have one span, all their windows are repeated.
3. Where the spans of a symbol differ, one text of each distinct span gives the hash
   of each of its windows; windows that are met twice, or in a span met twice, are
   repeated.  What is compared here are windows with equal symbols, so two equal
   64-bit hashes of words stand behind each repeat.
4. The repeated windows come back to their texts, which lose the words they cover.

Anchors, windows and spans are counted with map-side sums.  A symbol, window or span
with a large part of all rows is one of at most a few thousand; such ones are found
by bounded counters or by their counts, their list is sent to the tasks, and what is
known of them is broadcast.

Cases: null and empty texts, and texts of fewer words than a window, lose nothing;
repeated rows, with or without doc_id, are repeats of each other; an empty table
gives no rows; other columns are ignored.  A text of any length is worked through in
slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, materialise, text_documents, text_hash
from lakeloom.llm.ngram_join import FrequentValues
from lakeloom.llm.textkernels import _BASE, _POWERS, _POWERS_INV, WORD_BY_SPACE, Words, mix64, text_blocks

#: Words of a window; at most 63, since a run of windows is a mask of 64 bits.
WINDOW = 35
#: Rounds at most; they end earlier when nothing new can be settled inside a window.
ROUNDS = 24
SLICE_WORDS = 1 << 18
#: Frequent symbols, windows and spans have over one in so many of all rows.
COUNTERS = 1024
MANY = 1000
#: Bytes of a text that are split into words at once.
PART_BYTES = 4 << 20

_U = np.uint64
_FAR = np.int64(1) << np.int64(40)
_RUN, _PAIR = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


class Symbols:
    """The symbols of one round, in order; ``gap`` marks places that hold none (text ends, and symbols not settled inside a window).

    ``at``, ``end``: words that a symbol stands for; ``low``, ``high``: words that settle it.
    """

    def __init__(self, word: np.ndarray, first: np.ndarray):
        n = len(word)
        ends = np.unique(first)
        self.word, self.edge = word, np.zeros(n + 1, bool)  # edge: a text begins or ends before this word
        self.edge[ends] = True
        # A gap before each text and after the last one.
        place = np.arange(n) + np.searchsorted(ends, np.arange(n), "right")
        size = n + len(ends)
        self.gap = np.ones(size, bool)
        self.gap[place] = False
        self.name, self.at = np.zeros(size, _U), np.zeros(size, np.int64)
        self.name[place], self.at[place] = word, np.arange(n)
        self.end = self.at + 1
        self.low, self.high = np.where(self.gap, -_FAR, self.at), np.where(self.gap, _FAR, self.end)

    def runs(self) -> np.ndarray:
        """Names maximal runs; returns the places of new symbols."""
        same = (self.name[1:] == self.name[:-1]) & ~self.gap[1:] & ~self.gap[:-1]
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        tail = np.concatenate([head[1:] - 1, [len(self.name) - 1]])
        # The neighbour is another symbol: one word settles it where the words differ, else all that settles the neighbour.
        at, end, inside = self.at, self.end, ~self.gap[head]
        right = self.high[np.minimum(tail + 1, len(self.gap) - 1)]
        left = self.low[np.maximum(head - 1, 0)]
        h, t = head[inside], tail[inside]
        differs = ~self.edge[end[t]] & (self.word[np.minimum(end[t], len(self.word) - 1)] != self.word[at[t]])
        right[inside] = np.where(differs, end[t] + 1, right[inside])
        differs = ~self.edge[at[h]] & (self.word[at[h] - 1] != self.word[end[h] - 1])
        left[inside] = np.where(differs, at[h] - 1, left[inside])
        low, high = np.minimum(np.minimum.reduceat(self.low, head), left), np.maximum(np.maximum.reduceat(self.high, head), right)
        size = tail - head + 1
        new = np.flatnonzero(size > 1)
        name = self.name[head]
        name[new] = mix64(name[new] * _RUN + size[new].astype(_U))
        self._set(head, tail, name, low, high)
        return new

    def pairs(self, step: int) -> np.ndarray:
        """Names pairs of a left and a right symbol; returns the places of new symbols."""
        left = (self.name >> _U(step)) & _U(1) == 1
        right = ~left & ~self.gap
        left &= ~self.gap
        pair = np.zeros(len(left), bool)
        pair[:-1] = left[:-1] & right[1:]
        second = np.zeros(len(left), bool)
        second[1:] = pair[:-1]
        low, high = self.low.copy(), self.high.copy()
        # A left symbol that stays depends on what follows it, a right one on what stands before it.
        stay = np.flatnonzero(left & ~pair)
        low[stay], high[stay] = np.minimum(low[stay], self.low[stay + 1]), np.maximum(high[stay], self.high[stay + 1])
        stay = np.flatnonzero(right & ~second)
        low[stay], high[stay] = np.minimum(low[stay], self.low[stay - 1]), np.maximum(high[stay], self.high[stay - 1])
        p = np.flatnonzero(pair)
        low[p], high[p] = np.minimum(self.low[p], self.low[p + 1]), np.maximum(self.high[p], self.high[p + 1])
        name = self.name.copy()
        name[p] = mix64(self.name[p] * _U(_BASE) + (self.name[p + 1] ^ _PAIR))
        head = np.flatnonzero(~second)
        self._set(head, head + pair[head], name[head], low[head], high[head])
        return np.flatnonzero(pair[head])

    def _set(self, head: np.ndarray, tail: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.gap, self.at, self.end = self.gap[head], self.at[head], self.end[tail]
        self.name, self.low, self.high = name, low, high

    def drop(self, most: int) -> None:
        """What more words settle is a gap from now on; gaps side by side are one."""
        self.gap |= self.high - self.low > most
        self.low[self.gap], self.high[self.gap] = -_FAR, _FAR
        keep = np.ones(len(self.gap), bool)
        keep[1:] = ~(self.gap[1:] & self.gap[:-1])
        for k in ("gap", "name", "at", "end", "low", "high"):
            setattr(self, k, getattr(self, k)[keep])


def settled_symbols(word: np.ndarray, first: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By round, from the words themselves on: the words (low, high) that settle each new symbol, ``most`` at most."""
    s = Symbols(word, first)
    out = [(np.arange(len(word)), np.arange(1, len(word) + 1))]
    for step in range(ROUNDS):
        for new in (s.runs, lambda: s.pairs(step)):
            at = new()
            at = at[s.high[at] - s.low[at] <= most]
            out.append((s.low[at], s.high[at]))
            s.drop(most)
        if s.gap.all():
            break
    return out


def anchored_runs(word: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, symbol and span of each run of windows with one anchor."""
    n = len(word) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    valid = np.diff(np.searchsorted(first, [np.arange(n), np.arange(n) + window - 1], "right"), axis=0)[0] == 0
    anchor, names, known = np.full(n, -1), [], 0
    free = valid.copy()
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(word * _POWERS[: len(word)])])
    for low, high in reversed(settled_symbols(word, first, max(1, window // 2 - 1))):
        if not free.any():
            break
        open_before = np.concatenate([[0], np.cumsum(free)])
        a, b = np.maximum(high - window, 0), np.minimum(low, n - 1) + 1  # windows that hold the symbol
        at = np.flatnonzero((b > a) & (open_before[np.maximum(b, 0)] > open_before[a]))
        # The last one written stays: the largest hash, then the leftmost.
        at = at[::-1]
        name = _hash(sums, low[at], high[at])
        order = np.argsort(name, kind="stable")
        at, name = at[order], name[order]
        a, size = a[at], b[at] - a[at]
        place = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
        which = np.repeat(np.arange(len(at)) + known, size)
        taken = free[place]
        anchor[place[taken]] = which[taken]
        free &= anchor < 0
        names.append(name)
        known += len(at)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    new[1:] |= valid[1:] & np.isin(np.arange(1, n), first)  # a run stays in its text
    start = np.flatnonzero(new)
    size = np.diff(np.searchsorted(np.flatnonzero(valid), np.append(start, n)))
    return start, size, np.concatenate([np.zeros(0, _U), *names])[anchor[start]], _hash(sums, start, start + size + window - 1)


def _hash(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of the words low to high, from the prefix sums of all."""
    return mix64((sums[high] - sums[low]) * _POWERS_INV[low] ^ (high - low).astype(_U))


def _runs_of(texts: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text, first window in it, number of windows, symbol, span; slices of words overlap by a window."""
    words = Words(texts, WORD_BY_SPACE, lower=False)
    for a in range(0, len(words.hash), SLICE_WORDS):
        word = words.hash[a : a + SLICE_WORDS + window - 1]
        first = np.concatenate([[0], np.clip(words.first - a, 0, len(word)), [len(word)]])
        start, size, symbol, span = anchored_runs(word, np.unique(first), window)
        text = words.text_of(start + a)
        yield text, start + a - words.first[text], size, symbol, span


def _anchors(docs: DataFrame, window: int, most: int) -> DataFrame:
    """A row a run of windows; and rows of frequent symbols, with how often they were counted (``times``)."""
    names = ["doc", "text_hash", "start", "n", "symbol", "span", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = FrequentValues(most)
        for batch in batches:
            for block in text_blocks(batch, "text"):
                doc, digest = (block.column(c).to_numpy() for c in ("doc", "text_hash"))
                for text, start, size, symbol, span in _runs_of(block.column("text"), window):
                    frequent.add(symbol.view(np.int64))
                    columns = [doc[text], digest[text], start.astype(np.int32), size.astype(np.int32), symbol.view(np.int64), span.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(text), pa.int64())], names)
        at = np.flatnonzero(frequent.count * most >= frequent.total)
        none, few = pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32())
        yield pa.RecordBatch.from_arrays([none, none, few, few, pa.array(frequent.value[at]), none, pa.array(frequent.count[at])], names)

    return _keyed(docs).mapInArrow(run, "doc long, text_hash long, start int, n int, symbol long, span long, times long")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc and text_hash tell different texts apart; rows that agree in both have one text and lose the same words."""
    rows = text_documents(docs)
    return rows.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc"), text_hash(F.col("text")).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")


def _often(rows: DataFrame, key: str) -> Column:
    """Whether a key is among these: at most as many as there are counters."""
    return F.coalesce(F.col(key).isin([r[key] for r in rows.select(key).distinct().collect()]), F.lit(False))


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], often: Column) -> DataFrame:
    """Rows joined with the table's row of their keys; those of the (boundedly many) frequent keys are broadcast."""
    plain = rows.where(~often).join(table.where(~often), keys)
    return plain.unionByName(rows.where(often).join(F.broadcast(table.where(often)), keys))


def _window_hashes(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """symbol, span, k, window, times: the hash of each window of the spans, in one text that has the span."""
    of_text = spans.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "n", "symbol", "span", "times")).alias("spans"))
    one = W.partitionBy("doc", "text_hash").orderBy("doc")
    rows = _keyed(docs).drop("doc_id").join(of_text, ["doc", "text_hash"]).withColumn("_k", F.row_number().over(one)).where("_k = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = Words(block.column("text"), WORD_BY_SPACE, lower=False)
                lists = block.column("spans")
                own = lists.flatten()
                start, n, symbol, span, times = (own.field(c).to_numpy() for c in ("start", "n", "symbol", "span", "times"))
                start = start + np.repeat(words.first[:-1], np.diff(lists.offsets))
                row = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                place = start[row] + k
                value = np.zeros(len(place), _U)
                for a in range(0, len(words.hash), SLICE_WORDS):
                    at, gram = words.grams(window, a, a + SLICE_WORDS)
                    inside = np.flatnonzero((place >= a) & (place < a + SLICE_WORDS))
                    value[inside] = gram[np.searchsorted(at, place[inside])]
                columns = [symbol[row], span[row], k.astype(np.int32), value.view(np.int64), times[row]]
                for a in range(0, len(row), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in columns], ["symbol", "span", "k", "window", "times"])

    return rows.select("text", "spans").mapInArrow(run, "symbol long, span long, k int, window long, times long")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, text_hash, start, mask: bit k is set if the window that begins at word start + k is repeated."""
    spark = docs.sparkSession
    most = max(COUNTERS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = materialise(_anchors(docs, window, most), "anchors")
    anchors = held.where("times IS NULL").drop("times")
    many = max(MANY, anchors.count() // most + 1)
    found = held.where("times IS NOT NULL").groupBy("symbol").agg(F.sum("times").alias("times")).where(F.col("times") >= many)
    often = _often(found, "symbol")
    hot, plain = anchors.where(often), anchors.where(~often).repartition("symbol")
    by_span = W.partitionBy("symbol", "span")
    plain = plain.withColumn("rank", F.row_number().over(by_span.orderBy("doc", "text_hash", "start"))).withColumn("times", F.count("*").over(by_span))
    by_symbol = W.partitionBy("symbol")
    plain = plain.withColumns({"runs": F.count("*").over(by_symbol), "_low": F.min("span").over(by_symbol), "_high": F.max("span").over(by_symbol)}).where("runs > 1")
    shared = materialise(plain.withColumn("several", F.expr("_low <> _high")).drop("runs", "_low", "_high"), "shared")

    of_hot = materialise(hot.groupBy("symbol", "span").agg(F.count("*").alias("times"), F.min(F.struct("doc", "text_hash", "start", "n")).alias("at")), "hot-spans")
    names = ["doc", "text_hash", "start", "n", "symbol", "span", "times"]
    spans = shared.where("several AND rank = 1").select(*names).unionByName(of_hot.select("at.*", "symbol", "span", "times").select(*names))
    windows = materialise(_window_hashes(docs, spans, window), "windows")
    counted = windows.groupBy("symbol", "window").agg(F.sum("times").alias("met"), F.count("*").alias("rows")).where("met > 1")
    counted = materialise(counted, "counted")
    often = _often(counted.where(F.col("rows") >= max(MANY, windows.count() // most + 1)), "window")
    met = _looked_up(windows, counted.select("symbol", "window"), ["symbol", "window"], often)
    masks = met.groupBy("symbol", "span").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    whole = shared.where("NOT several").select("doc", "text_hash", "start", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    names = ["doc", "text_hash", "start", "symbol", "span"]
    mixed = shared.where("several").select(*names).unionByName(hot.select(*names))
    # A span with a large part of all rows has a frequent symbol.
    often = _often(of_hot.where(F.col("times") >= many), "span")
    mixed = _looked_up(mixed, materialise(masks, "masks"), ["symbol", "span"], often).select("doc", "text_hash", "start", "mask")
    return materialise(whole.unionByName(mixed), "repeated")


def _covered(n: int, start: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Words that a repeated window covers."""
    edges = np.zeros(n + 1, np.int64)
    for k in range(64):
        at = start[(mask >> k) & 1 == 1] + k
        edges[at] += 1
        edges[at + window] -= 1
    return np.cumsum(edges[:-1]) > 0


def _parts(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part."""
    at = 0
    while at < len(raw):
        end = min(at + PART_BYTES, len(raw))
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        yield raw[at:end].split()
        at = end


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed, kept_sha256 of every row."""
    return _removed(docs, window, True)


def _removed(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                lists = block.column("ranges")
                own = lists.flatten()
                start, mask = (own.field(c).to_numpy() for c in ("start", "mask"))
                offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                rows = []
                for i, text in enumerate(block.column("text").to_pylist()):
                    a, b = offsets[i], offsets[i + 1]
                    rows.append(_kept(text.encode(), start[a:b], mask[a:b], window, with_text))
                columns = dict(zip(("text", "n_words", "n_removed", "kept_sha256"), map(list, zip(*rows))))
                if not with_text:
                    del columns["text"]
                yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id")} | columns)

    with Scratch(docs.sparkSession) as scratch:
        ranges = repeated_windows(docs, window)
        # A set: repeated rows bring the same ranges.
        of_text = ranges.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "mask")).alias("ranges"))
        rows = _keyed(docs).join(of_text, ["doc", "text_hash"], "left")
        none = F.expr("cast(array() AS array<struct<start: int, mask: bigint>>)")
        rows = rows.select("doc_id", "text", F.coalesce("ranges", none).alias("ranges"))
        text = "text string, " if with_text else ""
        out = materialise(rows.mapInArrow(run, f"doc_id long, {text}n_words long, n_removed long, kept_sha256 string"), "kept", keep=True)
        del scratch
    return out


def _kept(raw: bytes, start: np.ndarray, mask: np.ndarray, window: int, with_text: bool) -> tuple[str, int, int, str]:
    n, removed, digest, text = 0, 0, hashlib.sha256(), []
    gone = _covered(int(start.max()) + 64 + window, start, mask, window) if len(start) else np.zeros(0, bool)
    for words in _parts(raw):
        here = gone[n : n + len(words)]
        n += len(words)
        if here.any():
            stay = np.concatenate([~here, np.ones(len(words) - len(here), bool)])
            removed += len(words) - int(stay.sum())
            words = list(compress(words, stay.tolist()))
        if words:
            part = b" ".join(words)
            digest.update(part if not text else b" " + part)
            text.append(part if with_text else b"")
    return b" ".join(text).decode() if with_text else "", n, removed, digest.hexdigest()


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), WINDOW, False)


def dedup_sql(table: str, window: int = WINDOW) -> str:
    """DuckDB SQL of op11."""
    return rf"""
    WITH rows AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {table}),
    grams AS (SELECT r, i, array_to_string(w[i:i + {window - 1}], ' ') AS g FROM rows, LATERAL (SELECT unnest(range(1, len(w) - {window - 2})) AS i)),
    twice AS (SELECT r, i FROM grams WHERE g IN (SELECT g FROM grams GROUP BY g HAVING count(*) > 1)),
    gone AS (SELECT r, list_distinct(flatten(list(range(i, i + {window})))) AS gone FROM twice GROUP BY r),
    kept AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS k, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM rows LEFT JOIN gone USING (r))
    SELECT doc_id, n::BIGINT AS n_words, k::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept"""


ORACLE = dedup_sql("documents")
