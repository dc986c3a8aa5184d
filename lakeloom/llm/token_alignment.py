"""Alignment of two tokenizers' tokens of the same texts, and how often their ids meet.

A is a byte-level BPE, B a sentencepiece BPE with byte fallback; both cut the bytes
of a space and the text.  A block of texts is concatenated, the ends of A's and of
B's tokens are counted once by byte (``bincount``), and the block is cut where both
end; prefix sums of these marks give the group of each token, the tokens it
overlaps, and by differences at the documents' offsets each document's own counts.

1. One pass over the texts: digests, and each document's linked id pairs.
2. The documents of each pair are counted by a shuffle on the pair.
3. The counts are cut into blocks of A ids (``BLOCK_PAIRS`` pairs at most, and one A
   id's), a block is broadcast, and a pass over the pairs of step 1 adds up its share
   of each document's sums, which are sums over links.  Most corpora have one block.

Encoding: both tokenizers never join bytes across a space that stands between a
character other than a space and one that isn't white space (checked in their
files), so each distinct stretch between such places is encoded once and kept, over
the tasks of a worker.  A text in which one stretch's token bytes differ from its own
is encoded whole.

Cases: null and empty texts, and texts whose joined token bytes differ from space and
text, have zeros and an empty digest; each row counts as a document, repeated rows
and rows without doc_id too; an empty table gives no rows; other columns are ignored.
A text of any length is worked through in slices of ``SLICE_BYTES``, save one that
has no place to cut it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, materialise, text_documents
from lakeloom.llm.textkernels import text_blocks

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Stretches a worker keeps; beyond, the half used least often goes.
CACHED_STRETCHES = 400_000
SLICE_BYTES = 4 << 20
#: Pairs of one broadcast (16 bytes each).
BLOCK_PAIRS = 4_000_000
_CUT = re.compile(r"(?<=[^ ])(?= \S)")
#: ASCII without separators, and letters of long standing: alike in every version of Unicode.
_PLAIN = re.compile("[\\x00-\\x1b !-~\xc0-\xd6\xd8-\xf6\xf8-ȳΑ-ΡΣ-ώА-я]*")
_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 stands for itself, the other bytes in order for U+0100 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A: encodes one string; ``pieces`` are the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        of = _byte_of()
        vocabulary = self.exact.get_vocab(with_added_tokens=False)
        added = {t["content"] for t in settings["added_tokens"]}
        ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        self.pieces = [b""] * (max(self.exact.get_vocab(with_added_tokens=True).values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        cut, model = settings["pre_tokenizer"], settings["model"]
        merges = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        #: Cut before a space by the usual pattern, merges in the order of their ids.
        self.in_stretches = (
            settings["normalizer"] is None and settings["truncation"] is settings["padding"] is None and cut["type"] == "ByteLevel" and not cut["add_prefix_space"] and cut["use_regex"]
            and model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"] and not model["ignore_merges"]
        )
        # The same merges by a quicker encoder, for characters that both class alike.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if self.in_stretches and merges == sorted(merges) else None

    def encode(self, text: str) -> list[int]:
        if self.quick is not None and _PLAIN.fullmatch(text):
            return self.quick.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


class Pieces:
    """B: encodes a string that begins with the space which the tokenizer itself adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in ids]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, names)]
        self.in_stretches = not any(re.search("[^▁]▁", p) for p in names)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text[1:])


class Side:
    """One tokenizer's ids of the kept stretches, one after another: those of stretch i are first[i] to first[i + 1]."""

    def __init__(self, encoder: ByteLevel | Pieces):
        self.encoder = encoder
        self.size = np.array([len(p) for p in encoder.pieces], np.int64)
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def of_stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each stretch has.  Those that end in white space are encoded alone, the others as one string."""
        got: list[list[int]] = [[]] * len(stretches)
        plain = [i for i, s in enumerate(stretches) if not s[-1].isspace()]
        for a in range(0, len(plain), 2000):
            own = plain[a : a + 2000]
            ids = self.encoder.encode("".join([stretches[i] for i in own]))
            ends = np.cumsum([len(stretches[i].encode()) for i in own])
            reached = np.cumsum(self.size[ids])
            at = np.searchsorted(reached, ends) + 1
            if len(ids) and reached[-1] == ends[-1] and (reached[at - 1] == ends).all():
                for i, b, e in zip(own, [0, *at.tolist()], at.tolist()):
                    got[i] = ids[b:e]
            else:
                for i in own:
                    got[i] = self.encoder.encode(stretches[i])
        for i in set(range(len(stretches))).difference(plain):
            got[i] = self.encoder.encode(stretches[i])
        counts = np.array([len(g) for g in got], np.int64)
        return np.array([t for g in got for t in g], np.int32), counts

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join([self.encoder.pieces[i] for i in ids])

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches at these places, and the count of each."""
        counts = self.first[at + 1] - self.first[at]
        places = np.arange(counts.sum()) + np.repeat(self.first[at] - (np.cumsum(counts) - counts), counts)
        return self.ids[places], counts


class Aligner:
    """Both tokenizers with the stretches that this worker has met."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Side(ByteLevel(path_a)), Side(Pieces(path_b))
        self.in_stretches = self.a.encoder.in_stretches and self.b.encoder.in_stretches
        self.known: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.used = np.zeros(0, np.int64)
        decimal = [b"%d" % i for i in range(max(len(self.a.size), len(self.b.size)))]
        # An id and what follows it: by side, then by whether its group's tokens of this side go on.
        self.words = [t for n, last in ((len(self.a.size), b"|"), (len(self.b.size), b";")) for sep in (b",", last) for t in [d + sep for d in decimal[:n]]]

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        (ids_a, n_a), (ids_b, n_b) = self.a.of_stretches(new), self.b.of_stretches(new)
        raw = [s.encode() for s in new]
        sizes = np.array([len(r) for r in raw])
        good = np.ones(len(new), bool)
        for side, ids, n in ((self.a, ids_a, n_a), (self.b, ids_b, n_b)):
            ends = np.cumsum(n)
            reached = np.concatenate([[0], np.cumsum(side.size[ids])])
            good &= reached[ends] - reached[ends - n] == sizes
            if side.bytes_of(ids.tolist()) != b"".join(raw):
                good &= [side.bytes_of(ids[e - k : e].tolist()) == r for e, k, r in zip(ends.tolist(), n.tolist(), raw)]
            side.add(ids, n)
        self.known.update(zip(new, range(len(self.good), len(self.good) + len(new))))
        self.good = np.concatenate([self.good, good])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])

    def _forget(self) -> None:
        """Keeps the half of the stretches that was used most often."""
        if len(self.known) <= CACHED_STRETCHES:
            return
        keep = np.sort(np.argpartition(-self.used, CACHED_STRETCHES // 2)[: CACHED_STRETCHES // 2])
        for side in (self.a, self.b):
            ids, counts = side.take(keep)
            side.ids, side.first = ids, np.concatenate([[0], np.cumsum(counts)])
        place = np.full(len(self.good), -1)
        place[keep] = np.arange(len(keep))
        self.known = {s: p for s, i in self.known.items() if (p := int(place[i])) >= 0}
        self.good, self.used = self.good[keep], self.used[keep] // 2

    def block(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """The columns of a block of texts."""
        self._forget()
        cut = [_CUT.split(" " + t) if t and self.in_stretches else [] for t in texts]
        self._learn(list(set().union(*cut).difference(self.known)))
        of = self.known.__getitem__
        counts = np.array([len(c) for c in cut], np.int64)
        at = np.fromiter((i for c in cut for i in map(of, c)), np.int64, counts.sum())
        np.add.at(self.used, at, 1)
        doc = np.repeat(np.arange(len(texts)), counts)
        whole = np.bincount(doc[~self.good[at]], minlength=len(texts)) > 0
        if not self.in_stretches:
            whole = np.array([bool(t) for t in texts])
        keep = ~whole[doc]
        out = _Sums(len(texts), len(self.a.size), len(self.b.size), self.words)
        for own_doc, own in _slices(doc[keep], at[keep], self.a):
            ids_a, n_a = self.a.take(own)
            ids_b, n_b = self.b.take(own)
            out.add(np.repeat(own_doc, n_a), ids_a, self.a.size[ids_a], np.repeat(own_doc, n_b), ids_b, self.b.size[ids_b])
        for i in np.flatnonzero(whole).tolist():
            text = " " + texts[i]
            ids_a, ids_b = self.a.encoder.encode(text), self.b.encoder.encode(text)
            if self.a.bytes_of(ids_a) == text.encode() == self.b.bytes_of(ids_b):
                ids_a, ids_b = np.array(ids_a, np.int32), np.array(ids_b, np.int32)
                out.add(np.full(len(ids_a), i), ids_a, self.a.size[ids_a], np.full(len(ids_b), i), ids_b, self.b.size[ids_b])
        return out.columns()


def _slices(doc: np.ndarray, at: np.ndarray, side: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of stretches of about ``SLICE_BYTES``: both tokenizers end a token where a stretch ends."""
    sizes = np.concatenate([[0], np.cumsum(side.size[side.ids])])[side.first]
    ends = np.cumsum((sizes[1:] - sizes[:-1])[at])
    a = 0
    while a < len(at):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield doc[a:b], at[a:b]
        a = b


class _Sums:
    """What slices of a block add to its documents."""

    def __init__(self, n: int, n_ids_a: int, n_ids_b: int, words: list[bytes]):
        self.n, self.n_ids_a, self.n_ids_b, self.words = n, n_ids_a, n_ids_b, words
        self.counts = np.zeros((4, n), np.int64)  # A tokens, B tokens, groups, links
        self.digest: list = [None] * n
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_a: np.ndarray, ids_a: np.ndarray, size_a: np.ndarray, doc_b: np.ndarray, ids_b: np.ndarray, size_b: np.ndarray) -> None:
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        total = int(end_a[-1])
        mark_a, mark_b = np.bincount(end_a, minlength=total + 1), np.bincount(end_b, minlength=total + 1)
        groups = np.cumsum((mark_a > 0) & (mark_b > 0))  # groups that end at this byte or before
        before_b = np.cumsum(mark_b)
        group_a, group_b = groups[end_a - 1], groups[end_b - 1]
        # The B tokens that hold an A token's first and last byte, and all between.
        low = before_b[end_a - size_a]
        n_links = before_b[end_a - 1] - low + 1
        of_a = np.repeat(np.arange(len(ids_a)), n_links)
        of_b = np.arange(len(of_a)) + np.repeat(low - (np.cumsum(n_links) - n_links), n_links)
        key = doc_a[of_a] * (self.n_ids_a * self.n_ids_b) + ids_a[of_a].astype(np.int64) * self.n_ids_b + ids_b[of_b]
        self.links.append(np.unique(key, return_counts=True))

        first = np.ones(len(ids_a), bool)
        first[1:] = group_a[1:] != group_a[:-1]
        self.counts[0] += np.bincount(doc_a, minlength=self.n)
        self.counts[1] += np.bincount(doc_b, minlength=self.n)
        self.counts[2] += np.bincount(doc_a[first], minlength=self.n)
        self.counts[3] += np.bincount(doc_a, n_links, self.n).astype(np.int64)

        # In order of groups, a group's A tokens before its B tokens.
        n_groups = int(groups[-1])
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        place_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
        last_a, last_b = np.roll(first, -1), np.ones(len(ids_b), bool)
        last_b[:-1] = group_b[1:] != group_b[:-1]
        word = np.empty(len(ids_a) + len(ids_b), np.int64)
        word[place_a] = ids_a + last_a * self.n_ids_a
        word[place_b] = 2 * self.n_ids_a + ids_b + last_b * self.n_ids_b
        text = list(map(self.words.__getitem__, word.tolist()))
        a = 0
        own, sizes = np.unique(doc_a, return_counts=True)
        sizes = sizes + np.bincount(doc_b, minlength=self.n)[own]
        for i, k in zip(own.tolist(), sizes.tolist()):
            part = b"".join(text[a : a + k])[:-1]
            a += k
            if self.digest[i] is None:
                self.digest[i] = hashlib.sha256(part)
            else:
                self.digest[i].update(b";" + part)

    def columns(self) -> dict[str, pa.Array]:
        key, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.links) if self.links else ([], [])))
        if len(self.links) > 1:  # a document may be in several slices
            key, at = np.unique(key, return_inverse=True)
            times = np.bincount(at, times, len(key)).astype(np.int64)
        doc, pair = np.divmod(key, self.n_ids_a * self.n_ids_b)
        first = np.searchsorted(doc, np.arange(self.n + 1))
        names = ["n_a", "n_b", "n_groups", "n_links"]
        return {k: pa.array(v) for k, v in zip(names, self.counts)} | {
            "groups_sha256": pa.array(["" if d is None else d.hexdigest() for d in self.digest], pa.string()),
            "pairs": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(pair)),
            "times": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(times)),
        }


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker process: what it has learnt serves its next tasks."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked ``pairs`` (A id times the number of B ids, plus B id) with the ``times`` of each."""
    path_a, path_b = path_a or tokenizer_path(VOCABULARY_A), path_b or tokenizer_path(VOCABULARY_B)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for block in text_blocks(batch, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": block.column(0)} | aligner.block(block.column(1).to_pylist()))

    return text_documents(docs).mapInArrow(run, f"{_COLUMNS}, pairs array<bigint>, times array<bigint>")


def _blocks(counts: DataFrame, n_ids_b: int) -> list[tuple[int, int]]:
    """Ranges of A ids with ``BLOCK_PAIRS`` pairs at most, or one id's."""
    sizes = counts.groupBy(F.expr(f"pair div {n_ids_b}").alias("a")).count().orderBy("a").collect()  # a row an id of the vocabulary
    out: list[tuple[int, int]] = []
    low, held = 0, 0
    for r in sizes:
        if held and held + r["count"] > BLOCK_PAIRS:
            out.append((low, r["a"]))
            low, held = r["a"], 0
        held += r["count"]
    return [*out, (low, sizes[-1]["a"] + 1)] if sizes else []


def _sums(rows: DataFrame, counts: DataFrame, low: int, high: int, n_ids_b: int) -> DataFrame:
    """n_best and count_sum over the links of A ids low to high, beside the other columns of the rows."""
    own = counts.where(f"pair >= {low * n_ids_b} AND pair < {high * n_ids_b}").toArrow()
    pair, count = (own.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, count = pair[order], count[order]
    a = pair // n_ids_b
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    best = count == np.repeat(np.maximum.reduceat(count, new), np.diff([*new, len(a)]))
    block = rows.sparkSession.sparkContext.broadcast((pair, count, best))
    names = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = block.value
        for batch in batches:
            lists = batch.column("pairs")
            first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            own, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            inside = (own >= pair[0]) & (own <= pair[-1])
            at = np.searchsorted(pair, np.where(inside, own, pair[0]))
            times = times * inside
            sums = [np.concatenate([[0], np.cumsum(times * v[at])]) for v in (best, count)]
            columns = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array(s[first[1:]] - s[first[:-1]]) for c, s in zip(("n_best", "count_sum"), sums)})

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "n_best long, count_sum long"]))


def token_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    n_ids_b = len(Pieces(path_b or tokenizer_path(VOCABULARY_B)).pieces)
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    with Scratch(spark):
        rows = materialise(aligned(docs, path_a, path_b).withColumn("_row", F.monotonically_increasing_id()), "aligned", keep=True)
        counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
        counts = materialise(counts, "pairs")
        blocks = _blocks(counts, n_ids_b)
        if len(blocks) == 1:
            return _sums(rows.drop("_row"), counts, *blocks[0], n_ids_b)
        out = rows.select(*names, "_row")
        if not blocks:
            return out.drop("_row").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
        sums = None
        for low, high in blocks:
            own = _sums(rows.select("_row", "pairs", "times"), counts, low, high, n_ids_b)
            sums = own if sums is None else sums.unionByName(own)
        sums = sums.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        return out.join(sums, "_row").drop("_row")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
