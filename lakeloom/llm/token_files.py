"""Token ids as flat unsigned-integer files with 64-bit document offsets.

Format: documents in ascending doc_id order (nulls first, then by a hash of the
text) are range-partitioned; partition p is three little-endian files under one
folder: ``p.ids.bin`` (uint16 if every id fits, else uint32), ``p.offsets.bin``
(int64, one more than documents, from 0) and ``p.docs.bin`` (int64 doc_ids, the
smallest int64 for null).  A document's place in the whole corpus is its
partition's base plus its own offset; bases are prefix sums of the partitions'
sizes.  Files are memory-mapped where the store is local and read by ranges elsewhere.
Partitions hold about ``PART_BYTES`` of text at most, however much there is.

A task writes under a name of its own and moves the finished files to their
final names, so a repeated or speculative task replaces them by the same bytes.

Cases: a null or empty text is the end id alone; repeated rows are written as
often as they occur; an empty table has no files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import scratch_path, text_documents
from lakeloom.llm.textkernels import text_blocks

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
NULL_ID = np.iinfo(np.int64).min
#: Text of one partition, about; a task also holds 16 bytes a document of it.
PART_BYTES = 256 << 20
#: Words whose ids a worker keeps at once.
CACHED_WORDS = 800_000


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What the tokenizer file must say for texts to be encoded word by word.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(settings: dict) -> bool:
    """Whether a text's ids are those of its words between ASCII white space.

    So it is if the tokenizer composes characters, joins white space, lower-cases,
    cuts by ``PATTERN`` (no match has white space in it), marks the last token of
    each cut, and matches special tokens without white space on the raw text.
    """
    normalizer, cut, model = (settings.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    parts = normalizer.get("normalizers") or []
    cuts = cut.get("pretokenizers") or []
    return (
        [p["type"] for p in parts] == NORMALIZERS
        and (parts[1]["pattern"], parts[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": PATTERN}
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not model.get("dropout")
        and settings.get("truncation") is settings.get("padding") is None
        and all("<|" in t["content"] and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in settings.get("added_tokens") or [])
    )


class TextEncoder:
    """Encodes texts exactly as the tokenizer does.

    Where the tokenizer allows it (``by_words``), each distinct word is encoded
    once and kept.  Words whose normalised form is letters alone are one cut
    each, so many are encoded in one call and told apart by the mark of their last
    token; closing ASCII marks after such a word are a cut of their own.  All other
    words are encoded one by one, and texts whole with any other tokenizer.

    Where each merge makes the next id (``_merges_in_order``), words of letters go
    through a quicker encoder with the same merges: a cut with the end mark as one more
    byte, which merges with the byte before it first.
    """

    #: Closing marks: a run of them after letters is encoded alone.
    MARKS = b".,;:!?#*$%&|()[]{}=+/-_~"
    #: Words of letters that are encoded in one call.
    TOGETHER = 100
    #: Letters up to here (Latin, Greek, Cyrillic) are letters in every version of Unicode at hand.
    LAST_LETTER = "\u0523"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            settings = json.load(f)
        self.by_words = by_words(settings)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.quick = _quick_encoder(settings) if self.by_words else None
        # Words used since the last change of generations, and those of the generation before.
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    @staticmethod
    def _words(text: str | None) -> list[bytes]:
        """Words between ASCII white space, with a-z for A-Z unless that could make a special token."""
        raw = (text or "").encode()
        if b"<|" in raw:
            return raw.split()
        if b"\xcc" in raw or b"\xcd" in raw:
            # A capital before a combining mark (U+0300 to U+036F) is composed differently than a small letter.
            return [w.lower() if w.isascii() else w for w in raw.split()]
        return raw.lower().split()

    def _normal(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Of words of letters alone, what the tokenizer's normaliser makes of them; many are normalised in one call."""
        out = {w: w.lower() for w in words if w.isalpha()}  # of bytes: ASCII letters
        other = [(w, t) for w in words if w not in out and not w.isascii() and (t := w.decode()).isalpha()]
        for i in range(0, len(other), 10_000):
            part = other[i : i + 10_000]
            normal = self.tokenizer.normalizer.normalize_str(" ".join([t for _, t in part])).split(" ")
            if len(normal) == len(part):
                out.update([(w, n.encode()) for (w, _), n in zip(part, normal) if n.isalpha() and max(n) <= self.LAST_LETTER])
        return out

    def _learn(self, new: list[bytes]) -> None:
        known, marks = self.known, self.MARKS
        cut = [w.rstrip(marks) for w in new]
        normal = self._normal({*cut})
        letters = [w for w in normal if w not in known]
        size, end_of = self.dtype.itemsize, self.ends_word
        together = self.TOGETHER if self.quick is None else 100 * self.TOGETHER
        groups = [letters[i : i + together] for i in range(0, len(letters), together)]
        for group, ids in zip(groups, self._ids_of_groups([[normal[w] for w in g] for g in groups])):
            ends = ((np.flatnonzero(end_of[ids]) + 1) * size).tolist()
            if len(ends) == len(group):
                raw = ids.tobytes()
                known.update(zip(group, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        marked = [(w, stem) for w, stem in zip(new, cut) if len(w) > len(stem) and stem in normal and stem in known]
        self._learn_plainly(list({w[len(stem) :] for w, stem in marked}.difference(known)))
        known.update([(w, known[stem] + known[w[len(stem) :]]) for w, stem in marked])
        self._learn_plainly([w for w in new if w not in known])

    def _ids_of_groups(self, groups: list[list[bytes]]) -> Iterator[np.ndarray]:
        """The ids of each group's words of letters, one after another."""
        if self.quick is None:
            for e in self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False):
                yield np.array(e.ids, self.dtype)
        else:
            for g in groups:
                yield np.array(self.quick.encode_ordinary(END_MARK.join([*(w.decode() for w in g), ""])), self.dtype)

    def _learn_plainly(self, words: list[bytes]) -> None:
        self.known.update(zip(words, self._whole([w.decode() for w in words])))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``."""
        if not self.by_words:
            return self._whole([t or "" for t in texts])
        words = [self._words(t) for t in texts]
        if len(self.known) > CACHED_WORDS // 2:
            # Words in use come back from the older generation; the others go with it.
            self.before, self.known = self.known, {}
        new = set().union(*words).difference(self.known)
        again = new.intersection(self.before)
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        self._learn(list(new.difference(again)))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]


#: Stands for the mark of a word's end in the quick encoder; no word of letters has it.
END_MARK = "\0"


def _merges_in_order(model: dict) -> bool:
    """Whether ids are bytes, bytes at a word's end, then the merges one by one."""
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return len(set(model["vocab"].values())) == len(model["vocab"]) and [model["vocab"].get(a + b) for a, b in pairs] == list(range(512, 512 + len(pairs)))


def _quick_encoder(settings: dict):
    """A byte-pair encoder with the tokenizer's merges, or None.

    It joins two neighbours whenever their bytes are a token's.  That is the same as
    merging listed pairs in order: once all merges of lower rank are done, neighbours that
    make up a token are what the token itself is made of by them, its listed pair.
    """
    import tiktoken

    model = settings["model"]
    if not _merges_in_order(model):
        return None
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {}
    for token, i in model["vocab"].items():
        if i >= 512 + len(model["merges"]):  # special tokens
            continue
        own = token.removesuffix("</w>")
        raw = bytes(byte_of[c] for c in own)
        if b"\0" not in raw or (len(raw) == 1 and own == token):
            ranks[raw + END_MARK.encode() * (own != token)] = i
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _encoder(path: str) -> TextEncoder:
    """One a worker process: the words it has met serve its next tasks."""
    return TextEncoder(path)


_MANIFEST = "part long, folder string, dtype string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns the manifest: a row a partition with its ``base``."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = _encoder(vocabulary)
        fs, root = pafs.FileSystem.from_uri(folder)
        own = f"{root}/{part}-{uuid.uuid4().hex}"
        end = np.array([end_id], encoder.dtype).tobytes()
        lengths, ids, out = [], [], None
        for batch in batches:
            for block in text_blocks(batch, "text"):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{own}.ids")
                coded = encoder.encode(block.column(1).to_pylist())
                lengths.append(np.array([len(c) // encoder.dtype.itemsize + 1 for c in coded], np.int64))
                ids.append(block.column(0).fill_null(int(NULL_ID)).to_numpy())
                out.write(end.join([*coded, b""]))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        for kind, values in (("offsets", offsets), ("docs", np.concatenate(ids).astype("<i8"))):
            with fs.open_output_stream(f"{own}.{kind}") as f:
                f.write(values.tobytes())
        for kind in ("ids", "offsets", "docs"):
            to = f"{root}/{part}.{kind}.bin"
            if fs.type_name != "local" and fs.get_file_info(to).type != pafs.FileType.NotFound:
                fs.delete_file(to)
            fs.move(f"{own}.{kind}", to)
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "folder": [folder], "dtype": [encoder.dtype.str], "n_docs": [len(offsets) - 1], "n_ids": [int(offsets[-1])]}
        )

    rows = text_documents(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    manifest = sorted(placed.mapInArrow(write, _MANIFEST).collect(), key=lambda r: r["part"])  # a row a partition
    bases = np.concatenate([[0], np.cumsum([r["n_ids"] for r in manifest])]).astype(int).tolist()
    return spark.createDataFrame([(*r, b) for r, b in zip(manifest, bases)], f"{_MANIFEST}, base long")


class _File:
    """A flat file of numbers: memory-mapped where the store is local, read by ranges elsewhere."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        if fs.type_name == "local":
            self.length = os.path.getsize(path) // self.dtype.itemsize
            self.values = np.memmap(path, self.dtype, "r") if self.length else np.zeros(0, self.dtype)
        else:
            self.values, self.source = None, fs.open_input_file(path)
            self.length = self.source.size() // self.dtype.itemsize

    def __getitem__(self, own: slice) -> np.ndarray:
        low, high, _ = own.indices(self.length)
        if self.values is not None:
            return np.asarray(self.values[low:high])
        self.source.seek(low * self.dtype.itemsize)
        return np.frombuffer(self.source.read(max(0, high - low) * self.dtype.itemsize), self.dtype)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, root = pafs.FileSystem.from_uri(r["folder"])
                ids, offsets, docs = (_File(fs, f"{root}/{r['part']}.{k}.bin", d) for k, d in (("ids", r["dtype"]), ("offsets", "<i8"), ("docs", "<i8")))
                for a in range(0, docs.length, 4096):
                    at, own = offsets[a : a + 4097], docs[a : a + 4096]
                    sums = [_crc32(ids, i, j) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(own, pa.int64(), mask=own == NULL_ID),
                            "start": pa.array(at[:-1] + r["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(at), pa.int64()),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        }
                    )

    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _crc32(ids: _File, low: int, high: int) -> int:
    """Of ids low to high as little-endian unsigned 32-bit integers, a slice at a time."""
    crc = 0
    for i in range(low, high, 1 << 20):
        crc = zlib.crc32(ids[i : min(high, i + (1 << 20))].astype("<u4").tobytes(), crc)
    return crc


def token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' token files to the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens", keep=True)
    return read_token_files(write_token_files(docs, folder, vocabulary or tokenizer_path(), end_id))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the written files, a row a document.

    Null and empty texts are the end id alone, rows without doc_id come first,
    repeated rows are written as often as they occur; an empty table gives no rows.
    """
    return token_files(docs)
