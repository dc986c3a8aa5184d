from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from lakeloom.llm import token_files as tf
from tests.llm.helpers import documents


def expected(rows):
    tok = Tokenizer.from_file(tf.tokenizer_path())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, tf.END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_matches_whole_text_encoding_on_the_corpus(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    t = pq.read_table(path)
    want = expected(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())))
    got = tf.token_files(spark.read.parquet(path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_awkward_texts(spark):
    rows = [
        (5, None, "en", "a"),
        (3, "", None, None),
        (None, "no id", "en", "a"),
        (9, "<|endoftext|>glued<|startoftext|> and nbsp line\x1cfs\x85nel é é ΣΑΣ İstanbul's we'll 123abc <|STARTOFTEXT|> Ünï! ABC. x\u0301y. ... ²³ Ⅷ. ﬁne! it's. don't's", "en", "a"),
        (4, "word " * 70000, "en", "a"),
        (1, " \n\t ", "en", "a"),
    ]
    got = tf.token_files(documents(spark, rows)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == expected([r[:2] for r in rows])


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "same text", "en", "a")] * 3
    got = sorted(tuple(r) for r in tf.token_files(documents(spark, rows)).collect())
    assert got == expected([r[:2] for r in rows])
    assert tf.token_files(documents(spark, [])).count() == 0


def test_any_string_as_whole_texts():
    """Strings of all scripts, marks and special tokens, against the tokenizer on the whole text."""
    pieces = ["İ", "İ.", "J\u030c", "j\u030c", "I\u0307", "K\u0338", "e\u0301", "\u0301", "'s", "'S", "'", "don't", "WE'LL", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "a", "B", "ß", "ﬁ", "ǅ", "Σ", "ΑΣ", "Й", "и\u0306", "ё!", "中文", "日本。", "한국", "\u1112\u1161\u11ab", "ไทย", "हिन्दी", "שלום", "عربي", "٣", "½", "²", "Ⅷ", "𝒳", "😀", "👨\u200d👩", "\u200d", "\u00a0", "\u2028", "\u3000", "\x1c", "\x85", "\x00", "\ufffd", "ǰ.", "...", "?!", "-", "_", "12", "x1", ",", "(é)", "ſ", "K", "Å", "Ω"]
    spaces = ["", "", "", " ", "\n", "\t", "  ", "\x0b", "\r\n"]
    r = random.Random(11)
    texts = ["".join(r.choice(pieces) + r.choice(spaces) for _ in range(r.randrange(1, 14))) for _ in range(20000)]
    texts += ["".join(chr(r.choice([r.randrange(0x20, 0x250), r.randrange(0x250, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(r.randrange(1, 20))) for _ in range(20000)]
    texts += ["\tİ.\n'\u2028", "İ.", "J\u030c j\u030c"]
    tok, encoder = Tokenizer.from_file(tf.tokenizer_path()), tf.TextEncoder(tf.tokenizer_path())
    assert encoder.by_words
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        want = [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(c, encoder.dtype).tolist() for c in encoder.encode(part)] == want


def test_another_tokenizer_encodes_whole_texts():
    path = tf.tokenizer_path("byte_bpe_50k.json")
    tok, encoder = Tokenizer.from_file(path), tf.TextEncoder(path)
    assert not encoder.by_words
    texts = ["Two words, and  spaces.\n", "", None, "İ. don't"]
    assert [np.frombuffer(c, encoder.dtype).tolist() for c in encoder.encode(texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_files_are_cut_by_bytes_and_read_by_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tf, "PART_BYTES", 400)
    rows = [(i, f"document {i} " * 20, "en", "a") for i in range(40)]
    manifest = tf.write_token_files(documents(spark, rows), f"file://{tmp_path}/t", tf.tokenizer_path())
    assert manifest.count() > 8
    got = sorted(tuple(r) for r in tf.read_token_files(manifest).collect())
    assert got == expected([r[:2] for r in rows])
    r = manifest.first()
    other = tf.pafs.SubTreeFileSystem(str(tmp_path / "t"), tf.pafs.LocalFileSystem())
    ranged = tf._File(other, f"{r['part']}.ids.bin", r["dtype"])
    local = tf._File(tf.pafs.LocalFileSystem(), f"{tmp_path}/t/{r['part']}.ids.bin", r["dtype"])
    assert ranged.values is None and ranged.length == local.length == r["n_ids"]
    assert ranged[3:9].tolist() == local[3:9].tolist() and ranged[0 : r["n_ids"]].tolist() == local[0 : r["n_ids"]].tolist()


def test_generations_of_words_change_no_ids(monkeypatch):
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["hot", "Word,", f"w{draw.randrange(300)}", "çé!", "<|x"]) for _ in range(draw.randrange(60))) for _ in range(200)]
    monkeypatch.setattr(tf, "CACHED_WORDS", 40)
    encoder = tf.TextEncoder(tf.tokenizer_path())
    got = [e for i in range(0, len(texts), 7) for e in encoder.encode(texts[i : i + 7])]
    assert got == encoder._whole(texts)
    assert len(encoder.known) + len(encoder.before) < 400
