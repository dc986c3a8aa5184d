import hashlib
from collections import Counter, defaultdict

import pytest

from lakeloom.llm import token_alignment
from lakeloom.llm.token_alignment import VOCABULARY_A, VOCABULARY_B, op12_token_alignment, tokenizer_path

NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _tokens(texts):
    """Ids with bytes of whole texts, by the two libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(VOCABULARY_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(VOCABULARY_B))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    for text in texts:
        if not text:
            yield [], []
            continue
        ids_a = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        ids_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        yield (ids_a, ids_b) if b"".join(x[1] for x in ids_a) == whole == b"".join(x[1] for x in ids_b) else ([], [])


def _spans(tokens):
    at, out = 0, []
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def brute(rows):
    held, every = defaultdict(int), []
    for a, b in _tokens([t for _, t in rows]):
        a, b = _spans(a), _spans(b)
        links = Counter((i, j) for i, s, e in a for j, u, v in b if s < v and u < e)
        for pair in links:
            held[pair] += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [",".join(str(i) for i, _, e in a if low < e <= high) + "|" + ",".join(str(i) for i, _, e in b if low < e <= high) for low, high in zip([0, *cuts], cuts)]
        every.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, every):
        n_best = sum(n for (i, j), n in links.items() if held[i, j] == best[i])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), n_best, sum(n * held[p] for p, n in links.items()), digest))
    return out


def _key(row):
    return tuple((x is not None, x) for x in row)


def _same(spark, df, rows):
    got = [tuple(r[c] for c in NAMES) for r in df.collect()]
    assert sorted(got, key=_key) == sorted(brute(rows), key=_key)


AWKWARD = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "\n"), (6, "plain words here"), (6, "plain words here"), (7, "two  spaces   three \n\n four\t five "), (None, "no id"), (8, "trailing  "),
    (9, "  leading"), (10, "a▁b has the mark"), (11, "<|endoftext|> <s> </s> <unk> <0x41>"), (12, "café 你好世界 \U0001f600\U0001f680 é"),
    (13, "x\x00y \x1c z \x85 w　v u"), (14, "don't we'll I'm 12345 3.14 ###!!"), (15, "a" * 3000), (16, "word " * 500), (17, "نص اختباری ไทย"), (18, "▁"),
    (19, "line one\nline two\r\n  line three\n \n end"), (20, "﻿bom ​ zero ‮ rtl"),
]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, TEXT string, pairs int")


def test_awkward_rows_equal_brute_force(spark):
    _same(spark, token_alignment.token_alignment(_frame(spark, AWKWARD)), AWKWARD)


def test_blocks_of_pairs_and_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_PAIRS", 40)
    _same(spark, token_alignment.token_alignment(_frame(spark, AWKWARD)), AWKWARD)


def test_small_slices_and_a_small_cache(monkeypatch):
    texts = [t for _, t in AWKWARD]
    paths = tokenizer_path(VOCABULARY_A), tokenizer_path(VOCABULARY_B)
    whole = token_alignment.Aligner(*paths).block(texts)
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 7)
    monkeypatch.setattr(token_alignment, "CACHED_STRETCHES", 10)
    aligner = token_alignment.Aligner(*paths)
    for _ in range(3):
        got = aligner.block(texts)
        assert {k: v.to_pylist() for k, v in got.items()} == {k: v.to_pylist() for k, v in whole.items()}


def test_empty_table(spark):
    assert token_alignment.token_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert token_alignment.token_alignment(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]["groups_sha256"] == ""


@pytest.mark.parametrize("alphabet", ["ab \n.'", "é́ 你\U0001f600a ", "\x1c\x85   ax\t", "st'lr dve 09#٠²"])
def test_stretches_equal_whole_texts(alphabet):
    import random

    draw = random.Random(7)
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 30))) for _ in range(1500)]
    got = token_alignment.Aligner(tokenizer_path(VOCABULARY_A), tokenizer_path(VOCABULARY_B)).block(texts)
    want = list(_tokens(texts))
    assert got["n_a"].to_pylist() == [len(a) for a, _ in want]
    assert got["n_b"].to_pylist() == [len(b) for _, b in want]
    digests = [r[-1] for r in brute(list(enumerate(texts)))]
    assert got["groups_sha256"].to_pylist() == digests


def test_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, (t or "")[:600]) for i, t in rows]
    _same(spark, token_alignment.token_alignment(_frame(spark, short)), short)
    assert op12_token_alignment(spark, "/root/testdata/sf0.001").count() == len(rows)
