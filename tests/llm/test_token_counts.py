from __future__ import annotations

import math

import public_tokenizers
import regex

from lakeloom.llm import token_counts as tc
from tests.llm.helpers import documents


def count(word: bytes, log_probs):
    """Tokens of the best segmentation, without sharing anything."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(i):
            p = log_probs.get(word[j:i])
            if p is not None:
                score, n = best[j][0] + p, best[j][1] + 1
                if score > best[i][0] or score == best[i][0] and n < best[i][1]:
                    best[i] = (score, n)
    return best[-1][1]


def expected(rows):
    log_probs = tc.read_vocabulary(public_tokenizers.path(tc.VOCABULARY))
    cut = regex.compile(public_tokenizers.PATTERN).findall
    known = {}
    out = []
    for doc_id, text, *_ in rows:
        words = cut(text or "")
        for w in set(words) - known.keys():
            known[w] = count(w.encode(), log_probs)
        out.append((doc_id, len((text or "").encode()), len(words), sum(known[w] for w in words)))
    return sorted(out, key=repr)


def test_the_corpus_against_plain_dynamic_programming(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in tc.count_tokens(docs).collect()), key=repr)
    assert got == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_awkward_texts_and_a_full_trie(spark, monkeypatch):
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "naïve  café 12345\r\n\t x", "en", "a"), (3, "unbelievable " * 20000, "en", "a"), (4, "same", "en", "a"), (4, "same", "en", "a"), (5, "x" * 3000, "en", "a")]
    monkeypatch.setattr(tc, "MAX_NODES", 100)
    got = sorted((tuple(r) for r in tc.count_tokens(documents(spark, rows)).collect()), key=repr)
    assert got == expected(rows)
    assert tc.count_tokens(documents(spark, [])).count() == 0


def test_long_pretokens_stay_out_of_the_trie(monkeypatch):
    import random
    import tracemalloc

    import public_tokenizers

    log_probs = tc.read_vocabulary(public_tokenizers.path(tc.VOCABULARY))
    trie, draw = tc.Trie(log_probs), random.Random(3)
    for n in (1, 5, 300, 4000):
        word = bytes(draw.choice(b"abcdefghtheing \xc3\xa9") for _ in range(n))
        assert trie._alone(word) == trie.count[trie.insert(word)]
    before = len(trie.score)
    long = bytes(draw.choice(b"theingabcd") for _ in range(1 << 20))
    tracemalloc.start()
    n = trie.tokens(long)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0 and len(trie.score) == before and most < 1 << 20
    monkeypatch.setattr(tc, "MAX_NODES", 50)
    small = tc.Trie(log_probs)
    words = [bytes(draw.choice(b"abc") for _ in range(draw.randrange(1, 30))) for _ in range(200)]
    assert [small.tokens(w) for w in words] == [trie.count[trie.insert(w)] for w in words]
    assert len(small.score) < 120
