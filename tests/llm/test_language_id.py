from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lakeloom.llm import language_id as li
from tests.llm.helpers import by_id, documents


def codes(text):
    return [0x20] * li.ORDER + list(text.encode())


def plain_length(texts, text):
    """Code length of a text under the frozen counts of ``texts``, one context after another."""
    counts, contexts = Counter(), {}
    for t in texts:
        c = codes(t)
        for i in range(li.ORDER, len(c)):
            for order in range(li.ORDER + 1):
                counts[tuple(c[i - order : i + 1])] += 1
    for run, n in counts.items():
        total, distinct = contexts.get(run[:-1], (0, 0))
        contexts[run[:-1]] = (total + n, distinct + 1)
    bits, c = 0.0, codes(text)
    for i in range(li.ORDER, len(c)):
        for order in range(li.ORDER, -1, -1):
            run = tuple(c[i - order : i + 1])
            if run[:-1] not in contexts:
                continue
            total, distinct = contexts[run[:-1]]
            if run in counts:
                bits -= math.log2(counts[run] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def model_of(sent):
    table = sent.value
    return li.Model(table["lang"].to_numpy(), table["run"].to_numpy(), table["n"].to_numpy())


TEXTS = {"en": ["the cat sat on the mat and the hat", "then that other thing is there"], "fr": ["le chat est sur la table et il dort", "être là où l'été naît, c'est beau"]}


def training(n=0):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2]
    return [(ids.pop(), t, lang, "a") for lang, ts in TEXTS.items() for t in ts]


def test_code_lengths_against_plain_contexts(spark):
    (sent,) = li.train(documents(spark, training()))
    model = model_of(sent)
    tests = ["the hat is there", "là est le chat", "zebra 123 !?", "xyz é", "a", "", "Ω 中文 the"]
    got = model.lengths(pa.array(tests))
    for row, text in zip(got, tests):
        for value, lang in zip(row, model.langs):
            assert math.isclose(value, plain_length(TEXTS[lang], text), rel_tol=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = li.op9_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r["held_out"] and len(truth[r["doc_id"]][1].split()) >= 5]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    share = sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in out) / len(out)
    print("held-out accuracy", share)
    assert share >= 0.97


def test_awkward_rows(spark):
    rows = training() + [(2000, None, "en", "a"), (2001, "", "en", "a"), (2002, "123 !?", "fr", "a"), (None, "the cat", "en", "a"), (2003, "the cat " * 30000, None, None), (2004, "中文", None, "a"), (2004, "中文", None, "a")]
    docs = documents(spark, rows)
    got = li.predict(docs, li.train(docs)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = by_id(docs.sparkSession.createDataFrame(got))
    assert [by[i]["lang_pred"] for i in (2000, 2001, 2002)] == ["und"] * 3 and by[2000]["score"] == 0
    assert by[2003]["lang_pred"] == "en" and by[2004]["lang_pred"] in TEXTS and by[None]["held_out"] is False
    untaught = documents(spark, [(1, "text", None, "a")])
    assert li.predict(untaught, li.train(untaught)).first()["lang_pred"] == "und"
    assert li.predict(documents(spark, []), li.train(documents(spark, []))).count() == 0


ALPHABETS = [(0x61, 26), (0x3B1, 24), (0x430, 32), (0x5D0, 26), (0x627, 28), (0x905, 40), (0xE01, 40), (0x10D0, 33), (0x3041, 80), (0x4E00, 200)]


def made_text(lang, r, n=40):
    """Words of a made language: an alphabet of its own script, and its own letter pairs."""
    start, size = ALPHABETS[lang % len(ALPHABETS)]
    step = lang // len(ALPHABETS) + 1
    letters, at = [], r.randrange(size)
    for _ in range(n):
        at = (at * step + r.randrange(3)) % size
        letters.append(chr(start + at) + (" " if r.random() < 0.2 else ""))
    return "".join(letters)


def test_200_languages_of_all_scripts_in_blocks(spark, monkeypatch):
    """Several passes give what one gives, and each language is told from those of its script."""
    r = random.Random(7)
    teach = [i for i in range(40000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(teach.pop(), made_text(lang, r, 400), f"l{lang:03}", "a") for lang in range(200)]
    asked = [i for i in range(40000, 44000) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows += [(asked.pop(), made_text(lang, r, 200), f"l{lang:03}", "a") for lang in range(200)]
    docs = documents(spark, rows)
    one = by_id(li.predict(docs, li.train(docs)))
    truth = {row[0]: row[2] for row in rows[200:]}
    assert sum(one[i]["lang_pred"] == lang for i, lang in truth.items()) >= 190
    monkeypatch.setattr(li, "BLOCK_RUNS", 15_000)
    models = li.train(docs)
    assert len(models) > 3
    several = by_id(li.predict(docs, models))
    assert all(several[i]["lang_pred"] == r["lang_pred"] and math.isclose(several[i]["score"], r["score"], rel_tol=1e-9) for i, r in one.items())


def test_long_texts_are_scored_in_slices(monkeypatch):
    runs, n = np.unique(li._runs(*li.buffer_of(pa.array(TEXTS["en"])), 0, sum(map(len, TEXTS["en"]))), return_counts=True)
    model = li.Model(np.array(["en"] * len(runs), object), runs, n)
    texts = pa.array(["the cat " * 50, "", None, "hat", "that other é"])
    whole = model.lengths(texts)
    monkeypatch.setattr(li, "SLICE_BYTES", 37)
    assert np.allclose(model.lengths(texts), whole)
