from __future__ import annotations

import re

from lakeloom.llm import license_scan as ls
from tests.llm.helpers import by_id, documents
from tests.llm.test_decontamination import least_distance


def base_of(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in ls.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def test_base_against_plain_search_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = by_id(ls.scan(docs))
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert tuple(r[c] for c in COLUMNS) == base_of(texts[i])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_awkward_texts(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "cc", "en", "a"), (4, "CC-BY cc by by cc by", "en", "a"), (5, "All rights reserved. all rights reserved", "en", "a"), (6, "the general public license" + " filler" * 30000 + " CC BY", "en", "a"), (6, "cc by", "en", "a"), (None, "general\npublic\tLICENSE é", "en", "a")]
    got = ls.scan(documents(spark, rows)).collect()
    have = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got), key=repr)
    assert have == sorted(((r[0], *base_of(r[1])) for r in rows), key=repr)
    assert ls.scan(documents(spark, [])).count() == 0


def test_notices_with_edits_are_found_by_merged_diagonals(spark):
    mit = next(t for label, t in ls.NOTICES if label == "mit" and t.startswith("Permission"))
    words = mit.split()
    edited = " ".join(words[:20] + ["really"] + words[20:45] + words[47:])  # a word put in, two left out
    rows = [(1, "before it " + mit + " after it", "en", "a"), (2, "intro " + edited, "en", "a"), (3, " ".join(words[:15]) + " and nothing more of it", "en", "a"), (4, "Licensed under CC BY-SA 4.0", "en", "a")]
    got = by_id(ls.scan(documents(spark, rows)))
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1
    assert got[2]["labels"] == "mit" and 0.7 <= got[2]["score"] < 1
    assert got[3]["labels"] == ""
    assert got[4]["labels"] == "cc-by,cc-by-sa"


def test_a_short_notice_repeated_back_to_back(spark):
    """The copies lie a few diagonals apart; each is found, with words of another line between or without."""
    notices = ["Released under the MIT License", "Licensed under the MIT License", "Licensed under the BSD License"]
    cases = [(n, k, between) for n in notices for k in (1, 2, 20) for between in ("\n", "\nalso ")]
    rows = [(i, between.join([n] * k), "en", "a") for i, (n, k, between) in enumerate(cases)]
    got = by_id(ls.scan(documents(spark, rows)))
    for i, (n, k, between) in enumerate(cases):
        step = 4 + len(between.split()) + 1
        assert got[i]["labels"] == ("bsd" if "BSD" in n else "mit") and got[i]["score"] == 1
        assert [s["first_word"] for s in got[i]["spans"] if s["score"] == 1] == [step * j for j in range(k)]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_added_labels_against_a_plain_scan_of_the_corpus(spark):
    """Every notice that stands there whole is found, and what is found is near in words to a notice of its label."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    notices = [(label, words_of(t)) for label, t in ls.NOTICES]
    whole = 0
    for r in ls.scan(docs).collect():
        text = f" {' '.join(texts[r['doc_id']])} "
        found = {s["label"] for s in r["spans"]}
        for label, notice in notices:
            if f" {' '.join(notice)} " in text:
                whole += 1
                assert label in found
        for s in r["spans"]:
            own = texts[r["doc_id"]][s["first_word"] : s["last_word"] + 1]
            assert min(least_distance(n, own) / len(n) for label, n in notices if label == s["label"]) <= 1 - ls.MIN_COVER + 1e-9
    assert whole > 10


def test_equal_hashes_with_other_words_do_not_count(spark):
    rows = ls.template_grams(spark).collect()
    other = [(*r[:1], "other words" if r["template"] >= 0 else r["words"], *r[2:]) for r in rows]
    templates = spark.createDataFrame(other, ls.template_grams(spark).schema)
    got = by_id(ls.scan(documents(spark, [(1, "all rights reserved, Released under the MIT License", "en", "a")]), templates))
    assert got[1]["n_base"] == 0 and got[1]["labels"] == ""


def test_slices_of_a_long_text_join(spark):
    """Grams of a text over several slices keep their places."""
    mit = next(t for label, t in ls.NOTICES if label == "mit" and t.startswith("Permission"))
    n = ls.SLICE_WORDS
    text = "filler " * (n - 30) + mit + " filler" * n + " all rights reserved"
    r = ls.scan(documents(spark, [(1, text, "en", "a"), (2, "cc by", "en", "a")])).where("doc_id = 1").first()
    assert [(s["label"], s["first_word"]) for s in r["spans"]] == [("mit", n - 30)] and r["spans"][0]["score"] == 1
    assert r["n_base"] == 1 and r["first_word"] == r["n_words"] - 3
