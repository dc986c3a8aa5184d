from __future__ import annotations

import random
import re

import pyarrow.parquet as pq

from lakeloom.llm import decontamination as dc
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[\u3000-\u9fff]|[^\x00-\x2F\x3A-\x60\x7B-\x7F\u3000-\u9fff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def least_distance(item, doc):
    """Sellers' table: least edit distance of the item to any run of the document's words."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for w in doc:
        above, column[0] = 0, 0
        for i, x in enumerate(item, 1):
            above, column[i] = column[i], min(above + (x != w), column[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


def brute(rows, items):
    out = []
    for doc_id, text, *_ in rows:
        doc = words(text)
        for item_id, t in items:
            item = words(t)
            if item and (d := least_distance(item, doc)) <= dc.error_budget(len(item)):
                out.append((doc_id, item_id, d))
    return sorted(out, key=repr)


def found(spark, rows, items):
    df = dc.find_items(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string, Text string"))
    return sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in df.collect()), key=repr)


def items_of(spark, items):
    return [(i, t, "clash") for i, t in items]


def test_edited_items_against_sellers_table(spark):
    r = random.Random(3)
    items = [(i, " ".join(f"i{i}w{j}" if j % 7 else "the" for j in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 17, 40, 130])]
    rows = []
    for k in range(60):
        w = r.choice(items)[1].split()
        for _ in range(r.randrange(0, len(w) // 3 + 1)):
            at = r.randrange(len(w))
            w = r.choice([w[:at] + w[at + 1 :], w[:at] + ["new"] + w[at:], w[:at] + ["sub"] + w[at + 1 :]])
        rows.append((k, " ".join(["pre"] * r.randrange(5) + w + ["post"] * r.randrange(5)), "en", "a"))
    assert found(spark, rows, items_of(spark, items)) == brute(rows, items)


def test_awkward_rows_and_blocks_of_items(spark, monkeypatch):
    item = "What is the name of the river that runs there"
    items = [(1, item), (2, item), (3, None), (4, ""), (5, "too short"), (None, item + " now")]
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (None, f"x {item.upper()}!", "en", "a"), (3, "filler " * 30000 + item, "en", "a"), (3, item, "en", "a"), (4, "clean", "en", "a")]
    want = brute(rows, [(i, t) for i, t in items if t])
    assert found(spark, rows, items_of(spark, items)) == want
    monkeypatch.setattr(dc, "BLOCK_BYTES", 60)
    assert found(spark, rows, items_of(spark, items)) == want
    assert found(spark, [], items_of(spark, items)) == [] == found(spark, rows, [])


def test_verbatim_passages_in_the_corpus(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    verbatim = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in dc.op6_decontamination(spark, SF).collect()}
    assert verbatim and verbatim <= got


def test_stage_judges_each_row_by_its_own_text(spark, tmp_path):
    """A dirty row takes no clean row along that has no doc_id either, or the same one."""
    item = "What is the name of the river that runs there"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    dirty = [(None, f"x {item}", "en", "a"), (5, item, "en", "a"), (5, item, "fr", "b")]
    clean = [(None, "clean", "en", "a"), (None, "clean too", "en", "a"), (None, None, "en", "a"), (5, "clean", "en", "a"), (6, "clean", "en", "a")]
    got = dc.stage(spark, documents(spark, dirty + clean), str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in got), key=repr) == sorted(clean, key=repr)


def plain_matches(rows, items):
    pieces = dc.Pieces(items)
    got = [(rows[r][0], i, d) for r, i, d, *_ in pieces.matches(dc._words(dc.pa.array([t for _, t in rows], "string")))]
    return sorted(got, key=repr)


def test_short_items_and_unspaced_scripts():
    """Items of one to four words stand there exactly; Han characters are words."""
    items = [(1, "zebra"), (2, "Red zebra"), (3, "one red zebra"), (4, "see one red zebra"), (5, "do you see one red"), (6, "日本の首都はどこですか"), (7, "日本"), (8, ""), (9, "?!")]
    rows = [(1, "do you see one red zebra"), (2, "do you sea one zebra"), (3, "私は日本の首都がどこですかと聞いた"), (4, "zebras are red"), (5, None), (6, ""), (7, "red zebra red zebra")]
    assert plain_matches(rows, items) == brute(rows, items)
    assert {(1, 1), (1, 4), (1, 5), (3, 6), (3, 7)} <= {(d, i) for d, i, _ in plain_matches(rows, items)}


def test_a_piece_of_many_items_and_places(monkeypatch):
    """Slices of hits give the same matches as all at once."""
    r = random.Random(5)
    items = [(i, f"what is the capital of c{i} and of d{i % 7} now") for i in range(60)] + [(99, "what is the")]
    rows = [(k, " ".join(f"what is the capital of c{r.randrange(80)} and of d{r.randrange(9)} now" for _ in range(12))) for k in range(5)]
    want = brute(rows, items)
    assert plain_matches(rows, items) == want
    monkeypatch.setattr(dc, "MOST_HITS", 50)
    monkeypatch.setattr(dc, "SLICE_WORDS", 17)
    assert plain_matches(rows, items) == want


def test_a_stage_drops_rows_by_each_block_of_items(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 60)
    items = [(i, f"item number {i} holds these very words {i} and no other") for i in range(6)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, f"so {t}", "en", None) for i, t in items] + [(10, "clean", None, None), (None, None, None, None), (11, "", "en", "a"), (11, "", "en", "a")]
    got = dc.stage(spark, documents(spark, rows), str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] or -1 for r in got.collect())) == [-1, 10, 11, 11]
