"""The pipeline against DuckDB where SQL can say a stage, and brute force elsewhere."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lakeloom.llm import ngram_join, quality_rules, source_mix, token_files
from tests.llm.helpers import documents
from tests.llm.test_decontamination import brute as leaks

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    import re

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE TABLE ruled AS SELECT doc_id, clean_text AS text, lang, source FROM ({quality_rules.rules_sql('documents')}) WHERE kept")
    con.execute(f"CREATE TABLE single AS SELECT r.* FROM ruled r JOIN ({ngram_join.components_sql('ruled')}) c USING (doc_id) WHERE c.doc_id = c.component_id")
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    dirty = {i for i, _, _ in leaks(con.execute("SELECT doc_id, text FROM single").fetchall(), items)}
    con.execute("CREATE TABLE clean AS SELECT * FROM single WHERE NOT list_contains(?, doc_id)", [sorted(dirty)])
    tok = Tokenizer.from_file(token_files.tokenizer_path())
    mixed = []
    for doc_id, text, whole, part in con.execute(f"SELECT doc_id, text, whole, part FROM ({source_mix.mix_sql('clean')})").fetchall():
        pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)
        mixed += [(doc_id, text)] * whole
        if part:
            mixed.append((doc_id, text if part == len(pieces) else "".join(pieces[:part])))
    want = []
    for doc_id, text in mixed:
        ids = [*tok.encode(text, add_special_tokens=False).ids, token_files.END_ID]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [s for s, _ in starts] == np.cumsum([0, *[n for _, n in starts]])[:-1].tolist()


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_awkward_rows_through_all_stages(spark, tmp_path):
    """Nulls, repeated rows and ids, a long text and columns with clashing names, stage after stage."""
    item = "what is the name of the longest river that runs through the old town"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = lambda k, n=80: " ".join(f"{k}word{i}" for i in range(n))
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, own("x"), None, None), (None, own("y"), "en", "a"), (3, own("a"), "en", "a"), (4, own("a"), "en", "a"), (4, own("a"), "en", "a")]
    rows += [(5, own("b") + " " + item, "en", "a"), (5, own("c"), "en", None), (6, own("long", 60000), "en", "a"), (7, own("d"), None, "b")]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "token_files":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "decontamination":
            left = sorted(((r["doc_id"], r["text"][:2]) for r in docs.collect()), key=repr)
            assert left == sorted([(None, "xw"), (None, "yw"), (3, "aw"), (5, "cw"), (6, "lo"), (7, "dw")], key=repr)
    assert {r["doc_id"] for r in docs.collect()} == {None, 3, 5, 6, 7}
