from __future__ import annotations

from lakeloom.llm import quality_classifier as qc
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.01"


def test_agrees_with_most_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = qc.op3_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in got) / len(got)
    assert right >= 0.9, right


def test_awkward_rows(spark):
    text = "Plain words stand here, one after another, in a sentence. " * 10
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, text, "en", None), (4, text, None, "a"), (None, text, "en", "a"), (5, text, "en", "a"), (5, text, "en", "a"), (6, text * 500, "en", "a"), (7, "# $ % " * 30, "en", "a"), (8, "# $ " * 40, "en", "a")]
    labels = spark.createDataFrame([(5, 1, 0), (5, None, 0), (4, 1, 0), (7, 0, 0), (8, 0, 1), (None, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = qc.classify(documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["score"], by[1]["kept"], by[2]["score"]) == (0.0, False, 0.0)
    assert by[5]["score"] > 0.5 > by[7]["score"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert qc.classify(documents(spark, []), labels).count() == 0
    none = qc.classify(documents(spark, rows), labels.limit(0)).collect()
    assert {r["evidence"] for r in none} == {0.0} and {r["path_posterior"] for r in none} == {0.5}


def test_sparse_sites_shrink_more(spark):
    """A host with one bad document stays nearer to the prior than one with many."""
    bad, good = "# $ % & " * 30, "Plain words stand here, one after another, in a sentence. " * 10
    rows = [(i, bad, "en", "many") for i in range(40)] + [(100, bad, "en", "one")] + [(200 + i, good, "en", f"g{i % 3}") for i in range(60)]
    labels = spark.createDataFrame([(i, 0, 0) for i in range(10)] + [(200 + i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    by = {r["doc_id"]: r for r in qc.classify(documents(spark, rows), labels).collect()}
    assert by[0]["path_posterior"] < by[100]["path_posterior"] < by[200]["path_posterior"]


def test_held_out_labels(spark):
    """Fitted on three quarters of the labels, the score ranks the good documents of the rest above the bad ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in qc.classify(docs, labels.where("doc_id % 4 <> 2")).collect()}
    rest = [(score[r["doc_id"]], r["quality"]) for r in labels.where("doc_id % 4 = 2").collect() if r["doc_id"] in score]
    good, bad = [s for s, q in rest if q], [s for s, q in rest if not q]
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    print("held-out area under the curve", area, len(good), len(bad))
    assert area >= 0.9
