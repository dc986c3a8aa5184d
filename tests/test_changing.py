"""Updates of files, collated keys and drifting records on awkward rows."""

from __future__ import annotations

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.drifting import leaves, merged_schema
from lakeloom.sources.filetable import FileTable, VersionTaken

ROWS = [(i, None if i % 5 == 0 else i % 3, f"s{i}" if i % 4 else None) for i in range(60)]


def new_table(spark):
    held = FileTable(spark, "file://" + tempfile.mkdtemp(prefix="table-"))
    held.create(spark.createDataFrame(ROWS, "id long, k long, s string").repartitionByRange(6, "id"))
    return held


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_updates_copy_the_files_that_hold_matches(spark):
    held = new_table(spark)
    before = held.files()
    held.update(F.col("id") < 5, {"k": F.col("k") + 10, "s": F.concat("s", F.col("k").cast("string"))})
    after = held.files()
    # One of six files is new, five keep their names.
    assert len(before) == 6 and len(set(before) & set(after)) == 5
    want = [(i, None if k is None else k + 10, None if s is None or k is None else f"{s}{k}") if i < 5 else (i, k, s) for i, k, s in ROWS]
    assert rows_of(held.read()) == sorted(want, key=repr) and rows_of(held.read(0)) == sorted(ROWS, key=repr)
    held.update(F.col("k") > 100, {"s": F.lit("never")})
    assert held.files() == after and held.versions() == [0, 1]  # no match, no version


def test_null_conditions_deletes_and_appends(spark):
    held = new_table(spark)
    held.delete(F.col("k") == 1)  # null for rows without k: they stay
    rest = [r for r in ROWS if r[1] != 1]
    assert rows_of(held.read()) == sorted(rest, key=repr)
    held.append(spark.createDataFrame([("new", 7, 900)], "s string, k int, id int"))
    assert rows_of(held.read()) == sorted([*rest, (900, 7, "new")], key=repr)
    held.delete(F.lit(True))
    assert rows_of(held.read()) == [] and held.read().columns == ["id", "k", "s"]
    held.update(F.lit(True), {"k": F.lit(1)})
    held.drop_old()
    assert held.versions() == [3] and rows_of(held.read()) == []
    with pytest.raises(ValueError):
        held.update(F.lit(True), {"none": F.lit(1)})


def test_failed_and_competing_writers(spark):
    held = new_table(spark)
    files = held.files()
    with pytest.raises(Exception, match="stopped"):
        held.update(F.col("id") < 30, {"k": F.when(F.col("id") == 7, F.raise_error(F.lit("stopped"))).otherwise(F.col("k"))})
    assert held.versions() == [0] and held.files() == files and rows_of(held.read()) == sorted(ROWS, key=repr)
    other = FileTable(spark, held.folder)
    with pytest.raises(VersionTaken):
        other._switch(0, [], held._schema())
    assert held.files() == files
    held.drop_old()
    assert rows_of(held.read()) == sorted(ROWS, key=repr)


def test_collated_keys_join_and_group(spark):
    words = ["Maß", "MASS", "mass", "élan", "Élan", "elan", "", None, "I", "i", None, "Straße", "STRASSE"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, w string")
    groups = {frozenset(r["ids"]) for r in df.groupBy(F.expr("w COLLATE UNICODE_CI")).agg(F.collect_set("id").alias("ids")).collect()}
    # Accents and a sharp s tell words apart, case does not, and nulls are one group.
    assert groups == {frozenset(g) for g in ([0], [1, 2], [3, 4], [5], [6], [7, 10], [8, 9], [11], [12])}
    bare = {frozenset(r["ids"]) for r in df.groupBy(F.expr("w COLLATE UNICODE_CI_AI")).agg(F.collect_set("id").alias("ids")).collect()}
    assert frozenset([3, 4, 5]) in bare
    folded = df.select("id", F.expr("w COLLATE UNICODE_CI").alias("w"))
    for hint in ("broadcast", "merge", "shuffle_hash"):
        pairs = {(r["a"], r["b"]) for r in folded.toDF("a", "w").join(folded.toDF("b", "w").hint(hint), "w").collect()}
        assert pairs == {(a, b) for g in groups for a in g for b in g if words[a] is not None}


def plain_leaves(value, path="", place=()):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from plain_leaves(v, f"{path}.{k}" if path else k, place)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from plain_leaves(v, f"{path}[]", (*place, i))
    else:
        kind = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", type(None): "VOID"}.get(type(value), "NUMBER")
        yield path, place, kind


def test_leaves_of_any_shape(spark):
    records = ['{"a": 1, "b": {"c": [1, "x", null, {"d": true}], "e": {}}}', '{"a": "one", "b": []}', "3", "null", '"text"', "[[1], [2, [3]]]", '{"a": 1.5}', '{"a": 1e300}', "{broken", "", None, '{"a": null, "é.f": {"": 0}}', "[]"]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "id long, rec string, path string")
    found = leaves(df, "id", "rec")
    got = sorted((r["key"], r["path"], tuple(r["place"]), "NUMBER" if r["type"] in ("DECIMAL", "DOUBLE") else r["type"]) for r in found.collect())
    want = []
    for i, r in enumerate(records):
        if r is None:
            continue
        try:
            want += [(i, *leaf) for leaf in plain_leaves(json.loads(r))]
        except ValueError:
            want.append((i, "", (), "INVALID"))
    assert got == sorted(want)
    kinds = {r["path"]: (r["types"], r["type"]) for r in merged_schema(found).collect()}
    assert kinds["a"][1] == "STRING" and kinds["b.c[].d"] == ("BOOLEAN", "BOOLEAN") and kinds["[][]"] == ("BIGINT", "BIGINT")
    numbers = merged_schema(leaves(df.where("id IN (0, 6, 7, 11)"), "id", "rec")).where("path = 'a'").first()
    assert numbers["type"] == "DOUBLE"  # with a null and no text every value is a number
    assert leaves(df.limit(0), "id", "rec").count() == 0
