"""Fixtures for the operators' awkward cases."""

from __future__ import annotations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, Doc_Id string"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); with extra columns whose names clash in case."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "clash", "clash") for r in rows], DOC_SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
