"""The corpus pipeline: each stage calls one operator on all that the stage before it kept.

quality rules -> n-gram Jaccard join (one document a group) -> benchmark
decontamination -> mixing sources to target weights -> token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import decontamination, ngram_join, quality_rules, source_mix, token_files
from lakeloom.llm.common import Scratch, materialise

#: (name, function of (spark, docs, sf_dir)).
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("ngram_join", ngram_join.stage),
    ("decontamination", decontamination.stage),
    ("source_mix", source_mix.stage),
    ("token_files", token_files.stage),
]

#: Edit distances and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    What a stage wrote on its way, and the table it read, go when its own is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as tables:
        for name, stage in STAGES:
            before = list(tables.own)
            with Scratch(spark):
                docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
            # The first block passes on what its stage keeps; only the table itself is read from now on.
            tables.remove(before)
        tables.keep()
    return docs
