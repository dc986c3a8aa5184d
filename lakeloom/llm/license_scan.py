"""License scans by diagonal voting.

Every rolling word k-gram of every document is hashed and joined in Spark to the
positions of the same gram in the license templates.  A hit counts only if its
words are the template's words, so nothing rests on hashes alone; it votes for the
diagonal (document position - template position); votes are counted by document,
template and diagonal.  Diagonals near each other whose document spans follow or
overlap are merged (words put in or left out move the diagonal), and a span is
verified by the share of the template's words that stand in it, each compared in
its place, and by the span's length against the template's.  A merged span that fails is cut where the
template's positions begin anew (a short notice repeated on the next line lies a
few diagonals further), and its parts are verified one by one.  Base phrases must be covered whole on one
diagonal, so each is one place.

Grams of two words serve templates of up to ``SHORT_WORDS`` words, grams of four
the longer ones.  The template table is a fixed library (checked against
``MAX_TEMPLATE_GRAMS``), so its broadcast does not grow with the data.

Cases: a null or empty text has no words and no places; rows are told apart even
if they repeat; grams of a long text leave in slices; of notices that begin at
one word the best ones count, all of them if they are equal; a span that covers
exactly ``MIN_COVER`` counts; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import text_documents
from lakeloom.llm.textkernels import WORD_BY_ALNUM, Words, text_blocks

SHORT_WORDS = 3
SHORT_GRAM, LONG_GRAM = 2, 4
MAX_TEMPLATE_GRAMS = 200_000
#: Words that are worked on at once.
SLICE_WORDS = 1 << 18
#: Diagonals up to so many words apart may be one span.
DIAGONAL_SLACK = 6
#: Share of a template's words that a verified span covers.
MIN_COVER = 0.7

#: Phrase, label.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Label, notice as its license words it.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache-2.0", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Licensed under the BSD License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
#: The gram under which every document reports its word count.
MARKER = -1


def template_grams(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """gram, words, template, position, k, template_words, label, base: a row for each gram of each template."""
    texts = [(p, label, True) for p, label in phrases] + [(t, label, False) for label, t in notices]
    words = Words(pa.array([t for t, _, _ in texts]), WORD_BY_ALNUM, places=True)
    rows = [(MARKER, "", -1, 0, 0, 0, "", False)]
    for k in (SHORT_GRAM, LONG_GRAM):
        at, value = words.grams(k)
        for i, gram, r in zip(at.tolist(), value.view(np.int64).tolist(), words.text_of(at).tolist()):
            n = int(words.counts[r])
            if (n <= SHORT_WORDS) == (k == SHORT_GRAM):
                rows.append((gram, words.words_at(i, k), r, i - int(words.first[r]), k, n, texts[r][1], texts[r][2]))
    if len(rows) > MAX_TEMPLATE_GRAMS:
        raise ValueError("the template library is larger than what may be broadcast")
    return spark.createDataFrame(rows, "gram long, words string, template int, position long, k int, template_words int, label string, base boolean")


_GRAMS = "_row long, doc_id long, n_words long, _from long, grams array<bigint>, named map<int,string>"


def _document_grams(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Slices of each document's grams of one length: _row, doc_id, n_words, _from (the first gram's word), grams,
    and ``named``, the words of those grams whose hash is a template's, by place in the slice.

    Each document has a slice of the marker alone besides.
    """
    # Checked against MAX_TEMPLATE_GRAMS when the templates were made.
    sent = docs.sparkSession.sparkContext.broadcast(np.unique(np.array([r["gram"] for r in templates.select("gram").collect()], np.int64)))
    names = [x.split()[0] for x in _GRAMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = Words(block.column(1), WORD_BY_ALNUM, places=True)
                n = len(words.counts)

                def rows(r: np.ndarray, begin: np.ndarray, first: np.ndarray, gram: np.ndarray, place: np.ndarray, name: list[str], words=words, block=block, row=row) -> pa.RecordBatch:
                    """A row for each text of r; ``place``: the grams that have a name."""
                    named = pa.MapArray.from_arrays(np.searchsorted(place, first).astype(np.int32), pa.array((place - first[np.searchsorted(first, place, "right") - 1]).astype(np.int32)), pa.array(name, pa.string()))
                    grams = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(gram))
                    return pa.RecordBatch.from_arrays([pa.array(row + r), block.column(0).take(pa.array(r)), pa.array(words.counts[r]), pa.array(begin), grams, named], names)

                yield rows(np.arange(n), np.zeros(n, np.int64), np.arange(n + 1), np.full(n, MARKER), np.arange(n), [""] * n)
                for k in (SHORT_GRAM, LONG_GRAM):
                    for low in range(0, len(words.hash), SLICE_WORDS):
                        at, value = words.grams(k, low, low + SLICE_WORDS)
                        if not len(at):
                            continue
                        gram, text = value.view(np.int64), words.text_of(at)
                        r, first = np.unique(text, return_index=True)
                        place = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)] == gram)
                        yield rows(r, at[first] - words.first[r], np.append(first, len(at)), gram, place, [words.words_at(i, k) for i in at[place].tolist()])
                row += n

    return text_documents(docs).mapInArrow(run, _GRAMS)


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans``: the verified spans as (label, first_word, last_word, score), base places not among them.
    """
    templates = template_grams(docs.sparkSession) if templates is None else templates
    grams = _document_grams(docs, templates).select("_row", "doc_id", "n_words", "_from", "named", F.posexplode("grams").alias("_i", "gram"))
    hits = grams.join(F.broadcast(templates), "gram").where("element_at(named, _i) = words")
    hits = hits.withColumn("_at", (F.col("_from") + F.col("_i")).cast("long"))
    row = ["_row", "doc_id", "n_words"]
    what = ["template", "template_words", "label", "base"]
    votes = hits.groupBy(*row, *what, (F.col("_at") - F.col("position")).alias("diagonal")).agg(
        F.min("_at").alias("first"),
        F.max(F.col("_at") + F.col("k") - 1).alias("last"),
        F.count("*").alias("votes"),
        F.max("k").alias("k"),
        F.min("position").alias("from"),
        F.max(F.col("position") + F.col("k")).alias("to"),
        F.collect_set("position").alias("positions"),
    )
    # A diagonal continues the span of the one before if it is near and its words overlap or follow.
    order = W.partitionBy(*row, "template").orderBy("first", "diagonal")
    reach = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    near = F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= DIAGONAL_SLACK
    starts = F.col("base") | F.coalesce(~(near & (F.col("first") <= reach + DIAGONAL_SLACK)), F.lit(True))
    # The template begins anew if a diagonal repeats more positions of the one before than it adds.
    before = F.coalesce(F.lag("to").over(order), F.lit(0))
    anew = starts | (before - F.col("from") > F.col("to") - F.greatest("from", before))
    votes = votes.withColumns({"_starts": starts.cast("int"), "_anew": anew.cast("int")})
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    votes = votes.withColumns({"_merged": F.sum("_starts").over(so_far), "_part": F.sum("_anew").over(so_far)})
    # Part 0 is the merged span.
    one = F.col("base") | (F.col("template") < 0)
    votes = votes.withColumn("_part", F.explode(F.when(one, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), "_part"))))
    spans = votes.groupBy(*row, *what, "_merged", "_part").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("k").alias("k"), F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions")
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("positions", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    cover = F.when(F.col("template") < 0, F.lit(0.0)).otherwise(words / F.col("template_words"))
    length = F.col("last") - F.col("first") + 1
    spans = spans.withColumn("_cover", cover).withColumn("_score", F.col("_cover") * F.least(F.lit(1.0), F.expr("try_divide(template_words, last - first + 1)")))
    good = (F.col("_cover") >= MIN_COVER) & (F.col("_score") >= MIN_COVER)
    whole = F.bool_or((F.col("_part") == 0) & (good | one)).over(W.partitionBy(*row, "template", "_merged"))
    spans = spans.withColumn("_whole", whole).where((F.col("_part") == 0) == F.col("_whole"))
    place = F.col("base") & (F.col("_cover") == 1) & (length == F.col("template_words"))
    found = ~F.col("base") & good & (F.col("template") >= 0)
    # Of notices that begin at one word (versions of a license), the best one counts.
    spans = spans.withColumn("_best", F.max(F.when(found, F.col("_score"))).over(W.partitionBy("_row", "first")))
    found = found & (F.col("_score") == F.col("_best"))
    span = F.struct("label", F.col("first").alias("first_word"), F.col("last").alias("last_word"), F.col("_score").alias("score"))
    joined = lambda marks: F.array_join(F.array_sort(F.collect_set(F.when(marks, F.col("label")))), ",")
    out = spans.groupBy(*row).agg(
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("first"))).alias("first_word"),
        F.max(F.when(place, F.col("first"))).alias("last_word"),
        joined(place).alias("base_labels"),
        joined(place | found).alias("labels"),
        F.max(F.when(place, F.lit(1.0)).when(found, F.col("_score")).otherwise(F.lit(0.0))).alias("score"),
        F.array_sort(F.collect_list(F.when(found, span))).alias("spans"),
    )
    return out.drop("_row")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
