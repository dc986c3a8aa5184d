"""Quality rules by cross-document line frequency (DataFrame functions only).

Every line is normalised and hashed; distinct documents are counted per host and
line; lines in more documents of a host than the limit are removed; a document
that loses more than a share of its words is rejected as depleted.  Document
statistics (repeated windows, repeated lines, symbols) are array expressions
within the row, so no word is ever shuffled.

Cases: a null or empty text has no words and fails; a null host is a host of its
own; rows that repeat a doc_id count as one document for line frequency, and
each row gets its own verdict from its own text; other columns are left alone.

The pipeline's stage counts distinct texts instead (``by_text``), and of the texts
that share a line above the limit the longest keeps it, so neither exact copies nor
large groups of near copies lose all their members before the n-gram join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import SPACE, text_documents

WORD = rf"[^{SPACE}]+"
GAP = rf"[{SPACE}]+"
SYMBOLS = r"[^#*$%&|<>]+"

MIN_WORDS = 50
#: A line in more distinct documents of one host than this is removed.
MAX_DOCS_PER_HOST = 20
#: A document is depleted if more than this share of its words stood in removed lines.
MAX_REMOVED_SHARE = 0.5


def _line_key(line: Column) -> Column:
    """Hash of the normalised line: white space joined and trimmed, letters lower-cased."""
    return F.xxhash64(F.trim(F.lower(F.regexp_replace(line, GAP, " "))))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    a = docs.withColumns({"_words": F.regexp_extract_all(text, F.lit(WORD), 0), "_lines": lines})
    a = a.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            # Window hash above, window number below: one sort of longs brings windows that may be equal together.
            "_bits": F.expr("cast(length(bin(size(_words))) as int)"),
        }
    )
    # Each array is bound once to a lambda's name: a filter that Catalyst pushes below would else repeat it for every element.
    a = a.withColumn(
        "_keys",
        F.expr(
            "element_at(transform(array(struct(_words AS w, _bits AS b)), s -> sort_array(transform("
            "slice(s.w, 1, greatest(size(s.w) - 2, 0)),"
            " (x, i) -> shiftleft(xxhash64(x, get(s.w, i + 1), get(s.w, i + 2)), s.b) | i))), 1)"
        ),
    )
    a = a.withColumn(
        "_maybe",
        F.expr(
            "element_at(transform(array(struct(_keys AS k, _bits AS b)), s -> transform(filter(s.k, (x, i) ->"
            " shiftright(x, s.b) <=> shiftright(get(s.k, i + 1), s.b) OR"
            " shiftright(x, s.b) <=> shiftright(get(s.k, i - 1), s.b)),"
            " x -> cast(x & (shiftleft(1L, s.b) - 1) as int))), 1)"
        ),
    )
    # Equal hash bits are candidates only: their words are sorted, and windows equal to a neighbour count.
    windows = "sort_array(transform(s.m, p -> struct(get(s.w, p) AS a, get(s.w, p + 1) AS b, get(s.w, p + 2) AS c, p AS p)))"
    same = "coalesce(x.a = get(t.v, {0}).a AND x.b = get(t.v, {0}).b AND x.c = get(t.v, {0}).c, false)"
    a = a.withColumn(
        "_hits",
        F.expr(
            f"element_at(transform(transform(array(struct(_words AS w, _maybe AS m)), s -> struct({windows} AS v)), t ->"
            f" sort_array(transform(filter(t.v, (x, i) -> {same.format('i + 1')} OR {same.format('i - 1')}), x -> x.p))), 1)"
        ),
    )
    covered = "element_at(transform(array(_hits), h -> aggregate(transform(h, (p, i) -> coalesce(least(3L, cast(get(h, i + 1) - p as long)), 3L)), 0L, (s, x) -> s + x)), 1)"
    return a.withColumn("n_repeat_words", F.expr(covered)).drop("_words", "_lines", "_bits", "_keys", "_maybe", "_hits")


def _line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line that has a word: _host, _doc, _id, _hash, _chars, _pos, _line, _line_words."""
    one = F.expr("posexplode(split(coalesce(text, ''), '\n', -1))")
    rows = docs.select(
        F.coalesce("_host", F.lit("\0")).alias("_host"),
        F.col("doc_id").alias("_id"),
        _text_hash(F.col("text")).alias("_hash"),
        F.length("text").alias("_chars"),
        one.alias("_pos", "_raw"),
    )
    return rows.select(
        "_host",
        "_id",
        "_hash",
        "_chars",
        F.coalesce("_id", "_hash").alias("_doc"),
        "_pos",
        _line_key(F.col("_raw")).alias("_line"),
        F.regexp_count("_raw", F.lit(WORD)).alias("_line_words"),
    ).where("_line_words > 0")


def line_frequency(docs: DataFrame, max_docs_per_host: int = MAX_DOCS_PER_HOST, by_text: bool = False) -> DataFrame:
    """Lines above the limit: _host, _line, n_docs; with ``by_text`` also _keeper, the hash of the longest text that has the line.

    The distinct count is dealt by host, line and document first, so a line that
    a third of all documents share is summed before its counts meet.
    """
    rows = _line_rows(docs)
    if by_text:
        found = rows.groupBy("_host", "_line").agg(F.countDistinct("_hash").alias("n_docs"), F.max(F.struct("_chars", "_hash"))["_hash"].alias("_keeper"))
    else:
        found = rows.groupBy("_host", "_line").agg(F.countDistinct("_doc").alias("n_docs"))
    return found.where(F.col("n_docs") > max_docs_per_host)


def apply_rules(
    docs: DataFrame,
    host: str = "source",
    max_docs_per_host: int = MAX_DOCS_PER_HOST,
    max_removed_share: float = MAX_REMOVED_SHARE,
    keep: tuple[str, ...] = (),
    by_text: bool = False,
) -> DataFrame:
    """Per row: doc_id, ``keep`` columns, statistics, removed_words, base_failed, kept, clean_text.

    ``clean_text`` is the text without the removed lines.  ``by_text`` counts
    distinct texts rather than doc_ids, and leaves each line in one text.
    """
    base = text_documents(docs, host, *keep).withColumnRenamed(host, "_host") if host not in keep else text_documents(docs, *keep).withColumn("_host", F.col(host))
    base = base.withColumn("_host", F.col("_host").cast("string"))
    common = line_frequency(base, max_docs_per_host, by_text).drop("n_docs")
    common_lines = _line_rows(base).join(common, ["_host", "_line"])
    if by_text:
        common_lines = common_lines.where("_hash <> _keeper")
    removed = (
        common_lines.dropDuplicates(["_id", "_hash", "_pos"])
        .groupBy("_id", "_hash")
        .agg(F.sum("_line_words").cast("long").alias("removed_words"), F.collect_set("_line").alias("_removed"))
    )
    rows = with_statistics(base.withColumn("_text_hash", _text_hash(F.col("text"))))
    out = rows.join(removed, rows["doc_id"].eqNullSafe(removed["_id"]) & (rows["_text_hash"] == removed["_hash"]), "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    kept_lines = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("_removed", _line_key(x)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        "doc_id",
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "removed_words",
        failed.alias("base_failed"),
        (~failed & (F.col("removed_words") <= max_removed_share * F.col("n_words"))).alias("kept"),
        F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")).alias("clean_text"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents, without the removed lines; n_chars follows the text.

    Lines are counted by distinct texts, so copies are left to the n-gram join.
    Null and empty texts go; repeated rows and rows without doc_id are judged one
    by one; an empty table gives no rows; of other columns none is kept.
    """
    # One number of both verdicts: a filter on one of them would be pushed below the join and compute the statistics twice.
    ruled = apply_rules(docs, keep=("lang", "source"), by_text=True).where("greatest(cast(base_failed as int), cast(NOT kept as int)) = 0")
    return ruled.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


STATISTICS_SQL = rf"""
    SELECT d.rid, d.doc_id, d.text, d.lang, d.source, len(d.w)::BIGINT AS n_words,
        length(regexp_replace(coalesce(d.text, ''), '[{SPACE}]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(d.ls) - len(list_distinct(d.ls)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM (SELECT row_number() OVER () AS rid, *, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w,
              list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls
          FROM {{docs}}) d
    LEFT JOIN (
        SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (
            SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (
                SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM (
                    SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (
                        SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM (
                            SELECT row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w FROM {{docs}})))
            ) WHERE k > 1)
        GROUP BY rid) r ON r.rid = d.rid
"""
LINES_SQL = rf"""
    SELECT doc_id, host, pos, raw, trim(lower(regexp_replace(raw, '[{SPACE}]+', ' ', 'g'))) AS line,
        len(regexp_extract_all(raw, '[^{SPACE}]+')) AS line_words
    FROM (SELECT doc_id, coalesce(source, chr(0)) AS host, unnest(ls) AS raw, unnest(range(len(ls))) AS pos
          FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM {{docs}}))
"""


def rules_sql(docs: str) -> str:
    """DuckDB SQL of apply_rules for distinct doc_ids."""
    return f"""
    WITH stats AS ({STATISTICS_SQL.format(docs=docs)}), lines AS ({LINES_SQL.format(docs=docs)}),
    common AS (SELECT host, line FROM lines WHERE line_words > 0 GROUP BY ALL HAVING count(DISTINCT doc_id) > {MAX_DOCS_PER_HOST}),
    marked AS (SELECT l.*, c.line IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.host = c.host AND l.line = c.line AND l.line_words > 0),
    removed AS (SELECT doc_id, sum(line_words) FILTER (gone) AS words, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS clean, bool_or(gone) AS any_gone FROM marked GROUP BY doc_id)
    SELECT s.doc_id, s.lang, s.source, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words,
        coalesce(r.words, 0)::BIGINT AS removed_words,
        s.n_words < {MIN_WORDS} OR 100 * s.n_repeat_words > 50 * s.n_words AS base_failed,
        NOT (s.n_words < {MIN_WORDS} OR 100 * s.n_repeat_words > 50 * s.n_words) AND coalesce(r.words, 0) <= {MAX_REMOVED_SHARE} * s.n_words AS kept,
        CASE WHEN r.any_gone THEN coalesce(r.clean, '') ELSE s.text END AS clean_text
    FROM stats s LEFT JOIN removed r ON s.doc_id = r.doc_id"""


ORACLE = f"SELECT * EXCLUDE (lang, source, clean_text) FROM ({rules_sql('documents')})"
