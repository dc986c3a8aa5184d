"""Quality classifier by hierarchical empirical Bayes (DataFrame functions).

A document's evidence is the log-likelihood ratio of good against bad under
binned text features, counted over the labelled documents by grouped sums.
Evidence with the global prior gives each document a first posterior.  A host's
posterior is the mean of its documents' shrunk to the global prior, a path's the
mean of its documents' shrunk to its host's; the strength of shrinking is the
moment estimate from the variance between hosts (between paths) beyond what
their sizes explain.  The final score puts a document's evidence on its path's
posterior, so a sparse site leans on the levels above it.

Host and path are columns; here the source and, in it, the language.

Cases: a null or empty text scores 0 and is not kept; null hosts and paths are
groups of their own; labels of a repeated doc_id count once (the lower one), null
labels not at all; without labels the prior is a half and the evidence 0; rows
that repeat a doc_id are scored one by one; a score of exactly ``KEEP_FROM`` is kept;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import SPACE, materialise, pick, text_documents

KEEP_FROM = 0.5
#: Evidence is divided by this: the features overlap, and a sum over them counts the same trait twice.
TEMPER = 2.0
#: Bounds of the shrinking strength, in documents.
STRENGTH = (1.0, 1e6)

#: Feature: (expression over counts, cuts); a bin is the number of cuts at or below the value.
FEATURES = {
    "words": ("n_words", (1, 5, 10, 20, 50, 100, 200, 400, 800, 1600, 3200)),
    "symbols": ("n_symbols / n_words", (0.001, 0.005, 0.02, 0.05, 0.1, 0.3, 0.6, 1.0, 1.5)),
    "marks": ("n_marks / n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0, 2.0)),
    "capitals": ("n_capitals / n_chars", (0.005, 0.01, 0.02, 0.04, 0.08, 0.2, 0.5)),
    "digits": ("n_digits / n_chars", (0.001, 0.005, 0.02, 0.05, 0.1, 0.3)),
    "length": ("n_chars / n_words", (2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10)),
    "lines": ("n_words / n_lines", (2, 4, 8, 12, 16, 24, 40, 80)),
    "lines_new": ("n_lines_new / n_lines", (0.2, 0.4, 0.6, 0.8, 0.9, 0.99)),
    "words_new": ("n_words_new / n_words", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
}


def _without(chars: str, g: str) -> str:
    """Number of the characters of a class, in SQL; g: the flag that DuckDB needs."""
    return f"length(regexp_replace(t, '[^{chars}]+', ''{g}))"


def _counts(raw: str, g: str, words: str, size: str, distinct: str, lines: str) -> dict[str, str]:
    return {
        "n_words": f"cast({size}({words}) as double)",
        "n_words_new": f"cast({size}({distinct}({words})) as double)",
        "n_chars": f"cast(length(regexp_replace(t, {raw}'[{SPACE}]+', ''{g})) as double)",
        "n_symbols": f"cast({_without('#*$%&|<>', g)} as double)",
        "n_marks": f"cast({_without('.,;:!?', g)} as double)",
        "n_capitals": f"cast({_without('A-Z', g)} as double)",
        "n_digits": f"cast({_without('0-9', g)} as double)",
        "n_lines": f"cast({size}({lines}) as double)",
        "n_lines_new": f"cast({size}({distinct}({lines})) as double)",
    }


_SPARK = _counts("r", "", "w", "size", "array_distinct", "split(t, '\\n', -1)")
_DUCK = _counts("", ", 'g'", "w", "len", "list_distinct", "string_split(t, chr(10))")


def _bin(expression: str, cuts: tuple) -> str:
    return "CASE WHEN n_words = 0 THEN 0 ELSE " + " + ".join(f"CASE WHEN {expression} >= {c} THEN 1 ELSE 0 END" for c in cuts) + " END"


def binned(docs: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, host, path, n_words and the bin of each feature."""
    rows = text_documents(docs, host, path).toDF("doc_id", "text", "host", "path")
    rows = rows.withColumns({"host": F.col("host").cast("string"), "path": F.col("path").cast("string"), "t": F.coalesce("text", F.lit(""))})
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(rf"[^{SPACE}]+"), 0))
    rows = rows.select("doc_id", "host", "path", *[F.expr(e).alias(c) for c, e in _SPARK.items()])
    return rows.select("doc_id", "host", "path", "n_words", *[F.expr(_bin(*f)).cast("int").alias(f"_{c}") for c, f in FEATURES.items()])


def evidence_tables(rows: DataFrame, labels: DataFrame) -> tuple[dict[str, list[float]], float]:
    """Log-likelihood ratio of each feature's bins, and the share of good documents, from labelled rows."""
    own = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    own = own.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    marked = rows.join(own, F.col("doc_id") == F.col("_id")).where("n_words > 0")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{c}").alias("bin")) for c in FEATURES]))
    counts = marked.select("quality", pairs.alias("f")).groupBy("f.feature", "f.bin", "quality").count().collect()  # bounded by the bins
    table = {(r["feature"], r["bin"], int(r["quality"] > 0)): r["count"] for r in counts}
    total = [sum(n for (f, _, q), n in table.items() if f == "words" and q == y) for y in (0, 1)]
    ratios = {}
    for c, (_, cuts) in FEATURES.items():
        size = len(cuts) + 1
        ratios[c] = [math.log((table.get((c, b, 1), 0) + 1) / (total[1] + size)) - math.log((table.get((c, b, 0), 0) + 1) / (total[0] + size)) for b in range(size)]
    return ratios, (total[1] + 1) / (sum(total) + 2)


def _shrunk(groups: DataFrame, prior) -> DataFrame:
    """Adds ``posterior`` to groups with n, s (sum of posteriors) and q (sum of their squares).

    ``prior`` is the column that holds the level above.
    """
    mean, within = F.col("s") / F.col("n"), F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))
    r = groups.agg(F.avg((mean - prior) ** 2).alias("between"), F.avg(within / F.col("n")).alias("noise"), F.avg(prior * (1 - prior)).alias("spread")).first()
    low, high = STRENGTH
    beyond = (r["between"] or 0) - (r["noise"] or 0)
    strength = min(high, max(low, r["spread"] / beyond - 1)) if beyond > 0 else high
    return groups.withColumn("posterior", (F.col("s") + strength * prior) / (F.col("n") + strength))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence, path_posterior, score, kept of every row."""
    rows = materialise(binned(docs, host, path), "features")
    ratios, prior = evidence_tables(rows, labels)
    evidence = sum((F.element_at(F.array(*[F.lit(x) for x in ratios[c]]), F.col(f"_{c}") + 1) for c in FEATURES), F.lit(0.0)) / TEMPER
    rows = rows.select("doc_id", "host", "path", "n_words", evidence.alias("evidence"))
    logit = lambda p: F.log(p / (1 - p))
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    first = rows.withColumn("p", sigmoid(F.col("evidence") + math.log(prior / (1 - prior))))
    paths = first.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = materialise(paths, "paths")
    hosts = _shrunk(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), F.lit(prior))
    hosts = hosts.select(F.col("host").alias("_host"), F.col("posterior").alias("_above"))
    paths = materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "paths-hosts")
    sites = _shrunk(paths, F.col("_above")).select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("posterior").alias("path_posterior"))
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    score = F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(sigmoid(F.col("evidence") + logit(F.col("path_posterior"))))
    out = out.withColumn("score", F.round(score, 6))
    return out.select("doc_id", F.round("evidence", 6).alias("evidence"), F.round("path_posterior", 6).alias("path_posterior"), "score", (F.col("score") >= KEEP_FROM).alias("kept"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _shrink_sql(source: str, prior: str, columns: str) -> str:
    low, high = STRENGTH
    return f"""SELECT {columns}, (s + k * {prior}) / (n + k) AS posterior FROM {source},
        (SELECT CASE WHEN b > 0 THEN least({high}, greatest({low}, d / b - 1)) ELSE {high} END AS k FROM (
            SELECT avg((s / n - {prior}) ** 2) - avg(greatest(q / n - (s / n) ** 2, 0) / n) AS b, avg({prior} * (1 - {prior})) AS d FROM {source}))"""


ORACLE = f"""
    WITH raw AS (SELECT doc_id, source AS host, lang AS path, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w FROM documents),
    counted AS (SELECT doc_id, host, path, {', '.join(f'{e} AS {c}' for c, e in _DUCK.items())} FROM raw),
    bins AS (SELECT row_number() OVER () AS rid, doc_id, host, path, n_words, {', '.join(f'{_bin(*f)} AS _{c}' for c, f in FEATURES.items())} FROM counted),
    marked AS (SELECT b.*, l.quality FROM bins b JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) WHERE n_words > 0),
    total AS (SELECT count(*) FILTER (quality > 0) AS good, count(*) FILTER (quality = 0) AS bad, (count(*) FILTER (quality > 0) + 1)::DOUBLE / (count(*) + 2) AS prior FROM marked),
    ratios AS ({' UNION ALL '.join(f"""
        SELECT '{c}' AS feature, v.bin, ln((count(*) FILTER (quality > 0) + 1)::DOUBLE / (any_value(good) + {len(cuts) + 1})) - ln((count(*) FILTER (quality = 0) + 1)::DOUBLE / (any_value(bad) + {len(cuts) + 1})) AS x
        FROM (SELECT unnest(range({len(cuts) + 1})) AS bin) v LEFT JOIN marked m ON m._{c} = v.bin, total GROUP BY v.bin""" for c, (_, cuts) in FEATURES.items())}),
    scored AS (SELECT b.rid, b.doc_id, b.host, b.path, b.n_words, sum(x) / {TEMPER} AS evidence FROM bins b JOIN ratios r ON ({' OR '.join(f"(r.feature = '{c}' AND r.bin = b._{c})" for c in FEATURES)}) GROUP BY ALL),
    first AS (SELECT *, 1 / (1 + exp(-(evidence + ln(prior / (1 - prior))))) AS p FROM scored, total),
    paths AS (SELECT host, path, count(*) AS n, sum(p) AS s, sum(p * p) AS q FROM first GROUP BY ALL),
    hosts AS (SELECT host, sum(n) AS n, sum(s) AS s, sum(q) AS q, any_value(prior) AS prior FROM paths, total GROUP BY host),
    above AS ({_shrink_sql('hosts', 'prior', 'host')}),
    under AS (SELECT p.*, a.posterior AS above FROM paths p JOIN above a ON p.host IS NOT DISTINCT FROM a.host),
    sites AS ({_shrink_sql('under', 'above', 'host, path')})
    SELECT f.doc_id, round(f.evidence, 6) AS evidence, round(s.posterior, 6) AS path_posterior,
        CASE WHEN f.n_words = 0 THEN 0.0 ELSE round(1 / (1 + exp(-(f.evidence + ln(s.posterior / (1 - s.posterior))))), 6) END::DOUBLE AS score,
        (CASE WHEN f.n_words = 0 THEN 0.0 ELSE round(1 / (1 + exp(-(f.evidence + ln(s.posterior / (1 - s.posterior))))), 6) END) >= {KEEP_FROM} AS kept
    FROM first f JOIN sites s ON f.host IS NOT DISTINCT FROM s.host AND f.path IS NOT DISTINCT FROM s.path"""
