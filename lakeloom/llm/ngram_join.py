"""N-gram Jaccard self-join by adaptive multi-match prefixes.

Documents are sets of hashed word shingles.  Under one global order of shingles
(their hash), two sets of sizes m and n that link share at least l of the first
``size - t(size) + l`` shingles of each, for any l up to t, where t(size) is the
least overlap a link needs.  A longer prefix costs more rows but asks for more
matches, so each step lengthens only what still looks costly:

1. All sets, l a tenth of the set: sets whose prefix shares too few shingles
   with any other set have no link (most of a corpus ends here).
2. What remains, whole sets: a set needs t(n) shingles that occur elsewhere.
3. What remains gets a prefix by its estimated candidates (mean number of other
   sets per shingle), the whole set if one of its shingles is in many sets; a
   pair needs the smaller l of the two in shared prefix shingles, and is then
   verified on its whole sets.

Equal sets are one node from the start, so copies cost nothing.  A shingle in
many sets (a heavy one) never emits all their pairs.  Pairs are met through light
shingles; the heavy ones they may share besides are bounded by the number each
set has.  Pairs that share heavy shingles only need three quarters of both sets
to be heavy: such sets are first compared with a few hubs and contracted, then
those of one hub are compared across components, if their bound allows a link.
No link between components is lost.

A frequent shingle, with a large part of all postings, would put them in one task.
The first pass over the texts finds such shingles (counters of bounded number in each
task, over all sets, merged by sums).  They count as heavy without being counted out,
so their rows are dealt by set as well, and what is known of a frequent shingle
reaches its rows by a broadcast.  Which shingles are frequent only decides the way:
any list of them leads to the same links.

Nodes are 64-bit digests of the sets, told apart by a second one where two sets
share a digest; shingles are 64-bit hashes.  One text of any length takes some
tens of bytes a word.  Cases: null and empty texts are empty sets
that link with nothing; a text of fewer words is one shingle; each row links by
its own text, rows that repeat a doc_id too; rows without doc_id take part in no
link and have no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, materialise, pick, text_documents, text_hash
from lakeloom.llm.components import connected_components
from lakeloom.llm.textkernels import WORD_BY_SPACE, Words, mix64, text_blocks

SHINGLE_WORDS = 5
#: Percent of the union that a linked pair shares.
SIMILARITY = 75
#: Percent of a set that step 1 adds to the prefix.
FIRST_SHARE = 10
#: Step 3: up to so many other sets per shingle, so many percent are added.
SHARES = ((4, 1), (16, 5), (None, 10))
#: Sets of one shingle up to which all its pairs are emitted; beyond, hubs it is compared with.
FEW_SETS = 16
HUBS = 4
#: Words that are worked on at once, sets that a task remembers, digests that different sets may share.
SLICE_WORDS = 1 << 18
REMEMBERED = 1 << 20
MOST_SHARED = 10_000
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Frequent shingles are in so many sets at least, and have over one in COUNTERS (or four times the shuffle partitions, if more) of all postings.
MANY_SETS = 1000
COUNTERS = 1024


def least_overlap(n, similarity: int):
    """t(n): a link shares at least similarity percent of the larger set."""
    return (similarity * n + 99) // 100


class ShingleSets:
    """The distinct shingles of each text of a block, ascending within a text.

    ``node`` is a digest of each set and ``check`` an independent one; sets whose
    node is among ``shared`` (nodes of different sets) get one made of both.
    """

    def __init__(self, texts: pa.Array, k: int = SHINGLE_WORDS, shared: np.ndarray | None = None):
        words = Words(texts, WORD_BY_SPACE)
        if len(texts) == 1:
            self.value = self._of_one(words, k)
            self.n = np.array([len(self.value)], np.int64)
        else:
            self.value, self.n = self._of_many(words, k)
        del words
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.node = self._digest(0).view(np.int64)
        if shared is not None and len(shared):
            at = np.flatnonzero(np.isin(self.node, shared))
            self.node[at] = mix64(self.node.view(np.uint64)[at] ^ self.check()[at].view(np.uint64)).view(np.int64)

    @staticmethod
    def _of_one(words: Words, k: int) -> np.ndarray:
        """Of a text that may be very long: grams are made slice by slice and sorted in place."""
        n = len(words.hash)
        k = min(k, n)
        value = np.zeros(n - k + 1 if n else 0, np.uint64)
        for a in range(0, len(value), SLICE_WORDS):
            value[a : a + SLICE_WORDS] = words.grams(k, a, a + SLICE_WORDS)[1]
        value.sort()
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        return value[new]

    @staticmethod
    def _of_many(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
        places, values = [], []
        for j in range(1, k + 1):
            at, value = words.grams(j)
            row = words.text_of(at)
            if j < k:  # the whole of a text of j words
                own = words.counts[row] == j
                row, value = row[own], value[own]
            places.append(row)
            values.append(value)
        row, value = np.concatenate(places), np.concatenate(values)
        order = np.argsort(value)
        narrow = np.uint16 if len(words.counts) < 1 << 16 else np.int64
        order = order[np.argsort(row[order].astype(narrow), kind="stable")]
        row, value = row[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        return value[new], np.bincount(row[new], minlength=len(words.counts)).astype(np.int64)

    def _digest(self, salt: int) -> np.ndarray:
        sums = np.zeros(len(self.n), np.uint64)
        full = np.flatnonzero(self.n)
        if len(full):
            sums[full] = np.add.reduceat(mix64(self.value + np.uint64(salt)), self.first[:-1][full])
        return mix64(sums ^ self.n.astype(np.uint64))

    def check(self) -> np.ndarray:
        return self._digest(0x5851F42D4C957F2D).view(np.int64)

    def postings(self, rows: np.ndarray, share: int, similarity: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the prefix shingles of the rows that are marked, and their rows."""
        extra = np.maximum(1, (share * self.n + 99) // 100)
        length = np.minimum(self.n, self.n - least_overlap(self.n, similarity) + extra)
        length[~rows] = 0
        row = np.repeat(np.arange(len(self.n), dtype=np.int32), length)
        at = np.arange(len(row)) + np.repeat(self.first[:-1] - (np.cumsum(length) - length), length)
        return at, row


class Met:
    """Tells the sets of a task that it hasn't met before, as far as it remembers."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def fresh(self, sets: ShingleSets) -> np.ndarray:
        new = sets.n > 0
        for i, node in enumerate(sets.node.tolist()):
            if node in self.seen:
                new[i] = False
            self.seen.add(node)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        return new


class FrequentValues:
    """At most ``most`` counters of the most frequent values (Misra-Gries, blocks at once).

    A counter is at most 1 / most of all values below the true count, and those of
    tasks may be added up with the same bound.
    """

    def __init__(self, most: int):
        self.most, self.total = most, 0
        self.value, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.total += len(values)
        new, count = np.unique(values, return_counts=True)
        value, at = np.unique(np.concatenate([self.value, new]), return_inverse=True)
        count = np.bincount(at, np.concatenate([self.count, count]), len(value)).astype(np.int64)
        if len(value) > self.most:
            count -= np.partition(count, -self.most - 1)[-self.most - 1]
        self.value, self.count = value[count > 0], count[count > 0]


def _mapped(docs: DataFrame, schema: str, rows_of: Callable[[ShingleSets, np.ndarray], list[pa.Array]], k: int, shared: np.ndarray) -> DataFrame:
    """Arrow rows made from the shingle sets; ``rows_of`` also gets the marks of fresh ones."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for batch in batches:
            for block in text_blocks(batch, "text"):
                sets = ShingleSets(block.column(1), k, shared)
                columns = rows_of(sets, met.fresh(sets))
                for a in range(0, len(columns[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([c[a : a + (1 << 16)] for c in columns], names)

    return text_documents(docs).mapInArrow(run, schema)


def _nodes(docs: DataFrame, k: int, shared: np.ndarray | None = None) -> DataFrame:
    """A row a document, and rows of frequent shingles: ``node`` is the shingle and ``times`` how many sets it was counted in."""
    names = ["doc_id", "text_hash", "n_shingles", "node", "check", "times"]
    most = _counters(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, frequent = Met(), FrequentValues(most)
        for batch in batches:
            for block in text_blocks(batch, "text"):
                sets = ShingleSets(block.column(1), k, shared)
                frequent.add(sets.value[np.repeat(met.fresh(sets), sets.n)].view(np.int64))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(sets.n), pa.array(sets.node), pa.array(sets.check()), pa.nulls(len(sets.n), pa.int64())], names)
        # What is dropped here is below 1 / most of the task's values, as is what the counters missed.
        at = np.flatnonzero(frequent.count * most >= frequent.total)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(frequent.value[at]), none, pa.array(frequent.count[at])], names)

    rows = text_documents(docs).withColumn("text_hash", text_hash(F.col("text")))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, check long, times long")


def _counters(spark: SparkSession) -> int:
    return max(COUNTERS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _frequent(held: DataFrame) -> DataFrame:
    """The frequent shingles (token), fewer than there are counters."""
    total = held.where("times IS NULL").agg(F.sum("n_shingles")).first()[0] or 0
    least = max(MANY_SETS, total // _counters(held.sparkSession) + 1)
    found = held.where("times IS NOT NULL").groupBy(F.col("node").alias("token")).agg(F.sum("times").alias("times")).where(F.col("times") >= least)
    return materialise(found.select("token"), "frequent")


def _told_apart(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """The nodes of all rows, the digests that different sets share, and the frequent shingles.

    Among n distinct sets about n * n / 2**65 share one, so their list is next to
    empty; a list that is not means that something else is wrong.
    """
    held = materialise(_nodes(docs, k), "nodes", keep=True)
    nodes, frequent = held.where("times IS NULL").drop("times"), _frequent(held)
    twice = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("node")
    shared = np.array([r["node"] for r in twice.limit(MOST_SHARED + 1).collect()], np.int64)
    if len(shared) > MOST_SHARED:
        raise ValueError("the digests of different sets agree too often")
    if len(shared):
        nodes = materialise(_nodes(docs, k, shared).where("times IS NULL").drop("times"), "nodes", keep=True)
    return nodes, shared, frequent


def _postings(docs: DataFrame, share: int, similarity: int, k: int, shared: np.ndarray) -> DataFrame:
    def rows_of(s: ShingleSets, fresh: np.ndarray) -> list[pa.Array]:
        at, row = s.postings(fresh, share, similarity)
        return [pa.array(s.value[at].view(np.int64)), pa.array(s.node[row]), pa.array(s.n[row].astype(np.int32))]

    return _mapped(docs, "token long, node long, n int", rows_of, k, shared)


def _sets(docs: DataFrame, k: int, shared: np.ndarray) -> DataFrame:
    def rows_of(s: ShingleSets, fresh: np.ndarray) -> list[pa.Array]:
        keep = np.flatnonzero(fresh)
        all_values = pa.LargeListArray.from_arrays(pa.array(s.first), pa.array(s.value.view(np.int64)))
        return [pa.array(s.node[keep]), pa.array(s.n[keep].astype(np.int32)), all_values.take(pa.array(keep)).cast(pa.list_(pa.int64()))]

    return _mapped(docs, "node long, n int, tokens array<bigint>", rows_of, k, shared).dropDuplicates(["node"])


def _overlap(n: str, similarity: int) -> str:
    return f"({similarity} * {n} + 99) div 100"


def _shared(postings: DataFrame, frequent: DataFrame) -> DataFrame:
    """Postings of shingles with two sets at least, once a set, with ``df``, the number of sets.

    Frequent shingles are marked; they count as heavy ones, and their rows are dealt by shingle and set.
    """
    marked = postings.join(F.broadcast(frequent.withColumn("_often", F.lit(True))), "token", "left")
    marked = marked.select("token", "node", "n", F.when(F.col("_often"), F.col("node")).alias("_salt"))
    by = W.partitionBy("token", "_salt")
    once = marked.withColumn("_last", F.lag("node").over(by.orderBy("node"))).where("_last IS NULL OR _last <> node").drop("_last")
    often = F.col("_salt").isNotNull()
    counted = once.withColumn("df", F.when(often, F.lit(FEW_SETS + 1).cast("long")).otherwise(F.count("*").over(by)))
    return counted.where("df > 1").withColumn("often", often).drop("_salt")


def _of_token(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows joined with a few known rows of their shingle; those of the (boundedly many) frequent shingles are broadcast."""
    plain = rows.where("NOT often").join(known.where("NOT often").drop("often"), "token")
    return plain.unionByName(rows.where("often").join(F.broadcast(known.where("often").drop("often")), "token"))


def _still_possible(shared: DataFrame, similarity: int) -> DataFrame:
    """Sets with enough shared shingles for a link: node, and the ``share`` its prefix is lengthened by."""
    counts = shared.groupBy("node", "n").agg(F.count("*").alias("c"), F.sum(F.col("df") - 1).alias("cost"), F.max("df").alias("most"))
    share = F.lit(SHARES[-1][1])
    for most, percent in reversed(SHARES[:-1]):
        share = F.when(F.col("cost") < most * F.col("c"), percent).otherwise(share)
    return counts.where(f"c >= {_overlap('n', similarity)}").select("node", F.when(F.col("most") > FEW_SETS, 100).otherwise(share).alias("share"))


def _documents_of(docs: DataFrame, nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """One document of each chosen node: (doc_id, text)."""
    ids = materialise(nodes.where("doc_id IS NOT NULL").join(chosen.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "chosen")
    few = ids.count() <= BROADCAST_IDS
    return text_documents(docs).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (x, y) whose whole sets link."""
    left = sets.select(F.col("node").alias("x"), F.col("n").alias("_nx"), F.col("tokens").alias("_tx"))
    right = sets.select(F.col("node").alias("y"), F.col("n").alias("_ny"), F.col("tokens").alias("_ty"))
    both = pairs.join(left, "x").join(right, "y")
    both = both.withColumn("_both", F.size(F.array_intersect("_tx", "_ty")))
    return both.where(f"100 * _both >= {similarity} * (_nx + _ny - _both)").select("x", "y")


def _sizes_fit(m: str, n: str, similarity: int) -> str:
    return f"100 * least({m}, {n}) >= {similarity} * greatest({m}, {n})"


def _may_link(overlap: str, m: str, n: str, similarity: int) -> str:
    return f"{100 + similarity} * ({overlap}) >= {similarity} * ({m} + {n})"


def _linked(docs: DataFrame, similarity: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, text_hash, n_shingles, node), and the label of each node that rows with doc_id have.

    The second also has ``first``, the least (doc_id, text_hash) of the node's rows.
    """
    with Scratch(docs.sparkSession):
        return _link(text_documents(docs), similarity, k)


def _link(rows: DataFrame, similarity: int, k: int) -> tuple[DataFrame, DataFrame]:
    nodes, shared, frequent = _told_apart(rows, k)

    first = _shared(_postings(rows, FIRST_SHARE, similarity, k, shared), frequent).groupBy("node", "n").agg(F.count("*").alias("c"))
    # A partner may be smaller: its l, of its size, is what both share at least.
    first = first.where(f"c >= greatest(1, ({FIRST_SHARE} * ({_overlap('n', similarity)}) + 99) div 100)")
    second = _shared(_postings(_documents_of(rows, nodes, materialise(first.select("node"), "first")), 100, similarity, k, shared), frequent)
    second = materialise(_still_possible(second, similarity), "second")

    sets = materialise(_sets(_documents_of(rows, nodes, second), k, shared).join(second, "node"), "sets")
    least, extra = f"cast({_overlap('n', similarity)} as int)", "cast(greatest(1, (share * n + 99) div 100) as int)"
    sets = materialise(sets.withColumn("l", F.expr(f"least({extra}, {least})")).drop("share"), "sets")
    prefixes = sets.select("node", "n", F.expr(f"explode(slice(tokens, 1, n - {least} + l))").alias("token"))
    third = materialise(_shared(prefixes, frequent), "third")
    # Shingles of few sets in the corpus may be frequent among what is left.
    many = max(MANY_SETS, third.count() // _counters(rows.sparkSession) + 1)
    third = third.withColumn("often", F.col("often") | (F.col("df") >= many))
    heavy = third.where(F.col("df") > FEW_SETS)
    held = heavy.groupBy("node").agg(F.count("*").alias("h"))
    sizes = materialise(sets.select("node", "n", "l").join(held, "node", "left").fillna(0, ["h"]), "sizes")

    light = third.where(F.col("df") <= FEW_SETS)
    other = light.select("token", F.col("node").alias("_node"), F.col("n").alias("_n"))
    met = light.join(other, "token").where("node < _node").where(_sizes_fit("n", "_n", similarity))
    met = met.groupBy(F.col("node").alias("x"), F.col("_node").alias("y")).agg(F.count("*").alias("c"))
    met = met.join(sizes.toDF("x", "nx", "lx", "hx"), "x").join(sizes.toDF("y", "ny", "ly", "hy"), "y")
    met = met.withColumn("c", F.col("c") + F.least("hx", "hy")).where("c >= least(lx, ly)")
    whole = f"lx = {_overlap('nx', similarity)} AND ly = {_overlap('ny', similarity)}"
    pairs = met.where(f"NOT ({whole}) OR {_may_link('c', 'nx', 'ny', similarity)}").select("x", "y")

    # Pairs of heavy shingles alone.  The sets of a shingle in an order of their own, one for all shingles,
    # those with the largest heavy share first: sets that share much meet the same few hubs.
    full = heavy.select("token", "node", "often").join(sizes.where(f"100 * h >= {similarity} * n"), "node")
    order = W.partitionBy("token").orderBy(F.col("h") / F.col("n") * -1, "node")
    hubs = full.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= HUBS)
    first = hubs.where("_rank = 1").select("token", "often", F.col("node").alias("hub"))
    hubs = hubs.select("token", "often", F.col("node").alias("_node"), F.col("n").alias("_n"), F.col("h").alias("_h"))
    bound = f"{_sizes_fit('n', '_n', similarity)} AND {_may_link('least(h, _h)', 'n', '_n', similarity)}"
    of_hubs = _of_token(full, hubs).where(f"node <> _node AND {bound}").select(*_pair("node", "_node")).distinct()
    links = materialise(_verified(pairs.unionByName(of_hubs).distinct(), sets, similarity), "links")
    labels = connected_components(links)

    of_hub = _of_token(full, first).select("hub", "node", "n", "h").distinct()
    of_hub = of_hub.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = of_hub.groupBy("hub").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("hub")
    of_hub = materialise(of_hub.join(several, "hub", "left_semi"), "of-hub")
    if not of_hub.isEmpty():
        other = of_hub.select("hub", F.col("node").alias("_node"), F.col("n").alias("_n"), F.col("h").alias("_h"), F.col("label").alias("_label"))
        across = of_hub.join(other, "hub").where(f"node < _node AND label <> _label AND {bound}").select(*_pair("node", "_node")).distinct()
        found = materialise(_verified(across, sets, similarity), "links")
        labels = connected_components(links.unionByName(found))

    labels = materialise(labels, "labels", keep=True)
    own = nodes.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    return nodes, own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def link_components(docs: DataFrame, similarity: int = SIMILARITY, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    nodes, own = _linked(docs, similarity, shingle_words)
    component = own.groupBy("label").agg(F.min("first.doc_id").alias("component_id"))
    of_node = own.join(component, "label").select("node", "component_id")
    out = nodes.join(of_node, "node", "left")
    alone = F.expr("doc_id IS NULL OR n_shingles = 0")
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, the one with the least doc_id (then text hash).

    Rows without doc_id stay, and each text without words of a doc_id stays once.
    """
    rows = pick(docs, "doc_id", "text", "lang", "source", "n_chars").withColumns({"_id": F.col("doc_id").cast("long"), "_hash": text_hash(F.col("text"))})
    nodes, own = _linked(docs, SIMILARITY, SHINGLE_WORDS)
    stay = own.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    stay = stay.unionByName(nodes.where("doc_id IS NOT NULL AND n_shingles = 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    one = rows.join(stay, ["_id", "_hash"], "left_semi")
    one = one.withColumn("_k", F.row_number().over(W.partitionBy("_id", "_hash").orderBy("lang", "source", "n_chars"))).where("_k = 1").drop("_k")
    return one.unionByName(rows.where("_id IS NULL").select(one.columns)).drop("_id", "_hash")


def components_sql(docs: str) -> str:
    """DuckDB SQL of link_components: doc_id, n_shingles, component_id."""
    return rf"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE_WORDS} THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE_WORDS - 2})]) END AS s FROM words),
    tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS m, b.n AS n, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM pairs WHERE 100 * c >= {SIMILARITY} * (m + n - c)),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
    SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id
    FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = s.doc_id"""


ORACLE = components_sql("documents")
