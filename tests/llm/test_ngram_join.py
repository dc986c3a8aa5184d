from __future__ import annotations

import numpy as np
import pyarrow as pa
from lakeloom.llm.components import connected_components

import random
import re

import pytest

from lakeloom.llm import ngram_join as nj
from tests.llm.helpers import documents


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    usable = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    for a in usable:
        for b in usable:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                label[root(b)] = root(a)
    least = {}
    for i in usable:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], len(sets[i]), least[root(i)] if i in usable else r[0]) for i, r in enumerate(rows)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edited(words, n, r):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"edit{r.randrange(10**6)}"
    return out


def test_awkward_rows(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(5, body, "en", "a"), (3, body.upper(), "en", "a"), (9, body + " tail", None, None), (None, body, "en", "a"), (1, None, "en", "a"), (2, "", "en", "a"), (4, " \n", "en", "a"), (6, "two words", "en", "a"), (7, "Two\twords", "en", "a"), (8, "other words", "en", "a"), (10, "É b c d e", "en", "a"), (11, "é b c d e", "en", "a")]
    rows += [(12, " ".join(f"v{i % 4999}" for i in range(30000)), "en", "a"), (13, " ".join(f"v{i % 4999}" for i in range(20000)), "en", "a"), (5, body, "en", "a")]
    assert rows_of(nj.link_components(documents(spark, rows))) == brute(rows)
    assert nj.link_components(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies_and_shared_passages(spark, seed):
    """Chains, large groups around hubs and passages in many documents: heavy shingles alone must lose no link."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(6):
        base = [f"g{g}x{i}" for i in range(r.choice([30, 80, 200]))]
        for _ in range(r.choice([2, 5, 30])):
            rows.append(edited(base, r.choice([0, 1, 2, 3, 5]), r))
            base = edited(base, r.choice([0, 0, 1]), r)
    for i in range(60):  # mostly the passage: linked by it alone; some with much of their own
        rows.append(passage[: r.randrange(40, 60)] + [f"own{i}y{j}" for j in range(r.choice([0, 2, 6, 10, 15, 40]))])
    ids = r.sample(range(1000), len(rows))
    rows = [(i, " ".join(w), "en", "a") for i, w in zip(ids, rows)]
    assert rows_of(nj.link_components(documents(spark, rows))) == brute(rows)


@pytest.mark.parametrize("most", [16, 4096])
def test_frequent_shingles_lose_no_link(spark, monkeypatch, most):
    """Shingles that count as frequent, the passage's or all of them, are dealt by set; the links stay."""
    monkeypatch.setattr(nj, "MANY_SETS", 1)
    monkeypatch.setattr(nj, "_counters", lambda spark: most)
    r = random.Random(most)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join(edited(passage[: r.randrange(20, 31)], r.choice([0, 0, 1, 2]), r) + [f"own{i}y{j}" for j in range(r.choice([0, 2, 6, 10, 40]))]), "en", "a") for i in range(80)]
    assert rows_of(nj.link_components(documents(spark, rows))) == brute(rows)


def test_counters_find_what_is_frequent():
    """No value with over 1 / most of all is missed, whatever the order, and counters stay below the true counts by at most that."""
    r = np.random.default_rng(3)
    values = np.concatenate([r.integers(0, 1 << 40, 50000), np.repeat([1, 2, 3], [4000, 2000, 1000])])
    r.shuffle(values)
    counters = nj.FrequentValues(64)
    for a in range(0, len(values), 999):
        counters.add(values[a : a + 999])
    got = dict(zip(counters.value.tolist(), counters.count.tolist()))
    assert len(got) <= 64 and counters.total == len(values)
    for v, n in ((1, 4000), (2, 2000), (3, 1000)):
        assert n - len(values) / 64 <= got.get(v, 0) <= n
    assert got[1] and got[2]


def test_stage_keeps_one_of_each_group(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(2, body, "en", "a"), (1, body, "en", "a"), (1, body, "en", "a"), (3, "lonely", "en", "a"), (4, None, "en", "a"), (None, body, "en", "a")]
    assert sorted((r["doc_id"] for r in nj.stage(spark, documents(spark, rows), "").collect()), key=repr) == sorted([1, 3, 4, None], key=repr)


def test_stage_tells_rows_by_id_and_text(spark):
    """Rows that repeat a doc_id with unlinked texts are judged each by its own text, whichever text hashes lower."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, a, "en", "a"), (7, a, "en", "a"), (7, b, "en", "a"), (7, c, "en", "a"), (7, d + " tail", "en", "a"), (8, d, "en", "a"), (7, "", "en", "a"), (None, a, "en", "a"), (None, d, "en", "a")]
    got = [(r["doc_id"], r["text"]) for r in nj.stage(spark, documents(spark, rows), "").collect()]
    assert sorted(got, key=repr) == sorted([(3, a), (7, b), (7, c), (7, d + " tail"), (7, ""), (None, a), (None, d)], key=repr)


def test_one_long_text_gives_the_sets_of_many(monkeypatch):
    """The way of a long text, slice by slice, and that of many texts agree; so do sums and checks."""
    texts = ["", "one two", "a b c d e f g a b c d e f g", "x " * 50, "w " + " ".join(f"t{i % 37}" for i in range(500))]
    many = nj.ShingleSets(pa.array(texts))
    monkeypatch.setattr(nj, "SLICE_WORDS", 11)
    for i, text in enumerate(texts):
        one = nj.ShingleSets(pa.array([text]))
        assert one.value.tolist() == many.value[many.first[i] : many.first[i + 1]].tolist()
        assert (one.node[0], one.check()[0], one.n[0]) == (many.node[i], many.check()[i], many.n[i])


def test_sets_that_share_a_digest_are_told_apart():
    texts = pa.array(["a b c d e f", "g h i j k l", "m n o p q r"])
    plain = nj.ShingleSets(texts)
    told = nj.ShingleSets(texts, shared=np.array([plain.node[1]]))
    assert told.node[[0, 2]].tolist() == plain.node[[0, 2]].tolist() and told.node[1] != plain.node[1]
    assert told.check().tolist() == plain.check().tolist()


def test_components_with_a_hot_node(spark):
    """A star of most of the edges, a long path and pairs."""
    edges = [(0, i) for i in range(1, 1500)] + [(5000 + i, 5001 + i) for i in range(60)] + [(9000 + 2 * i, 9001 + 2 * i) for i in range(40)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {i: 0 for i in range(1500)} | {5000 + i: 5000 for i in range(61)} | {9000 + i: 9000 + i // 2 * 2 for i in range(80)}
    assert got == want
