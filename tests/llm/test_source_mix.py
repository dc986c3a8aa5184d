from __future__ import annotations

from collections import defaultdict

from lakeloom.llm import source_mix as sm
from tests.llm.helpers import documents


def targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Water-filling, one clamp at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > epochs * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def held(rows, got):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


ROWS = [(i, "word " * (i * 7 % 50), "en", "abcdefg"[i % 7]) for i in range(200)] + [(300 + i, "small text", "en", "tiny") for i in range(3)]


def test_targets_are_met_and_reruns_agree(spark):
    got = sm.mix(documents(spark, ROWS)).collect()
    held(ROWS, got)
    again = sm.mix(documents(spark, ROWS[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", None), (3, "one two", "en", "Z"), (3, "one two", "en", "Z"), (None, "a b c", "en", "é"), (4, None, "en", "empty"), (5, "x " * 70000, "en", "big"), (6, "u v w", "en", "z")]
    got = sm.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    held(rows, got)
    assert sm.mix(documents(spark, [])).count() == 0
    nothing = sm.mix(documents(spark, rows[:2])).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in nothing} == {(0, 0.0, 0)}


def test_mixed_documents_hold_what_was_taken(spark):
    taken = sum(r["taken"] for r in sm.mix(documents(spark, ROWS)).collect())
    assert sum(len((r["text"] or "").split()) for r in sm.mixed_documents(documents(spark, ROWS)).collect()) == taken
    assert sm.stage(spark, documents(spark, ROWS), "").columns == ["doc_id", "text", "lang", "source", "n_chars"]
