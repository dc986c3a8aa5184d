from __future__ import annotations

import re
from collections import defaultdict

from lakeloom.llm import ngram_join
from lakeloom.llm import quality_rules as qr
from tests.llm.helpers import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, limit):
    """(doc_id, statistics, removed words, base_failed, kept, clean text) of each row, in order."""
    key = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line).lower().strip(" ")
    seen = defaultdict(set)
    for i, (doc_id, text, _, source) in enumerate(rows):
        for line in (text or "").split("\n"):
            if WORD.search(line):
                seen[source, key(line)].add(doc_id if doc_id is not None else ("row", text))
    out = []
    for doc_id, text, _, source in rows:
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        gone = [WORD.search(x) is not None and len(seen[source, key(x)]) > limit for x in (text or "").split("\n")]
        removed = sum(len(WORD.findall(x)) for x, g in zip((text or "").split("\n"), gone) if g)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        clean = "\n".join(x for x, g in zip(text.split("\n"), gone) if not g) if any(gone) else text
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), removed, failed, not failed and removed <= 0.5 * len(words), clean))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_awkward_rows_against_brute_force(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Shared  LINE number one\n{body} tail{i}", "en", "hot") for i in range(6)]
    rows += [(10, "shared line number one\n" * 20 + "own words here", "en", "hot"), (11, "Shared line number one\n" + body, "en", "cold")]
    rows += [(12, None, None, None), (13, "", "en", None), (14, " \n\t\n", "en", "hot"), (15, f"a b c a b c a b c x{body} #$% <b>", "en", None), (15, f"a b c a b c a b c x{body} #$% <b>", "en", None)]
    rows += [(None, f"Shared line number one\n{body}", "en", "hot"), (16, "same words again " * 40, "en", "hot"), (17, f"{body}\n{body}\n\n{body} é ü", "fr", "hot")]
    rows += [(18, "long " + " ".join(f"v{i % 997}x{i}" for i in range(30000)), "en", "hot")]
    got = rows_of(qr.apply_rules(documents(spark, rows), max_docs_per_host=4))
    want = brute([r if r[0] != 18 else r for r in rows if r[0] != 18], 4)
    assert [r for r in got if r[0] != 18] == sorted(want, key=repr)
    assert next(r for r in got if r[0] == 18)[1:6] == (30001, sum(map(len, rows[-1][1].split())), 0, 0, 0)


def test_a_filter_above_does_not_repeat_the_arrays(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(3000)), "en", "a") for i in range(20)]
    assert qr.apply_rules(documents(spark, rows)).where("kept").count() == 20


def test_large_groups_of_copies_in_one_source_keep_a_document_after_the_join(spark):
    """35 exact copies, and 35 near copies (distinct texts that differ in a line): one of each group stays, with its text."""
    exact = "\n".join(" ".join(f"e{i}x{j}" for j in range(20)) for i in range(6))
    near = "\n".join(" ".join(f"n{i}x{j}" for j in range(20)) for i in range(6))
    rows = [(i, exact, "en", "hot") for i in range(35)] + [(100 + i, f"{near}\nown{i}", "en", "hot") for i in range(35)]
    rows += [(200 + i, "site line all pages have\n" + " ".join(f"p{i}x{j}" for j in range(60)), "en", "hot") for i in range(35)]
    left = ngram_join.stage(spark, qr.stage(spark, documents(spark, rows), ""), "").collect()
    assert [r["text"] for r in left if r["doc_id"] < 100] == [exact]
    assert [r["text"].startswith(near) for r in left if 100 <= r["doc_id"] < 200] == [True]
    own = [r["text"] for r in left if r["doc_id"] >= 200]
    assert len(own) == 35 and sum("site line" in x for x in own) == 1
    # The operator itself counts documents, as its SQL does.
    assert not any(r["kept"] for r in qr.apply_rules(documents(spark, rows[:35])).collect())


def test_empty_table(spark):
    assert qr.apply_rules(documents(spark, [])).count() == 0
