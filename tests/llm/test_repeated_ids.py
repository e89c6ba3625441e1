"""The stages of the pipeline on rows whose doc_id is null or repeats."""

from collections import Counter

import pytest
from test_dedup import brute_components

from harvestlens.llm import mixing, near_dedup, quality


def as_rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_copies_are_judged_by_their_own_text(docs, clashing):
    a, z = ("a b c d e f g h", "z y x w v u t s")
    rows = [(1, a), (1, z), (0, z), (None, a), (None, z + " r"), (None, None), (None, None), (5, ""), (5, " ")]
    got = as_rows(near_dedup.drop_similar(clashing(docs(rows))))
    assert got == Counter([(1, a), (0, z), (None, None), (None, None), (5, ""), (5, " ")])
    assert as_rows(near_dedup.drop_similar(docs([(3, a), (3, a), (None, a)]))) == Counter([(3, a)])
    assert near_dedup.drop_similar(docs([])).count() == 0


def test_near_copies_with_ids_taken_away(docs, corpus):
    """Ids of half of the rows are null or the same: as many rows stay as there are groups."""
    rows = [(None if i % 4 == 0 else 7 if i % 4 == 1 else k, t) for i, (k, t, *_) in enumerate(corpus)]
    groups = brute_components([(i, t) for i, (_, t) in enumerate(rows)])
    first = {}
    for i, (_, c) in groups.items():
        key = (rows[i][0] is None, rows[i][0] or 0)
        first[c] = min(first.get(c, key), key)
    got = Counter((r.doc_id is None, r.doc_id or 0) for r in near_dedup.drop_similar(docs(rows)).collect())
    assert got == Counter(first.values())


@pytest.fixture(scope="module")
def judged_rows():
    good = [(i, f"the quick brown fox number {i} jumps over the lazy dog near river {i % 7}", "en", "a") for i in range(400)]
    bad = [(1000 + i, "#|" * (20 + i % 9) + f"{i} zq", "en", "a") for i in range(40)]
    return good, bad


def test_verdicts_do_not_spread_to_other_rows(spark, docs, judged_rows):
    good, bad = judged_rows
    labels = spark.createDataFrame([(k, 1) for k, *_ in good[:200]], "doc_id long, quality int")
    known = {r.doc_id: r.kept for r in quality.classify(docs(good + bad), labels).collect()}
    assert not any(known[k] for k, *_ in bad) and sum(known[k] for k, *_ in good) > 0.5 * len(good)
    same_length = [t[: len(b[1])].ljust(len(b[1]), "e") for b, (_, t, *_) in zip(bad, good[200:])]
    for name in (None, 5000):  # bad rows, and good ones of the same id and length
        mixed = [(name, b[1], "en", "a") for b in bad] + [(name, t, "en", "a") for t in same_length]
        table = docs(good[:200] + mixed)
        verdict = Counter((r.doc_id, r.n_tokens, r.kept) for r in quality.classify(table, labels).collect())
        kept = quality.keep_good(table, labels)
        assert kept.count() == sum(n for (_, _, k), n in verdict.items() if k)
        assert not {r.text for r in kept.collect()} & {b[1] for b in bad}


def test_copies_shared_by_rows_of_one_id_are_the_same_every_time(docs):
    rows = [(9, f"word{i:03} two three", None, s) for i in range(40) for s in ("a", "b")] + [(None, f"x{i:02} y", None, "c") for i in range(30)]
    first = as_rows(mixing.take(docs(rows)))
    assert first == as_rows(mixing.take(docs(rows[::-1]).repartition(7)))
