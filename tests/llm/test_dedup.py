"""Exact, near and passage deduplication against brute force."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from harvestlens.llm import exact_dedup, near_dedup, substring_dedup
from harvestlens.llm.components import components


@given(st.lists(st.integers(0, 2**56 - 1), max_size=60), st.lists(st.integers(0, 9), max_size=60))
def test_quotient_filters_merge_without_loss(a, b):
    def of(values):
        keys, counts = np.unique(np.array(values, np.uint64), return_counts=True)
        return exact_dedup.QuotientFilter.from_row(*exact_dedup.QuotientFilter.of(keys, counts).to_row())

    keys, counts = exact_dedup.QuotientFilter.merge([of(a), of(b), of(b)]).items()
    assert dict(zip(keys.tolist(), counts.tolist())) == dict(Counter(a) + Counter(b) + Counter(b))


def test_exact_groups(docs, clashing, corpus):
    rows = [*corpus, (900, corpus[3][1]), (901, corpus[3][1]), (901, corpus[3][1]), (None, corpus[3][1]), (None, "alone")]
    got = exact_dedup.exact_groups(clashing(docs(rows))).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.doc_id in own and r.group_size == len(own)
        assert r.keep_id == max((x for x in own if x is not None), default=None)
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[r.text_sha256] += 1
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    stay = exact_dedup.drop_copies(clashing(docs(rows)))
    assert stay.columns == clashing(docs(rows)).columns and stay.count() == len(groups)


def test_exact_groups_of_nothing(docs):
    assert exact_dedup.exact_groups(docs([])).count() == 0
    assert exact_dedup.drop_copies(docs([])).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {k: shingles(t) for k, t, *_ in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_near_groups(docs, clashing, corpus):
    rows = [*corpus, *[(2000 + i, corpus[7][1] + f" tail{i}") for i in range(12)]]
    expected = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(clashing(docs(rows))).collect()}
    assert got == expected
    stay = near_dedup.drop_similar(clashing(docs(rows)))
    assert {r.doc_id for r in stay.collect()} == {k for k, (_, c) in expected.items() if k == c}


def test_near_groups_through_other_members(docs, monkeypatch):
    """A chain in which neighbours are similar and others are not, in buckets split into small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "WIDER", 3)
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[4 * i:4 * i + 60])) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs(rows)).collect()}
    assert got == brute_components(rows)


def test_near_groups_of_odd_rows(docs):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, " "), (4, "x"), (5, "X")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(docs(rows)).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False)], key=str)
    assert near_dedup.near_groups(docs([])).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for share, low, high in ((0.95, 0, 200), (0.75, 350, 550), (0.1, 1000, 4096)):
        other = np.concatenate([base[: int(4000 * 2 * share / (1 + share))],
                                rng.integers(0, 2**63, 4000 - int(4000 * 2 * share / (1 + share)), dtype=np.uint64)])
        a, b = (near_dedup.odd_sketch(near_dedup.samples(x)).view(np.uint64) for x in (base, other))
        assert low <= np.bitwise_count(a ^ b).sum() <= high
    assert 540 < near_dedup.most_ones() < 570


def test_sketches_pass_what_is_similar():
    """Pairs of similarity 0.75 in texts of any length are never rejected, and most of 0.65 are."""
    rng = np.random.default_rng(2)
    passed = {0.75: [], 0.65: []}
    for share, found in passed.items():
        for n in [40, 200, 1000] * 60:
            both = int(np.ceil(2 * n * share / (1 + share)))
            x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = (near_dedup.odd_sketch(near_dedup.samples(y)).view(np.uint64) for y in (x[:n], x[n - both :]))
            found.append(np.bitwise_count(a ^ b).sum() <= near_dedup.most_ones())
    assert all(passed[0.75]) and np.mean(passed[0.65]) < 0.1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (100, 95), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(links.limit(0)).count() == 0


def brute_removal(rows):
    words = {k: (t or "").encode().split() for k, t, *_ in rows}
    first = {}
    for k in sorted(words):
        w = words[k]
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i:i + 13]), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < k:
                gone[i:i + 13] = [True] * 13
        out[k] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 4000])
def test_repeats_are_removed(docs, clashing, corpus, chunk_bytes):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text)
           for r in substring_dedup.remove_repeats(clashing(docs(corpus)), chunk_bytes=chunk_bytes).collect()}
    expected = brute_removal(corpus)
    assert sum(v[1] for v in expected.values()) > 300
    assert got == expected


def test_repeats_of_odd_rows(docs):
    text = " ".join(f"w{i}" for i in range(20))
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(
        docs([(None, text), (3, text), (3, text), (4, text), (5, None), (6, "")])).collect()), key=str)
    assert got == sorted([(None, 20, 0), (3, 20, 0), (3, 20, 0), (4, 20, 20), (5, 0, 0), (6, 0, 0)], key=str)
    assert substring_dedup.remove_repeats(docs([])).count() == 0
