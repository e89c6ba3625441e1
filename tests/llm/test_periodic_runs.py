"""Runs against their definition, trees against plain comparison, the query against a slow version of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from harvestlens.llm import common, periodic_runs, queries


def smallest_period(x):
    border = [0] * len(x)
    for i in range(1, len(x)):
        k = border[i - 1]
        while k and x[i] != x[k]:
            k = border[k - 1]
        border[i] = k + (x[i] == x[k])
    return len(x) - border[-1]


def brute_runs(x, least=24, times=3):
    """Every stretch with x[i] == x[i + q] throughout that no neighbour continues, if q is its smallest period."""
    out = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and smallest_period(x[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    rnd = random.Random(7)
    for _ in range(250):
        x = []
        while len(x) < rnd.choice([0, 5, 24, 60, 200]):
            root = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 13, 30]))]
            x += (root * rnd.choice([1, 1, 2, 3, 4, 9, 30]))[: rnd.choice([999, 25, 24, 23])]
        yield x
    yield [0] * 300
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b
    yield [i % 7 for i in range(100)] + [i % 7 for i in range(3, 90)]


def test_runs():
    for x in sequences():
        want = brute_runs(x)
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(x)).tolist()] == want
        hashes = common.mix(np.array(x, np.uint64) + np.uint64(1))
        assert [tuple(r) for r in periodic_runs.text_runs(hashes).tolist()] == want


@pytest.mark.parametrize("least, times", [(6, 3), (12, 4), (30, 5)])
def test_other_limits(least, times):
    for x in sequences():
        hashes = common.mix(np.array(x, np.uint64) + np.uint64(1))
        found = [tuple(r) for r in periodic_runs.text_runs(hashes, least, times).tolist()]
        assert found == brute_runs(x, least, times)


def test_regions_lie_apart_and_leave_prose_out():
    rnd = random.Random(1)
    prose = [rnd.randrange(300) for _ in range(3000)]
    passage = [rnd.randrange(300) for _ in range(100)]
    x = prose[:1000] + passage + prose[1000:2000] + passage + [1, 2, 3] * 20 + prose[2000:]
    found = periodic_runs.regions(common.mix(np.array(x, np.uint64)))
    assert len(found) == 1 and 2150 < found[0][0] <= 2200 and 2260 <= found[0][1] < 2300
    assert periodic_runs.regions(common.mix(np.array(prose, np.uint64))) == []


def test_suffix_tree():
    rnd = random.Random(2)
    for _ in range(60):
        x = [rnd.randrange(rnd.choice([1, 2, 4])) for _ in range(rnd.randint(1, 60))]
        tree = periodic_runs.SuffixTree(x)
        n = len(x)
        for opposite in (True, False):
            rank = tree.tour(opposite)
            key = (lambda i: [-c for c in x[i:]]) if opposite else (lambda i: x[i:])
            assert sorted(range(n + 1), key=key) == np.argsort(rank).tolist()
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        if pairs:
            i, j = np.array(pairs).T
            want = [next((k for k in range(n) if max(a, b) + k >= n or x[a + k] != x[b + k]), n) for a, b in pairs]
            assert tree.common(i, j).tolist() == want


def expected(doc_id, text, planted):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


def test_table(docs, clashing, corpus):
    rnd = random.Random(8)
    rows = [r for r in corpus if len(r[1] or "") < 50_000]
    for i in range(60):
        words = [f"w{rnd.randrange(40)}" for _ in range(rnd.randint(20, 80))]
        words[10:10] = [f"x{k}" for k in range(rnd.randint(1, 12))] * rnd.randint(2, 6)
        rows.append((rnd.choice([None, 300 + i, 300]), " ".join(words), None, None))
    table = clashing(docs(rows)).repartition(3)
    for planted in (True, False):
        got = periodic_runs.periodic_runs(table, NAMES, prepare=periodic_runs.plant if planted else None).collect()
        assert in_order(got) == in_order(expected(r[0], r[1], planted) for r in rows)
    whole = periodic_runs.periodic_runs(docs([(1, "a b " * 20 + "c", None, None)])).first()
    assert whole.collapsed == "a b c" and [tuple(r) for r in whole.runs] == [(0, 40, 2)]
    assert periodic_runs.periodic_runs(table.limit(0)).collect() == []


def test_very_long_text():
    words = [b"a", b"b", b"c"] * 40_000 + [b"%d" % i for i in range(1000)] * 4
    row = periodic_runs.describe(words, set())
    assert row["n_runs"] == 2 and (row["start"], row["length"], row["period"]) == (0, 120_000, 3)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = queries.QUERIES["op12_periodic_runs"](spark, folder).select("doc_id", *NAMES).collect()
    assert in_order(got) == in_order(expected(r.doc_id, r.text, True) for r in docs)
