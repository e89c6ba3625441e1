"""Packed products and hard negatives against plain arithmetic."""

import math
import random

import numpy as np
import pytest
from compare import connect, difference, duck_rows, spark_rows
from pyspark.sql import functions as F

from harvestlens.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("low, high, dim", [(-160, 160, 64), (0, 1, 3), (-5, -1, 7), (0, 0, 4), (-2**20, 2**20, 5), (-2**27, 2**27, 6)])
def test_products(low, high, dim):
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (7, 33), (5, 0), (0, 4)):
        a, c = rng.integers(low, high + 1, (n, dim)), rng.integers(low, high + 1, (m, dim))
        assert hard_negatives.products(a, c).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in c] for r in a]


def test_products_beyond_64_bits():
    assert hard_negatives.products(np.array([[2**40]]), np.array([[2**20], [-(2**20)]])).tolist() == [[2**60, -(2**60)]]
    with pytest.raises(OverflowError):
        hard_negatives.products(np.array([[2**40]]), np.array([[2**40]]))


def brute(rows, positives=5, negatives=5):
    """Rows in the order of scores; of rows that cannot be told apart any may stand for the other."""
    used = []
    for i, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        used.append((i, [math.floor(256 * c) for c in x], label))
    order = lambda s: (-s[0], s[1] is None, s[1])
    out = []
    for k, (i, x, label) in enumerate(used):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), j, other) for m, (j, y, other) in enumerate(used) if m != k and len(x) == len(y)]
        for p, j, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            near = [s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p]
            out += [(i, j, rank, s[1], p, s[0]) for rank, s in enumerate(sorted(near, key=order)[:negatives], 1)]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def made(n, copies, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) + (i % 4) for _ in range(8)], rnd.randrange(4)) for i in range(n)]
    rows += [(rnd.randrange(n, 3 * n), rows[5][1], rnd.randrange(3)) for _ in range(copies)]
    return rows


ODD = [(None, [1.0] * 8, 1), (None, [0.5] * 8, 2), (300, [0.1] * 8, None), (300, None, 1), (400, [None] + [1.0] * 7, 1), (400, [math.nan] * 8, 1),
       (500, [math.inf] * 8, 2), (600, [1.0, 2.0], 1), (601, [1.0, 2.0], 2), (602, [1.0, 1.9], 1), (700, [], 1), (701, [], 2), (705, [], 2),
       (100, [0.7] * 8, 3), (100, [0.7] * 8, 3), (200, [-0.5] * 8, 2), (800, [0.0] * 8, 1)]


def mined(table, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.mine(table, F.col("vec_id") % 100 == 0, label=label, **options).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("small", [False, True])
def test_mine(spark, clashing, monkeypatch, small):
    if small:  # many chunks, blocks and broadcasts
        for name, size in (("CHUNK_ROWS", 40), ("PACKED_BYTES", 300), ("PART", 3), ("BROADCAST_BYTES", 400)):
            monkeypatch.setattr(hard_negatives, name, size)
    rows = made(350, 300, 2) + ODD
    table = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    got = mined(table)
    assert len(got) > 50 and got == brute(rows)
    assert mined(table, positives=2, negatives=1) == brute(rows, 2, 1)
    assert mined(table.repartition(5)) == got


def test_nothing_to_mine(spark):
    table = spark.createDataFrame(made(30, 0, 3), SCHEMA)
    assert mined(table.limit(0)) == mined(table.where("vec_id > 0")) == mined(table.withColumn("label", F.lit(None).cast("int"))) == []
    assert mined(table.where("vec_id in (0, 100)")) == []


def test_a_task_that_passes_on_early(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "KEPT_BYTES", 0)
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 50)
    rows = made(300, 50, 4)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = spark_rows(queries.QUERIES["op11_hard_negatives"](spark, folder))
    want = duck_rows(connect(folder), queries.ORACLES["op11_hard_negatives"])
    assert difference(got, want) is None and len(got[1] if isinstance(got, tuple) else got) > 0
