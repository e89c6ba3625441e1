"""Joins under skew, and the nearest-county search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestlens.operators import joins, neighbours


def hot_table(spark, n=3000):
    rng = random.Random(1)
    return spark.createDataFrame(
        [(i, "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rng.randrange(900)}")) for i in range(n)], "i int, k string").repartition(6)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_attach_broadcast_and_split_agree(spark, how, null_safe):
    df = hot_table(spark)
    stats = df.groupBy("k").agg(F.sum("i").alias("total"), F.count("*").alias("w"))
    if how == "inner":
        stats = stats.where("k <> 'k1' or k is null")
    rows = [sorted(map(str, joins.attach(df, stats, ["k"], weight="w", how=how, null_safe=null_safe, small=s).collect()))
            for s in (10_000, 0)]
    assert rows[0] == rows[1]
    right = stats.withColumnRenamed("k", "k2")
    same = F.col("k").eqNullSafe(F.col("k2")) if null_safe else F.col("k") == F.col("k2")
    plain = df.join(right, same, how).select("i", "k", "total", "w")
    assert rows[0] == sorted(map(str, plain.collect()))


def test_attach_spreads_hot_rows(spark):
    df = hot_table(spark)
    stats = df.groupBy("k").agg(F.sum("i").alias("total"), F.count("*").alias("w"))
    out = joins.attach(df, stats, ["k"], weight="w", small=0)
    out.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "__slot" in plan


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_lookup_join_any_size(spark, how):
    df = hot_table(spark)
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "k string, v int")
    small, large = (sorted(map(str, joins.lookup_join(df, lookup, ["k"], how, rows=r).select(
        "i", *(["v"] if "v" in joins.lookup_join(df, lookup, ["k"], how).columns else [])).collect())) for r in (100, 0))
    assert small == large
    assert len(small) == df.join(lookup, ["k"], how).count()


def test_work_list_and_not_done(spark):
    places = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)], "fips string, lat double, lon double")
    work = joins.work_list(places, [2010, 2011])
    done = spark.createDataFrame([("a", 2010)], "fips string, year int")
    assert [(r.fips, r.year) for r in joins.not_done(work, done, ["fips", "year"]).collect()] == [("a", 2011)]


def test_missing_key(spark):
    with pytest.raises(KeyError):
        joins.with_centroids(spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("a", 1.0, 1.0)], "fips string, lat double, lon double"))


@pytest.mark.parametrize("tree_sites", [0, neighbours.TREE_SITES])  # 0: blocks along the curve
@pytest.mark.parametrize("shape", ["uniform", "clustered", "line", "far", "single"])
def test_nearest_equals_brute_force(spark, shape, tree_sites):
    rng = random.Random(7)
    if shape == "line":
        sites = [(f"s{i:03}", rng.uniform(0, 1000), 0.0) for i in range(80)]
    elif shape == "clustered":
        sites = [(f"s{i:03}", 40 + rng.gauss(0, 1e-4), -90 + rng.gauss(0, 1e-4)) for i in range(60)]
        sites += [(f"t{i:03}", rng.uniform(30, 50), rng.uniform(-100, -80)) for i in range(20)]
    elif shape == "single":
        sites = [("b", 40.0, -90.0), ("a", 40.0, -90.0)]
    else:
        sites = [(f"s{i:03}", round(rng.uniform(30, 50), 1), round(rng.uniform(-100, -80), 1)) for i in range(120)]
    scale = 40 if shape == "far" else 1
    points = [(i, 40 + scale * rng.uniform(-12, 12), -90 + scale * rng.uniform(-12, 12)) for i in range(150)]
    if shape == "line":
        points = [(i, rng.uniform(-50, 1050), rng.choice([0.0, 3.0])) for i in range(150)]
    points += [(1000, sites[0][1], sites[0][2]), (1001, None, 3.0), (1002, float("nan"), 3.0)]
    got = {r.i: r.fips for r in neighbours.nearest(
        spark.createDataFrame(points, "i int, lat double, lon double"),
        spark.createDataFrame(sites, "fips string, lat double, lon double"), tree_sites=tree_sites, block_sites=9).collect()}
    assert len(got) == len(points) and got[1001] is None and got[1002] is None
    for i, lat, lon in points[:-2]:
        best = min(((s[1] - lat) ** 2 + (s[2] - lon) ** 2, s[0]) for s in sites)
        assert got[i] == best[1]


def test_nearest_tie_takes_lowest_key(spark):
    sites = spark.createDataFrame([("b", 0.0, 1.0), ("a", 0.0, -1.0)], "fips string, lat double, lon double")
    points = spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    assert neighbours.nearest(points, sites).first()["fips"] == "a"


@pytest.mark.parametrize("shape", ["uniform", "clustered", "clusters"])
def test_few_boxes_and_sites_are_looked_at(shape):
    rng = np.random.default_rng(3)
    sites = {"uniform": rng.uniform(0, 50, size=(40_000, 2)),
             "clustered": np.vstack([rng.normal(size=(39_999, 2)) * 0.01, [[50.0, 50.0]]]),
             "clusters": rng.uniform(0, 50, size=(40, 2))[rng.integers(0, 40, 40_000)] + rng.normal(size=(40_000, 2)) * 0.05}[shape]
    points = rng.uniform(1, 49, size=(10_000, 2))
    tree = neighbours.BoxTree(sites)
    got, d2 = tree.nearest(points)
    assert tree.checked + tree.compared < 100 * len(points)
    for i in range(0, len(points), 25):
        d = ((sites - points[i]) ** 2).sum(axis=1)
        assert got[i] == d.argmin() and d2[i] == d.min()


def test_tree_of_equal_or_few_boxes(monkeypatch):
    assert neighbours.BoxTree(np.zeros((50, 2))).nearest(np.ones((3, 2)))[0].tolist() == [0, 0, 0]
    assert neighbours.BoxTree(np.zeros((1, 2))).nearest(np.zeros((0, 2)))[0].tolist() == []
    grid = np.array([(x, y) for x in range(9) for y in range(9)], float)
    ring = 4 + 4 * np.array([(np.cos(t), np.sin(t)) for t in np.linspace(0, 6.28, 200)])
    tree = neighbours.BoxTree(ring)
    whole = tree.nearest(grid)
    monkeypatch.setattr(neighbours, "PAIRS", 8)  # searched in parts
    parts = tree.nearest(grid)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    boxes = neighbours.BoxTree(grid, grid + 1)
    met = {(r, b) for rows, found, _ in boxes.within(np.array([[0.5, 0.5], [3.0, 3.0]]), np.zeros(2)) for r, b in zip(rows, found)}
    assert met == {(0, 0)} | {(1, x * 9 + y) for x in (2, 3) for y in (2, 3)}


def test_curve_visits_each_cell_once_and_steps_to_neighbours(spark):
    cells = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    rows = sorted((r.d, r.x, r.y) for r in cells.select("x", "y", neighbours.curve_position(F.col("x"), F.col("y")).alias("d")).collect())
    assert [r[0] for r in rows] == list(range(64))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))


def test_many_points_of_a_block_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 40)
    points = spark.range(500).select("id", (F.col("id") / 100).alias("lat"), F.lit(0.5).alias("lon"))
    sites = spark.range(60).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("fips"),
                                   (F.col("id") / 12).alias("lat"), F.lit(0.0).alias("lon"))
    some, all_ = (sorted(map(tuple, neighbours.nearest(points, sites, tree_sites=t, block_sites=15).collect())) for t in (0, 1000))
    assert some == all_ and len(some) == 500
