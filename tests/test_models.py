"""Models, attribution, isolation, correlations and the three stages end to end."""

import gzip
import math
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.operators import attribution, boosting, correlation, isolation, layers
from harvestlens.plans import stages, views
from harvestlens.sources import files, tables

FAST = {"maxIter": 4, "maxDepth": 3}


@pytest.fixture(scope="module")
def crops(spark):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({
        "id": range(n), "commodity_name": np.where(np.arange(n) % 4 == 0, "Soybeans", "Corn"), "year": 2010 + np.arange(n) % 15,
        "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["yield_bu_ac"] = 5 * pdf["a"] + pdf["b"] ** 2 + rng.normal(size=n) / 5
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("id") % 50 != 7, F.col("b")))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def models(crops):
    return boosting.fit_crops(crops, ["a", "b"], params=FAST)


def test_predictions(crops, models, spark, tmp_path):
    out = boosting.predict(crops, models)
    assert out.count() == crops.count()
    assert out.where("b is null and xgb_predicted_yield is not null").count() == 0
    assert out.where("b is not null and xgb_predicted_yield is null").count() == 0
    boosting.save(models, str(tmp_path / "m"))
    again = boosting.load(spark, str(tmp_path / "m"), ["Corn", "Soybeans", "Rice"])
    assert set(again) == {"Corn", "Soybeans"} and again["Corn"].features == ["a", "b"]
    left, right = (sorted((r.id, r.xgb_predicted_yield) for r in o.where("b is not null").select("id", "xgb_predicted_yield").collect())
                   for o in (out, boosting.predict(crops, again)))
    assert left == right
    other = boosting.predict(crops, {"Corn": models["Corn"]})
    assert other.where("commodity_name = 'Soybeans' and xgb_predicted_yield is not null").count() == 0
    assert boosting.split_metrics(out, config.TRAIN_YEARS).count() == 4


def test_attribution_adds_up(crops, models):
    rows = boosting.predict(crops, models)
    parts = attribution.attribute(rows, models).select("b", "base_value", "drivers", "xgb_predicted_yield").collect()
    assert len(parts) == crops.count()
    for r in parts:
        if r.b is None:
            assert r.base_value is None and r.drivers is None
            continue
        assert r.base_value + sum(d.value for d in r.drivers) == pytest.approx(r.xgb_predicted_yield, abs=1e-9)
        assert abs(r.drivers[0].value) >= abs(r.drivers[1].value)
    top = attribution.global_attribution(rows, models).orderBy("crop", F.col("shap_mean_abs").desc()).collect()
    assert [(r.crop, r.feature) for r in top[:2]] == [("Corn", "a"), ("Corn", "b")] and {r.feature for r in top[2:]} == {"a", "b"}
    importance = boosting.importances(crops.sparkSession, models).groupBy("crop").agg(F.sum("xgb_importance").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0, abs=1e-3) for r in importance)


def test_models_with_other_features(crops, models):
    """A model without a feature of another predicts and explains rows that lack it."""
    both = {"Soybeans": models["Soybeans"]} | boosting.fit_crops(crops, ["a"], crops=["Corn"], params=FAST)
    rows = attribution.attribute(boosting.predict(crops, both), both).where("commodity_name = 'Corn' and b is null").collect()
    assert rows and all([d.feature for d in r.drivers] == ["a"] and r.xgb_predicted_yield is not None for r in rows)


def test_one_scan_for_all_crops(spark, crops, models, tmp_path):
    crops.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    for df in (boosting.predict(stored, models), attribution.attribute(stored, models), layers.explain_flagged(
            stored.withColumns({c: F.lit(0.5) for c in ("xgb_residual", "xgb_residual_z", "yield_z_robust")}), models)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "Exchange" not in plan


def tree_by_hand(x, y, names, depth, node=0, out=None):
    """Feature, threshold and value of every node, tried split by split over all distinct values."""
    out = {} if out is None else out
    best = (1e-9, None)
    for j in range(x.shape[1]) if depth else []:
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            gain = sum(y[s].sum() ** 2 / (s.sum() + 1) for s in (left, ~left)) - y.sum() ** 2 / (len(y) + 1)
            if gain > best[0] * (1 + 1e-12):
                best = gain, (j, t)
    out[node] = best[1], y.sum() / (len(y) + 1)
    if best[1]:
        left = x[:, best[1][0]] <= best[1][1]
        tree_by_hand(x[left], y[left], names, depth - 1, 2 * node + 1, out)
        tree_by_hand(x[~left], y[~left], names, depth - 1, 2 * node + 2, out)
    return out


def test_trees_are_the_best_splits(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"commodity_name": "Corn", "year": 2011, "a": rng.integers(0, 9, 300) * 1.0, "b": rng.integers(0, 40, 300) * 0.5})
    pdf["yield_bu_ac"] = np.round(pdf["a"] * 3 - (pdf["b"] - 9) ** 2 / 9 + rng.normal(size=300), 3)
    whole = {"maxIter": 2, "maxDepth": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0", "stepSize": 0.5}
    model = boosting.fit_crops(spark.createDataFrame(pdf), ["a", "b"], crops=["Corn", "Rice"], params=whole)
    assert set(model) == {"Corn"}
    model = model["Corn"]
    x, left = pdf[["a", "b"]].to_numpy(), pdf["yield_bu_ac"].to_numpy() - model.base
    for t in range(2):
        want = tree_by_hand(x, left, ["a", "b"], 3)
        for node, (split, value) in want.items():
            assert model.value[t, node] == pytest.approx(value / 2, abs=1e-6)
            assert (model.feature[t, node], model.threshold[t, node]) == (split or (-1, math.inf))
        before = model.base + 0.0
        only = boosting.CropModel("Corn", model.features, before, *(a[: t + 1] for a in (
            model.feature, model.threshold, model.gain, model.cover, model.value)))
        left = pdf["yield_bu_ac"].to_numpy() - only.predict(x)


def same_trees(a, b):
    return all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "threshold", "gain", "cover", "value"))


def test_tasks_and_passes_grow_the_same_trees(crops, monkeypatch):
    """Each model in a task, all models level by level over many blocks, and other partitions: the same trees."""
    params = {"maxIter": 5, "maxDepth": 4}
    alone = boosting.fit_models(crops, ["a", "b"], model="commodity_name", params=params)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    for rows, limit in ((crops, 0), (crops, 200), (crops.repartition(7), 0)):
        other = boosting.fit_models(rows, ["a", "b"], model="commodity_name", params=params, task_rows=limit)
        assert list(other) == list(alone) and all(same_trees(alone[c], other[c]) for c in alone)


def alike(a, b):
    """The same splits, and values that agree beyond the steps of a tally."""
    return (all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "threshold", "cover"))
            and all(np.allclose(getattr(a, k), getattr(b, k), rtol=1e-7, atol=1e-7) for k in ("gain", "value")))


def test_tallies_and_passes_grow_the_trees_of_a_task(crops, monkeypatch):
    """Models grown from tallies of their cells, and by passes over all rows when cells are many or nearly as many as rows."""
    params = {"maxIter": 5, "maxDepth": 4}
    alone = boosting.fit_models(crops, ["a", "b"], model="commodity_name", params=params)
    monkeypatch.setattr(boosting, "TALLY_ROWS", 50)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    ways = []
    for name in ("_grow_in_tasks", "_grow_from_tallies", "_grow_in_passes"):
        monkeypatch.setattr(boosting, name, lambda *a, plain=getattr(boosting, name), name=name: ways.append(name) or plain(*a))
    tally, passes = "_grow_from_tallies", "_grow_in_passes"
    for cells, rows, used in ((4096, 0.5, [tally]), (0, 0.5, [passes]), (4096, 8, [passes]), (200, 0.5, [tally, passes])):
        ways.clear()
        monkeypatch.setattr(boosting, "CELLS", cells)
        monkeypatch.setattr(boosting, "CELL_ROWS", rows)
        other = boosting.fit_models(crops.repartition(7), ["a", "b"], model="commodity_name", params=params, task_rows=0)
        assert list(other) == list(alone) and ways == used and all(alike(alone[c], other[c]) for c in alone)
        assert tally in used or all(same_trees(alone[c], other[c]) for c in alone)


def test_only_splits_come_to_the_driver(crops, monkeypatch):
    """In passes over all rows a level gives the driver its splits, not the sums by interval."""
    sizes, plain = [], boosting._grow

    def grow(plan, allowed, splits):
        def noted(*task):
            found = splits(*task)
            sizes.append(len(pickle.dumps(found)))
            return found

        return plain(plan, allowed, noted)

    monkeypatch.setattr(boosting, "CELLS", 0)
    monkeypatch.setattr(boosting, "_grow", grow)
    boosting.fit_models(crops, ["a", "b"], model="commodity_name", params=FAST, task_rows=0)
    assert len(sizes) == 12 and max(sizes) < 4_000


def test_exact_sums():
    key, values = np.array([0, 1, 0, 1]), np.array([2**60 + 1, -(2**60) - 3, 5, 1])
    assert boosting._exact(key, values, 3).tolist() == [2**60 + 6, -(2**60) - 2, 0]
    assert boosting._exact(key[:0], values[:0], 2).tolist() == [0, 0]


def test_quality_is_that_of_other_boosters(crops):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = crops.where("b is not null and commodity_name = 'Corn'")
    params = {"maxIter": 30, "maxDepth": 4, "stepSize": 0.1}
    train = rows.where("id % 3 > 0")
    model = boosting.fit_crops(train, ["a", "b"], crops=["Corn"], train_years=list(range(2010, 2025)),
                               params=params | {"featureSubsetStrategy": "1.0"})
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="v")
    other = GBTRegressor(featuresCol="v", labelCol="yield_bu_ac", predictionCol="p", seed=1, subsamplingRate=0.8, **params).fit(vectors.transform(train))
    test = rows.where("id % 3 = 0")
    scored = boosting.predict(other.transform(vectors.transform(test)), model)
    ours, theirs = (boosting.reports.regression_metrics(scored, "yield_bu_ac", c).first().r2 for c in ("xgb_predicted_yield", "p"))
    assert ours > 0.9 and ours > theirs - 0.02


def test_gain_adds_up_to_the_split_table(spark, models):
    boosting.model_table(spark, models).createOrReplaceTempView("model_rows")
    want = spark.sql("SELECT crop, feature, sum(gain) AS g, count(*) AS n FROM model_rows WHERE kind = 'split' GROUP BY crop, feature").collect()
    got = {(r.crop, r.feature): (r.total_gain, r.splits) for r in boosting.importances(spark, models).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {(r.crop, r.feature): (pytest.approx(r.g), r.n) for r in want}


def test_model_files(spark, models, tmp_path):
    boosting.save(models, str(tmp_path / "m"))
    table = spark.read.parquet(str(tmp_path / "m"))
    assert {r.crop: r.version for r in table.select("crop", "version").distinct().collect()} == {c: m.version for c, m in models.items()}
    plan = table.where(F.col("crop").isin(["Corn"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    again = boosting.load(spark, str(tmp_path / "m"), ["Soybeans"])
    assert list(again) == ["Soybeans"] and same_trees(again["Soybeans"], models["Soybeans"])
    assert all(np.array_equal(x, y) for x, y in zip(again["Soybeans"].edges, models["Soybeans"].edges))
    assert boosting.load(spark, str(tmp_path / "none"), ["Corn"]) == {}


def test_attribution_equals_definition():
    """Shapley values by enumerating coalitions over one hand-made tree."""
    feature, threshold = np.array([[0, 1, -1, -1, -1, -1, -1]]), np.array([[0.5, 0.0, *[math.inf] * 5]])
    cover, leaf = np.array([[10, 6, 4, 2, 4, 0, 0]]), np.array([[0.0, 0.0, 7.0, 1.0, 3.0, 0.0, 0.0]])
    model = boosting.CropModel("Corn", ["u", "v"], 0.0, feature, threshold, np.zeros((1, 7)), cover, leaf)
    base, leaves = attribution._leaves(model, range(1))
    got = attribution._contributions(np.array([[0.2, 1.0]]), attribution._tables(leaves))[0]

    def value(known):
        def walk(i):
            if feature[0, i] < 0:
                return leaf[0, i]
            if feature[0, i] in known:
                return walk(2 * i + 1 if [0.2, 1.0][feature[0, i]] <= threshold[0, i] else 2 * i + 2)
            return sum(cover[0, c] / cover[0, i] * walk(c) for c in (2 * i + 1, 2 * i + 2))
        return walk(0)

    assert base == pytest.approx(value(set())) and model.predict(np.array([[0.2, 1.0]]))[0] == 3.0
    assert got[0] == pytest.approx(((value({0}) - value(set())) + (value({0, 1}) - value({1}))) / 2)
    assert got[1] == pytest.approx(((value({1}) - value(set())) + (value({0, 1}) - value({0}))) / 2)


def test_contributions_of_many_leaves_at_their_borders(monkeypatch):
    """The look-up by intervals against each leaf's own tests, in several steps, for values on, between and beyond the borders."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(attribution, "LEAVES_AT_ONCE", 7)
    monkeypatch.setattr(attribution, "ROWS_AT_ONCE", 5)
    trees, depth, width = 6, 4, 3
    feature, threshold = np.full((trees, 31), -1), np.full((trees, 31), math.inf)
    cover, value = np.ones((trees, 31), int), rng.normal(size=(trees, 31))
    for t in range(trees):
        cover[t, 0] = 1000
        for i in range(2**depth - 1):
            feature[t, i], threshold[t, i] = rng.integers(width), rng.integers(-3, 4) / 2
            cover[t, 2 * i + 1] = max(1, cover[t, i] * rng.integers(1, 9) // 10)
            cover[t, 2 * i + 2] = max(1, cover[t, i] - cover[t, 2 * i + 1])
    model = boosting.CropModel("Corn", ["u", "v", "w"], 1.0, feature, threshold, np.zeros((trees, 31)), cover, value)
    _, leaves = attribution._leaves(model, range(trees))
    tables = attribution._tables(leaves)
    x = rng.integers(-5, 6, (60, width)) / 2
    want = np.zeros_like(x)
    for features, low, high, table in tables:
        for i, row in enumerate(x):
            for leaf in range(len(features)):
                holds = (row[features[leaf]] > low[leaf]) & (row[features[leaf]] <= high[leaf])
                want[i, features[leaf]] += table[leaf, holds @ (1 << np.arange(features.shape[1]))]
    look = attribution.Lookup(tables, width)
    assert np.allclose(look(x), want, rtol=0, atol=1e-12)
    assert look(x[:0]).shape == (0, width)


def test_equal_rows_are_computed_once():
    asked = []

    def of(x):
        asked.append(len(x))
        return x.sum(axis=1)

    ask = boosting.Remembered(of, most=3)
    x = np.array([[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]])
    assert ask(x).tolist() == [3.0, 7.0, 3.0] and ask(x[::-1]).tolist() == [3.0, 7.0, 3.0] and asked == [2]
    assert ask(np.array([[0.0, 1.0], [1.0, 2.0], [0.0, 0.5]])).tolist() == [1.0, 3.0, 0.5] and asked == [2, 2]
    assert ask(x).tolist() == [3.0, 7.0, 3.0] and asked == [2, 2, 2]  # four rows were more than it keeps


def test_attribution_of_a_season_shared_by_many_rows(spark, models):
    """Rows of a season have the contributions that the season has alone."""
    seasons = spark.createDataFrame([("Corn", 0.25, -1.0), ("Corn", 1.5, 0.5)], "commodity_name string, a double, b double")
    rows = seasons.crossJoin(spark.range(3000)).coalesce(1)
    one = {(r.a, r.b): r for r in attribution.attribute(seasons, models).collect()}
    parts = attribution.attribute(rows, models)
    assert parts.count() == 6000
    for r in parts.select("a", "b", "base_value", "drivers").distinct().collect():
        assert (r.base_value, r.drivers) == (one[r.a, r.b].base_value, one[r.a, r.b].drivers)
    assert parts.select("a", "b", "base_value", "drivers").distinct().count() == 2


def test_folds_are_contiguous(spark):
    df = spark.range(23).repartition(4)
    rows = boosting.contiguous_folds(df, [F.col("id")], 5, task_rows=6).orderBy("id").collect()
    assert [r.fold for r in rows] == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4


def test_folds_of_groups(spark):
    df = spark.range(30).withColumn("g", F.when(F.col("id") < 23, "x").otherwise("y")).repartition(4)
    rows = boosting.contiguous_folds(df, [F.col("id")], 5, keys=["g"]).orderBy("id").collect()
    assert [r.fold for r in rows] == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4 + [0, 0, 1, 1, 2, 3, 4]


def test_cross_validation(crops):
    scores = boosting.cross_validate(crops, ["a", "b"], [F.col("id")], keys=["commodity_name"], params=FAST).collect()
    assert sorted((r.commodity_name, r.fold) for r in scores) == [(c, i) for c in ("Corn", "Soybeans") for i in range(5)]
    assert sum(r.n for r in scores if r.commodity_name == "Corn") == 438
    # A fold of its own: the other folds' rows under a model of the same name.
    corn = boosting.contiguous_folds(crops.where("commodity_name = 'Corn' and b is not null"), [F.col("id")])
    name = "2\x1fCorn"
    model = boosting.fit_models(corn.withColumn("__model", F.lit(name)).where("fold <> 2"), ["a", "b"], model="__model", params=FAST)
    held = boosting.predict(corn.where("fold = 2").withColumn("__model", F.lit(name)), model, crop="__model", out="p")
    alone = boosting.reports.regression_metrics(held, "yield_bu_ac", "p").first()
    assert [(r.n, r.r2) for r in scores if (r.commodity_name, r.fold) == ("Corn", 2)] == [(alone.n, pytest.approx(alone.r2, abs=1e-12))]
    whole = boosting.cross_validate(crops.where("commodity_name = 'Corn'"), ["a", "b"], [F.col("id")], params=FAST)
    assert boosting.cv_summary(whole).first()["cv_r2_mean"] > 0.1


@pytest.mark.parametrize("copies", [1, 40])
def test_isolation_forest_finds_planted_rows(spark, copies):
    rng = np.random.default_rng(2)
    near = rng.normal(size=(1000, 2))
    far = rng.normal(size=(10, 2)) + 15
    x = np.vstack([near, far])
    pdf = pd.DataFrame({"id": np.arange(len(x)) // copies, "g": "Corn", "u": x[:, 0], "v": x[:, 1]})
    pdf.loc[len(pdf)] = [9999, "Corn", None, 1.0]
    schema = "id long, g string, u double, v double"
    out = isolation.isolation_layer(spark.createDataFrame(pdf, schema).repartition(5), ["u", "v"], ["id"], group="g", groups=["Corn"], trees=60)
    rows = out.toPandas()
    assert len(rows) == len(pdf)
    assert rows["if_anomaly"].sum() == pytest.approx(0.08 * 1010, abs=3)
    assert rows[rows["u"] > 8]["if_anomaly"].all()
    assert rows[rows["u"].isna()]["if_anomaly_score"].isna().all() and not rows[rows["u"].isna()]["if_anomaly"].any()
    if copies == 1:
        again = isolation.isolation_layer(spark.createDataFrame(pdf, schema).repartition(2), ["u", "v"], ["id"], group="g", groups=["Corn"],
                                          trees=60, drop_incomplete=True).toPandas()
        assert len(again) == len(pdf) - 1
        both = rows.dropna().set_index("id")["if_anomaly_score"].sort_index() - again.set_index("id")["if_anomaly_score"].sort_index()
        assert np.abs(both).max() < 1e-12


@pytest.mark.parametrize("width", [1, 2, 4])
def test_leaves_by_grid_are_those_of_the_walk(width, monkeypatch):
    """Path lengths from grids equal those of the walk to the last bit, also on borders and where a grid would be too large."""
    rng = np.random.default_rng(width)
    x = np.round(rng.normal(size=(500, width)), 1)
    trees = []
    for t in range(8):
        nodes = list(zip(*isolation._grow(x[rng.choice(500, 64, replace=False)], np.random.default_rng([3, t]))))
        trees.append(tuple(np.array(a) for a in nodes))
    borders = np.array([[t[3][np.flatnonzero(t[0] >= 0)[0]]] * width for t in trees])
    rows = np.concatenate([x, borders, np.full((1, width), 9.0), np.full((1, width), -np.inf)])
    want = sum(isolation._walked(rows, t) for t in trees) / len(trees)
    forest = isolation.Forest(trees, width)
    assert np.array_equal(forest(rows), want) and forest.grids is None
    monkeypatch.setattr(isolation, "WALKED_ROWS", 0)
    assert np.array_equal(forest(rows), want) and len(forest.grids) == 8
    monkeypatch.setattr(isolation, "GRID_CELLS", 10)
    assert np.array_equal(isolation.Forest(trees, width)(rows), want)


@pytest.mark.parametrize("n", [100, 700, 5000, 40_000])
def test_forest_rows_choose_their_trees(spark, n):
    rows = spark.range(n).select("id", F.lit("Corn").alias("g"), (F.col("id") * 1.0).alias("u"))
    trees, size = 60, 64
    made = isolation.tree_choices(rows, "g", ["id"], ["u"], trees=trees, size=size, seed=5)
    assert made.count() <= 4 * trees * size
    drawn = isolation.tree_samples(rows, "g", ["id"], ["u"], trees=trees, size=size, seed=5).toPandas()
    per_tree = drawn.groupby("tree")["u"]
    assert len(per_tree) == trees and (per_tree.size() == min(n, size)).all() and (per_tree.nunique() == min(n, size)).all()
    assert drawn["u"].mean() == pytest.approx((n - 1) / 2, rel=0.06)
    first, second = drawn[drawn.tree < 30], drawn[drawn.tree >= 30]
    assert first["u"].mean() == pytest.approx(second["u"].mean(), rel=0.12)
    again = isolation.tree_samples(rows.repartition(7), "g", ["id"], ["u"], trees=trees, size=size, seed=5).toPandas()
    assert sorted(map(tuple, again[["tree", "u"]].to_numpy())) == sorted(map(tuple, drawn[["tree", "u"]].to_numpy()))


def numeric_p(r, n):
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    grid = np.linspace(0, t, 400_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + grid**2 / df) ** (-(df + 1) / 2)
    return 1 - 2 * np.trapezoid(density, grid)


def test_p_value(spark):
    pairs = [(0.5, 20), (-0.626, 40), (0.05, 3000), (0.9, 5), (0.01, 25), (-0.2, 100)]
    rows = pairs + [(0.0, 9), (1.0, 9), (-1.0, 9), (0.3, 2), (None, 9), (float("nan"), 9), (1e-5, 10**9)]
    df = spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(rows)], "i int, r double, n long")
    out = df.select("i", correlation.p_value("r", "n").alias("p"))
    got = [r.p for r in out.orderBy("i").collect()]
    for (r, n), p in zip(pairs, got):
        assert p == pytest.approx(numeric_p(r, n), abs=2e-6)
    assert got[6:12] == [1.0, 0.0, 0.0, None, None, None]
    assert got[12] == pytest.approx(0.751830, abs=1e-5)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_rank_correlation_by_null_pattern(spark):
    rng = np.random.default_rng(12)
    n = 400
    pdf = pd.DataFrame({"g": np.where(np.arange(n) < 250, "Corn", None), "x": rng.integers(0, 40, n).astype(float)})
    for i in range(70):  # more than fit into one long
        pdf[f"f{i}"] = pdf["x"] * (i % 3 - 1) + rng.integers(0, 30, n)
        pdf.loc[rng.random(n) < 0.2 if i % 10 == 9 else pdf.index % 5 == i % 2, f"f{i}"] = None
    pdf.loc[::17, "x"] = None
    features = [f"f{i}" for i in range(70)]
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(["g string", "x double", *[f"{f} double" for f in features]]))
    got = [{(r.crop, r.feature): (r.n, round(r.r, 9)) for r in correlation.spearman(df, "g", "x", features, task_rows=t).collect()}
           for t in (10**6, 20)]
    assert got[0] == got[1] and len(got[0]) == 140
    for crop, part in (("Corn", pdf[pdf.g == "Corn"]), (None, pdf[pdf.g.isna()])):
        for f in features:
            both = part[["x", f]].astype(float).dropna()
            assert got[0][crop, f] == (len(both), pytest.approx(both["x"].rank().corr(both[f].rank()), abs=1e-8))
    assert correlation.spearman(df.limit(0), "g", "x", features[:2]).count() == 0


def test_correlations(spark):
    rng = np.random.default_rng(4)
    n = 90
    pdf = pd.DataFrame({"commodity_name": np.where(np.arange(n) < 60, "Corn", "Soybeans"), "yield_bu_ac": rng.integers(0, 20, n).astype(float)})
    pdf["f"] = pdf["yield_bu_ac"] + rng.integers(0, 8, n)
    pdf["flat"] = 3.0
    pdf["few"] = np.where(np.arange(n) % 60 < 19, rng.normal(size=n), np.nan)
    df = spark.createDataFrame(pdf).withColumn("few", F.nanvl("few", F.lit(None).cast("double")))
    small = {(r.crop, r.feature): r for r in correlation.correlations(df, ["f", "flat", "few"]).collect()}
    large = {(r.crop, r.feature): r for r in correlation.correlations(df, ["f", "flat", "few"], task_rows=5).collect()}
    assert small == large
    assert {f for _, f in small} == {"f", "flat"}
    for crop, part in pdf.groupby("commodity_name"):
        row = small[(crop, "f")]
        assert row.pearson_r == pytest.approx(part["yield_bu_ac"].corr(part["f"]), abs=6e-4)
        assert row.spearman_r == pytest.approx(part["yield_bu_ac"].rank().corr(part["f"].rank()), abs=6e-4)
        assert small[(crop, "flat")].pearson_r is None


def test_missing_layers(spark):
    df = spark.createDataFrame([("x", "Corn", 2012, 10.0)], "fips string, commodity_name string, year int, yield_bu_ac double")
    row = layers.combine(layers.without_isolation(layers.residual_layer(layers.baseline_layer(df), {}))).first()
    assert row.is_anomaly is False and row.anomaly_type == "NORMAL" and row.residual_direction == "WEATHER_EXPLAINED"


def test_scratch_spaces_of_threads_are_apart(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from harvestlens.session import cut, scratch_space

    meet = Barrier(2)

    def stage(wait):
        with scratch_space(spark) as space:
            meet.wait()
            held = cut(spark.range(5))
            if wait:
                meet.wait()
            assert all(space in f for f in held.inputFiles()) and held.count() == 5
        if not wait:
            meet.wait()

    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(stage, w) for w in (True, False)]:
            done.result(timeout=120)


def test_three_stages(spark, tmp_path):
    """CSV, stations and year files in; yields, weather, correlations, importance and anomalies out."""
    rng = np.random.default_rng(9)
    places = [(f"19{i:03}", 40 + i / 2, -95 + i / 3) for i in range(1, 7)]
    years = list(range(2010, 2020))
    folder = tmp_path / "daily"
    folder.mkdir()
    with open(folder / "ghcnd-stations.txt", "w") as f:
        for i, (_, lat, lon) in enumerate(places):
            for k in range(2):
                f.write(f"{f'US{i}{k}':<11} {lat + 0.05 * k:8.4f} {lon:9.4f} {'10.0':>6} IA {'NAME':<30}\n")
    heat = {}
    for y in years:
        with gzip.open(folder / f"{y}.csv.gz", "wt") as f:
            for i in range(len(places)):
                heat[(i, y)] = rng.integers(0, 60)
                for k in range(2):
                    for d in range(1, 32):
                        base = 250 + int(heat[(i, y)]) + d
                        for e, v in (("TMAX", base), ("TMIN", base - 120), ("PRCP", int(rng.integers(0, 90)))):
                            f.write(f"US{i}{k},{y}07{d:02},{e},{v},,,0,\n")
    header = ("Commodity Code,Commodity Name,State Code,State Name,State Abbreviation,County Code,County Name,Irrigation Practice Code,"
              "Irrigation Practice Name,Yield Year,Yield Amount")
    rows = []
    for i, (fips, _, _) in enumerate(places):
        for y in years:
            for crop, top in (("Corn", 180), ("Soybeans", 55)):
                for irr in ("Irrigated", "Non"):
                    amount = top - heat[(i, y)] / 2 + rng.normal()
                    rows.append(f"1, {crop} ,19,Iowa,IA,{int(fips[2:])},County {i},2,{irr},{y},{amount:.2f}")
    rows[5] = rows[5].rsplit(",", 1)[0] + ",n/a"
    (tmp_path / "yields.csv").write_text("\n".join([header, *rows]) + "\n")
    centroids = spark.createDataFrame(places, "fips string, lat double, lon double")
    yields = stages.yields_table(spark, str(tmp_path / "yields.csv"), centroids, str(tmp_path / "yields"), quality=str(tmp_path / "quality"))
    quality = {n: tables.read_table(spark, str(tmp_path / "quality" / n)) for n in ("profile", "crops", "description", "coverage")}
    crops = {r.commodity_name for r in yields.select("commodity_name").distinct().collect()}
    assert {r.commodity_name for r in quality["crops"].collect()} == crops == {r.commodity_name for r in quality["description"].collect()}
    assert quality["coverage"].first().n_rows == yields.count() and quality["profile"].count() >= 1
    assert yields.count() == len(rows) and yields.where("yield_bu_ac is null").count() == 1
    assert yields.where("lat is null").count() == 0
    weather = stages.weather_table(spark, yields, str(folder), [*years, 2030], str(tmp_path / "cache"), str(tmp_path / "weather"))
    assert weather.count() == len(places) * len(years)
    assert weather.where("precip_z is null or cwsi is null").count() == 0
    merged = stages.merged_table(spark, yields, weather, str(tmp_path / "merged"))
    assert merged.count() == len(rows)
    out = stages.correlation_tables(spark, merged, str(tmp_path), train_years=list(range(2010, 2018)), params=FAST)
    assert {r.crop for r in out["importance"].collect()} == {"Corn", "Soybeans"}
    assert out["correlations"].where("feature = 'tmax_mean_c' and pearson_r < -0.9").count() == 2
    result = stages.anomaly_table(spark, merged, str(tmp_path), trees=20)
    scored, anomalies = result["scored"], result["anomalies"]
    assert scored.count() == len(rows)
    flagged = scored.where("is_anomaly")
    assert anomalies.count() == flagged.count() > 0
    assert sorted(anomalies.columns) == sorted(config.ANOMALY_COLUMNS)
    assert anomalies.where("explanation is null or top_driver is null").count() == 0
    assert anomalies.where("explanation like 'Unexpectedly % | Model attribution: % | After weather effects% | Weather context: %'").count() == anomalies.count()
    types = {r.anomaly_type: r.n for r in anomalies.groupBy("anomaly_type").agg(F.count("*").alias("n")).collect()}
    assert sum(types.values()) == flagged.count() and "NORMAL" not in types
    assert files.read_stations(spark, str(folder / "ghcnd-stations.txt")).count() == 12

    names = {}
    for name in ("merged", "correlations", "importance", "anomalies"):
        names[name] = f"stagesdb.{name}"
        tables.register(spark, names[name], str(tmp_path / name))
    boards = views.dashboard_datasets(spark, names)
    assert {n: df.count() for n, df in boards.items()} == {
        "importance": out["importance"].count(), "correlations": out["correlations"].count(), "yield_trend": 20,
        "anomalies": min(500, anomalies.count())}
    drivers = views.top_drivers(out["importance"], out["correlations"]).collect()
    assert len(drivers) == 6 and all(r.label != r.feature for r in drivers)
    charts = views.chart_datasets(merged, scored, years=years)
    assert charts["heat_by_state"].count() == 1 and charts["yearly_box"].count() == 10 and charts["rain_sample"].count() == 119
    assert views.map_dataset(scored, 2012, "Corn").count() == 12
    curves = views.county_charts(scored, n=2)["Corn"].collect()
    counties = [r.fips for r in curves]
    assert len(set(counties)) <= 2 and counties == sorted(counties, key=counties.index)
    busiest = scored.where("is_anomaly").groupBy("fips").count().orderBy(F.col("count").desc(), "fips").first()
    assert counties[0] == busiest.fips and len(curves) == scored.where(F.col("fips").isin(counties) & (F.col("commodity_name") == "Corn")).count()
    quiet = views.county_charts(scored.withColumn("is_anomaly", F.lit(False)), n=2)["Corn"]
    assert quiet.select("fips").distinct().count() == 2
    report = views.anomaly_report(scored)
    assert report["by_year"].where("year = 2012 and event = 'Great Plains Drought'").count() == 1
    assert report["types"].agg(F.sum("n")).first()[0] == flagged.count()
    assert report["event_review"].count() == 2 and report["worst_unexplained"].count() <= 10


def test_model_queries_fit_whole_models(spark, monkeypatch):
    """Rounds, trees and rows per tree of the registered queries are those of the configuration."""
    import __spark_entry__ as entry
    from workloads import model_queries

    asked, empty = [], spark.createDataFrame(
        [], "obs_id long, commodity_name string, year int, yield_bu_ac double, precip_z double, xgb_residual double, "
        "if_anomaly_score double, if_anomaly boolean, residual_anomaly boolean, fold int, n long, r2 double")

    def boosted(df, *args, params=None, **options):
        asked.append(config.BOOSTING | (params or {}))
        return {} if "crops" in options else empty

    def isolated(df, *args, trees=config.ISOLATION_TREES, size=config.ISOLATION_ROWS, **options):
        asked.append((trees, size))
        return empty

    monkeypatch.setattr(model_queries.b, "merged", lambda *a: empty)
    monkeypatch.setattr(boosting, "fit_crops", boosted)
    monkeypatch.setattr(boosting, "cross_validate", boosted)
    monkeypatch.setattr(isolation, "isolation_layer", isolated)
    model_queries.fitted(spark, "nowhere")
    for name in ("m2_cross_validation", "m9_isolation_forest"):
        entry.queries()[name](spark, "nowhere")
    assert asked == [config.BOOSTING, config.BOOSTING, (config.ISOLATION_TREES, config.ISOLATION_ROWS)]
