"""Ordered operators: the one-task path and the block path against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestlens.operators import ordered, windows

BIG, SMALL = 1_000_000, 7  # SMALL forces blocks that split the groups


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(6)}"
        x = rng.choice([None, float(rng.randrange(5)), round(rng.uniform(0, 9), 2)])
        rows.append((key, i, x))
    rows += [("single", 500, 4.0), ("allnull", 501, None), ("allnull", 502, None)]
    df = table(spark, rows, "k string, i int, x double")
    return df, pd.DataFrame(rows, columns=["k", "i", "x"])


@pytest.mark.parametrize("task_rows", [BIG, SMALL])
def test_running_and_positions(skewed, task_rows):
    df, pdf = skewed
    got = ordered.running(df, ["k"], [F.col("i")], {"s": F.coalesce("x", F.lit(0.0)), "p": F.lit(1)}, task_rows=task_rows)
    got = got.toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "i"]).reset_index(drop=True)
    x = want["x"].fillna(0)
    want_s = x.groupby(want["k"]).cumsum() - x
    assert np.allclose(got["s"], want_s)
    assert (got["p"] == want.groupby("k").cumcount()).all()


def test_positions_without_keys(skewed):
    df, pdf = skewed
    got = ordered.positions(df, [], [F.col("i")], task_rows=SMALL).orderBy("i").toPandas()
    assert got["pos"].tolist() == list(range(len(pdf)))


@pytest.mark.parametrize("task_rows", [BIG, SMALL])
def test_fill_gaps(skewed, task_rows):
    df, pdf = skewed
    got = windows.fill_gaps(df, ["k"], [F.col("i")], ["x"], task_rows=task_rows).toPandas()
    got = got.sort_values(["k", "i"])["x"].to_numpy(dtype=float)
    want = pdf.sort_values(["k", "i"]).groupby("k")["x"].transform(
        lambda s: s.astype(float).interpolate(method="linear").ffill().bfill()).to_numpy()
    assert np.allclose(got, want, equal_nan=True)


def test_fill_gaps_hand_case(spark):
    df = table(spark, [(1, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "k int, i int, x double")
    got = [r.x for r in windows.fill_gaps(df, ["k"], [F.col("i")], ["x"]).orderBy("i").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    again = windows.fill_gaps(windows.fill_gaps(df, ["k"], [F.col("i")], ["x"]), ["k"], [F.col("i")], ["x"])
    assert [r.x for r in again.orderBy("i").collect()] == got


def brute_loo(values):
    out = []
    for i, x in enumerate(values):
        rest = np.array([v for j, v in enumerate(values) if j != i and v is not None], dtype=float)
        if x is None or len(rest) == 0:
            out.append(None)
            continue
        q1, q2, q3 = np.percentile(rest, [25, 50, 75])
        out.append(0.0 if q3 == q1 else (x - q2) / ((q3 - q1) / 1.349))
    return out


@pytest.mark.parametrize("task_rows", [BIG, SMALL])
def test_leave_one_out(skewed, task_rows):
    df, pdf = skewed
    got = windows.leave_one_out_z(df, ["k"], "x", "z", task_rows=task_rows).toPandas().set_index("i")["z"]
    for _, g in pdf.groupby("k"):
        values = [None if pd.isna(v) else v for v in g["x"]]
        for i, want in zip(g["i"], brute_loo(values)):
            if want is None:
                assert pd.isna(got[i])
            else:
                assert got[i] == pytest.approx(want, abs=1e-9)


def test_leave_one_out_hand_cases(spark):
    rows = [("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 30.0), ("a", 4, 40.0), ("a", 5, 100.0)]
    rows += [("b", i, v) for i, v in enumerate([5.0, 5.0, 5.0, 5.0, 9.0])] + [("c", 1, 3.0), (None, 1, 3.0), (None, 2, 4.0)]
    got = {(r.k, r.i): r.z for r in windows.leave_one_out_z(
        table(spark, rows, "k string, i int, x double"), ["k"], "x", "z").collect()}
    assert got[("a", 5)] == pytest.approx(6.745)
    assert got[("a", 1)] == pytest.approx(-1.226364, abs=1e-6)
    assert got[("b", 4)] == 0.0 and got[("c", 1)] is None and got[(None, 1)] is None


@pytest.mark.parametrize("task_rows", [BIG, SMALL])
def test_tie_ranks_and_percentiles(skewed, task_rows):
    df, pdf = skewed
    got = windows.tie_ranks(df, ["k"], "x", "r", task_rows=task_rows).toPandas().set_index("i")["r"]
    want = pdf.set_index("i").groupby("k")["x"].rank()
    assert np.allclose(got.sort_index(), want.sort_index(), equal_nan=True)
    p = ordered.exact_percentiles(df, ["k"], "x", {"a": 0.25, "b": 0.5, "c": 0.92}, task_rows=task_rows).toPandas().set_index("k")
    q = pdf.groupby("k")["x"].quantile([0.25, 0.5, 0.92]).unstack()
    for k in p.index:
        assert np.allclose(p.loc[k, ["a", "b", "c"]].to_numpy(float), q.loc[k].to_numpy(float))
    whole = ordered.exact_percentiles(df, [], "x", {"m": 0.5}, task_rows=task_rows).first()
    assert whole["m"] == pytest.approx(pdf["x"].median())


def test_zscore_cases(spark):
    rows = [("one", 1.0), ("const", 2.0), ("const", 2.0), ("two", 1.0), ("two", 3.0), (None, 1.0), (None, 2.0)]
    df = table(spark, rows, "k string, x double")
    plain = {(r.k, r.x): r.z for r in windows.group_zscore(df, ["k"], "x", "z", digits=3).collect()}
    assert plain[("one", 1.0)] is None and plain[("const", 2.0)] is None and plain[(None, 1.0)] is None
    assert plain[("two", 3.0)] == 0.707
    eps = {(r.k, r.x): r.z for r in windows.group_zscore(df, ["k"], "x", "z", epsilon=1e-6).collect()}
    assert eps[("const", 2.0)] == 0.0 and eps[("one", 1.0)] is None


def test_first_and_top(spark):
    df = table(spark, [(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 9, "z")], "k int, o int, v string")
    assert sorted(r.v for r in windows.first_per_key(df, ["k"], [F.col("o")]).collect()) == ["a", "z"]
    top = windows.top_n(df, ["k"], [F.col("o").desc()], 2, rank="rk")
    assert sorted((r.v, r.rk) for r in top.collect()) == [("b", 2), ("c", 1), ("z", 1)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
