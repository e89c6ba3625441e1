"""Models and anomaly layers (M1-M11). Fits use the rounds and trees of ``config``; they read all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions.columns import settle
from harvestlens.operators import attribution, boosting, correlation, isolation, layers
from harvestlens.session import cut, scratch_path
from workloads import bases as b
from workloads.bases import R
from workloads.registry import query
from workloads.scalar_queries import pearson_sql

FOREST = {"trees": config.ISOLATION_TREES, "size": config.ISOLATION_ROWS}


def fitted(spark, d):
    """Merged rows, and models that were saved and loaded again."""
    rows = cut(b.merged(spark, d))
    folder = scratch_path(spark, "models")
    boosting.save(boosting.fit_crops(rows, b.ACTIVE, crops=b.CROPS, train_years=b.TRAIN_YEARS, params=config.BOOSTING), folder)
    return rows, boosting.load(spark, folder, b.CROPS)


@query("m1_boosted_fit")
def m1(spark, d):
    rows, models = fitted(spark, d)
    return boosting.split_metrics(boosting.predict(rows, models), b.TRAIN_YEARS)


@query("m2_cross_validation")
def m2(spark, d):
    rows = cut(b.merged(spark, d))
    scores = boosting.cross_validate(rows, [*b.ACTIVE, "year"], [F.col("obs_id")], keys=["commodity_name"], params=config.BOOSTING)
    return boosting.cv_summary(scores, ["commodity_name"])


@query("m3_model_reload")
def m3(spark, d):
    rows, models = fitted(spark, d)
    predicted = boosting.predict(rows, models)
    return predicted.groupBy("commodity_name").agg(F.count("xgb_predicted_yield").alias("n"), F.avg("xgb_predicted_yield").alias("mean"))


@query("m4_importance")
def m4(spark, d):
    _, models = fitted(spark, d)
    return boosting.importances(spark, models)


@query("m5_global_attribution")
def m5(spark, d):
    rows, models = fitted(spark, d)
    return attribution.global_attribution(rows, models)


@query("m6_predict_rows")
def m6(spark, d):
    rows, models = fitted(spark, d)
    return boosting.predict(rows, models).select("obs_id", "commodity_name", "xgb_predicted_yield")


@query("m7_local_attribution")
def m7(spark, d):
    rows, models = fitted(spark, d)
    flagged = layers.residual_layer(rows, models).where("residual_anomaly")
    return attribution.attribute(flagged, models).where("drivers IS NOT NULL").select(
        "obs_id", "base_value", F.slice("drivers", 1, 3).alias("drivers"), "xgb_predicted_yield")


@query("m8_standardise", b.with_(b.YIELDS) + f"""
SELECT obs_id, {R("(gappy_yield - avg(gappy_yield) OVER g) / stddev_pop(gappy_yield) OVER g", 6)} AS gappy_yield_std
FROM yields WINDOW g AS (PARTITION BY commodity_name)""")
def m8(spark, d):
    rows = isolation.standardise(b.yields(spark, d), ["commodity_name"], ["gappy_yield"])
    return rows.select("obs_id", settle(F.col("gappy_yield_std"), 6).alias("gappy_yield_std"))


@query("m9_isolation_forest")
def m9(spark, d):
    rows = cut(b.merged(spark, d).select("obs_id", "commodity_name", "yield_bu_ac", "precip_z"))  # read four times
    return isolation.isolation_layer(rows, ["yield_bu_ac", "precip_z"], ["obs_id"], groups=b.CROPS, **FOREST).select(
        "obs_id", "commodity_name", "if_anomaly_score", "if_anomaly")


@query("m10_importance_fallback", b.WM.rstrip() + ", r AS (" + pearson_sql(b.ACTIVE) + f""")
SELECT crop, feature, {R("abs(r)", 6)} AS xgb_importance, {R("abs(r)", 6)} AS shap_mean_abs FROM r WHERE n >= 20""")
def m10(spark, d):
    corr = correlation.pearson(b.merged(spark, d), "commodity_name", "yield_bu_ac", b.ACTIVE).where("n >= 20")
    return correlation.importance_from_correlations(corr.withColumn("abs_pearson", settle(F.abs("r"), 6)))


@query("m11_missing_layers", b.with_(b.YIELDS) + """
SELECT obs_id, CAST(NULL AS DOUBLE) AS xgb_residual, FALSE AS residual_anomaly, 'WEATHER_EXPLAINED' AS residual_direction,
       FALSE AS if_anomaly, CAST(NULL AS DOUBLE) AS if_anomaly_score, '' AS shap_explanation FROM yields""")
def m11(spark, d):
    rows = layers.without_attribution(layers.without_isolation(layers.residual_layer(b.yields(spark, d), {})))
    return rows.select("obs_id", "xgb_residual", "residual_anomaly", "residual_direction", "if_anomaly", "if_anomaly_score",
                       "shap_explanation")


@query("anomaly_layers_end_to_end")
def end_to_end(spark, d):
    """Three layers, types and explanations over all merged rows; the flagged ones are returned."""
    rows, models = fitted(spark, d)
    scored = layers.baseline_layer(layers.residual_layer(rows, models))
    isolated = isolation.isolation_layer(scored, ["xgb_residual"], ["obs_id"], groups=b.CROPS, **FOREST)
    flagged = cut(layers.combine(isolated)).where("is_anomaly")
    explained = layers.explain_flagged(flagged, models, events=b.EVENTS, long_season_crop="BUILDING")
    return explained.select("obs_id", "commodity_name", "year", "anomaly_type", "z_direction", "residual_direction", "top_driver", "explanation")


# Facts about the models that hold whatever numbers a fit gives, for all rows, beside their SQL twins.
WHOLE = " AND ".join(f"{f} IS NOT NULL" for f in b.ACTIVE)
TRAINED = f"year IN ({', '.join(map(str, b.TRAIN_YEARS))})"


@query("m1_fit_rows", b.WM + f"""
SELECT commodity_name, CASE WHEN {TRAINED} THEN 'train' ELSE 'test' END AS split, count(*) AS n
FROM merged WHERE {WHOLE} GROUP BY ALL""")
def m1_rows(spark, d):
    rows, models = fitted(spark, d)
    return boosting.split_metrics(boosting.predict(rows, models), b.TRAIN_YEARS).select("commodity_name", "split", "n")


@query("m2_folds", b.WM + f"""
, folds AS (SELECT commodity_name, obs_id, ntile(5) OVER (PARTITION BY commodity_name ORDER BY obs_id) - 1 AS fold
            FROM merged WHERE {WHOLE} AND yield_bu_ac IS NOT NULL)
SELECT commodity_name, CAST(fold AS INTEGER) AS fold, count(*) AS n, min(obs_id) AS first_obs, max(obs_id) AS last_obs
FROM folds GROUP BY commodity_name, fold""")
def m2_folds(spark, d):
    rows = cut(b.merged(spark, d).where(boosting.complete(b.ACTIVE) & F.col("yield_bu_ac").isNotNull()))
    folds = boosting.contiguous_folds(rows.where(F.col("commodity_name").isin(b.CROPS)), [F.col("obs_id")], keys=["commodity_name"])
    return folds.groupBy("commodity_name", "fold").agg(
        F.count("*").alias("n"), F.min("obs_id").alias("first_obs"), F.max("obs_id").alias("last_obs"))


@query("m3_reload_is_equal", b.WM + f"""
SELECT commodity_name, count(*) AS n, CAST(0 AS BIGINT) AS different FROM merged WHERE {WHOLE} GROUP BY commodity_name""")
def m3_equal(spark, d):
    """Predictions of a model that was saved again from its reloaded form, row by row."""
    rows, models = fitted(spark, d)
    folder = scratch_path(spark, "models")
    boosting.save(models, folder)
    first = boosting.predict(rows, models).select("obs_id", "commodity_name", F.col("xgb_predicted_yield").alias("x"))
    second = boosting.predict(rows, boosting.load(spark, folder, b.CROPS)).select("obs_id", F.col("xgb_predicted_yield").alias("y"))
    return first.join(second, "obs_id").where("x is not null").groupBy("commodity_name").agg(
        F.count("*").alias("n"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("different"))


@query("m4_importance_shares", b.WM + f"""
SELECT DISTINCT commodity_name AS crop, CAST({len(b.ACTIVE)} AS BIGINT) AS features, 1.0::DOUBLE AS total FROM merged""")
def m4_shares(spark, d):
    _, models = fitted(spark, d)
    return boosting.importances(spark, models).groupBy("crop").agg(
        F.count("feature").alias("features"), F.round(F.sum("xgb_importance"), 2).alias("total"))


@query("m6_predicted_rows", b.WM + f"""
SELECT obs_id, ({WHOLE}) AS predicted FROM merged""")
def m6_rows(spark, d):
    rows, models = fitted(spark, d)
    return boosting.predict(rows, models).select("obs_id", F.col("xgb_predicted_yield").isNotNull().alias("predicted"))


@query("m7_attribution_adds_up", b.WM + f"""
SELECT obs_id, 0.0::DOUBLE AS gap, CAST({len(b.ACTIVE)} AS BIGINT) AS drivers FROM merged WHERE {WHOLE}""")
def m7_adds_up(spark, d):
    """Base value and contributions against the prediction, for every row that can be predicted."""
    rows, models = fitted(spark, d)
    predicted = cut(boosting.predict(rows, models))
    total = F.col("base_value") + F.aggregate("drivers", F.lit(0.0), lambda t, x: t + x["value"])
    return attribution.attribute(predicted, models).where("drivers IS NOT NULL").select(
        "obs_id", (F.round(total - F.col("xgb_predicted_yield"), 6) + 0.0).alias("gap"), F.size("drivers").cast("long").alias("drivers"))


@query("m5_attribution_features", b.WM + f"""
SELECT DISTINCT commodity_name AS crop, CAST({len(b.ACTIVE)} AS BIGINT) AS features, TRUE AS none_below_zero FROM merged""")
def m5_features(spark, d):
    return m5(spark, d).groupBy("crop").agg(F.count("feature").alias("features"), F.min(F.col("shap_mean_abs") >= 0).alias("none_below_zero"))


@query("m9_scored_rows", b.WM + """
SELECT commodity_name, count(*) AS n, count(*) FILTER (WHERE precip_z IS NOT NULL) AS scored, TRUE AS share_is_right,
       CAST(0 AS BIGINT) AS depend_on_partitions
FROM merged GROUP BY commodity_name""")
def m9_rows(spark, d):
    """Rows with a score and the flagged share per crop, and rows that score otherwise on another partitioning."""
    rows = cut(b.merged(spark, d).select("obs_id", "commodity_name", "yield_bu_ac", "precip_z"))
    one, two = (isolation.isolation_layer(part, ["yield_bu_ac", "precip_z"], ["obs_id"], groups=b.CROPS, **FOREST)
                for part in (rows, rows.repartition(3, "obs_id")))
    both = one.join(two.select("obs_id", F.col("if_anomaly_score").alias("other")), "obs_id")
    share = F.count_if("if_anomaly") <= F.ceil(0.08 * F.count("if_anomaly_score")) + 1
    return both.groupBy("commodity_name").agg(
        F.count("*").alias("n"), F.count("if_anomaly_score").alias("scored"), share.alias("share_is_right"),
        F.count_if(F.abs(F.coalesce(F.col("if_anomaly_score"), F.lit(-1.0)) - F.coalesce("other", F.lit(-1.0))) > 1e-12).alias(
            "depend_on_partitions"))


@query("anomaly_types_add_up", b.WM + """
SELECT commodity_name, count(*) AS n, TRUE AS flagged_have_types, TRUE AS others_are_normal FROM merged GROUP BY commodity_name""")
def types_add_up(spark, d):
    """All three layers put together: every row is there, and the types are those of the flagged rows."""
    rows, models = fitted(spark, d)
    scored = cut(layers.baseline_layer(layers.residual_layer(rows, models)))
    done = layers.combine(layers.isolation_by_crop(scored, models, ["obs_id"], crops=b.CROPS, **FOREST))
    normal = F.col("anomaly_type") == "NORMAL"
    return done.groupBy("commodity_name").agg(
        F.count("*").alias("n"), F.min(~F.col("is_anomaly") | ~normal).alias("flagged_have_types"),
        F.min(F.col("is_anomaly") | normal).alias("others_are_normal"))
