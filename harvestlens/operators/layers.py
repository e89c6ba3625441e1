"""The three anomaly layers put together (Entry 3; P20-P26, M11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions import labels
from harvestlens.functions.columns import active_features
from harvestlens.operators import attribution, boosting, isolation, reports, windows
from harvestlens.session import cut


def baseline_layer(df: DataFrame, *, keys: tuple[str, ...] = ("fips", "commodity_name"), value: str = "yield_bu_ac",
                   threshold: float = config.Z_THRESHOLD) -> DataFrame:
    """Layer 1: leave-one-out robust score against the county's own history."""
    scored = windows.leave_one_out_z(df, list(keys), value, "yield_z_robust")
    return scored.withColumns({
        "z_anomaly": labels.two_sided_flag(F.col("yield_z_robust"), threshold),
        "z_direction": labels.direction(F.col("yield_z_robust"), threshold)})


def residual_layer(df: DataFrame, models: dict[str, boosting.CropModel], *, keys: tuple[str, ...] = ("fips", "commodity_name"),
                   crop: str = "commodity_name", value: str = "yield_bu_ac", threshold: float = config.Z_THRESHOLD) -> DataFrame:
    """Layer 2: gap to the weather model, standardised per county and crop."""
    if not models:
        return without_residuals(df)
    predicted = boosting.predict(df, models, crop=crop)
    gaps = predicted.withColumn("xgb_residual", labels.residual(F.col(value), F.col("xgb_predicted_yield")))
    # Hundreds of trees per row are walked once, not once for each pass over the residuals.
    return flag_residuals(cut(gaps), keys=keys, threshold=threshold)


def flag_residuals(gaps: DataFrame, *, keys: tuple[str, ...] = ("fips", "commodity_name"),
                   threshold: float = config.Z_THRESHOLD) -> DataFrame:
    scored = windows.group_zscore(gaps, list(keys), "xgb_residual", "xgb_residual_z", epsilon=config.Z_EPSILON)
    return scored.withColumns({
        "residual_anomaly": labels.low_flag(F.col("xgb_residual_z"), threshold),
        "residual_direction": labels.residual_direction(F.col("xgb_residual_z"), threshold)})


def without_residuals(df: DataFrame) -> DataFrame:
    """Layer 2 columns when no model is there."""
    empty = F.lit(None).cast("double")
    return df.withColumns({
        "xgb_predicted_yield": empty, "xgb_residual": empty, "xgb_residual_z": empty,
        "residual_anomaly": F.lit(False), "residual_direction": F.lit("WEATHER_EXPLAINED")})


def without_isolation(df: DataFrame) -> DataFrame:
    """Layer 3 columns when the layer is skipped."""
    return df.withColumns({"if_anomaly": F.lit(False), "if_anomaly_score": F.lit(None).cast("double")})


def isolation_by_crop(rows: DataFrame, models: dict[str, boosting.CropModel], key: list[str], *,
                      crop: str = "commodity_name", crops: list[str] = config.CROPS, drop_incomplete: bool = False,
                      **options) -> DataFrame:
    """Layer 3 with the inputs of each crop: the residual where it has a model, else its weather and yield.

    ``rows`` is a written table. Rows of other crops get no score.
    """
    fitted = [c for c in crops if c in models]
    parts = [(fitted, ["xgb_residual"])] if fitted else []
    for name in [c for c in crops if c not in models]:
        own = rows.where(F.col(crop) == name)
        features = active_features(own, [c for c in config.WEATHER_FEATURES if c not in config.ANSWERS_ONLY])
        parts.append(([name], [*features, "yield_bu_ac"]))
    frames = [isolation.isolation_layer(rows.where(F.col(crop).isin(names)), inputs, key, group=crop, groups=names,
                                        drop_incomplete=drop_incomplete, **options) for names, inputs in parts]
    other = rows.where(~F.coalesce(F.col(crop).isin(crops), F.lit(False)))
    if not drop_incomplete:
        frames.append(without_isolation(other).select(*rows.columns, "if_anomaly_score", "if_anomaly"))
    return reports.union_all(*frames)


def without_attribution(df: DataFrame) -> DataFrame:
    """Attribution columns when no model is there."""
    return df.withColumns({
        "shap_explanation": F.lit(""), "residual_explanation": F.lit(""), "top_driver": F.lit(""),
        "top_driver_shap": F.lit(None).cast("double")})


def combine(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_anomaly": labels.any_flag(F.col("z_anomaly"), F.col("residual_anomaly"), F.col("if_anomaly")),
        "anomaly_type": labels.anomaly_type(F.col("z_anomaly"), F.col("residual_anomaly"), F.col("if_anomaly"))})


def explain_flagged(flagged: DataFrame, models: dict[str, boosting.CropModel], *, crop: str = "commodity_name",
                    events: dict[int, str] = config.EXTREME_EVENTS, long_season_crop: str = "Corn") -> DataFrame:
    """Attribution, residual and context text for flagged rows, as columns of the same rows."""
    if models:
        drivers, known = F.col("drivers"), F.col("drivers").isNotNull()
        rows = attribution.attribute(flagged, models, crop=crop).withColumns({
            "shap_explanation": F.when(known, labels.driver_sentence(drivers)).otherwise(""),
            "residual_explanation": F.when(known, labels.residual_sentence(F.col("xgb_residual"), F.col("xgb_residual_z"))).otherwise(""),
            "top_driver": F.when(known, F.get(drivers, F.lit(0))["feature"]).otherwise(""),
            "top_driver_shap": F.when(known, F.get(drivers, F.lit(0))["value"]),
        }).drop("drivers", "base_value")
    else:
        rows = without_attribution(flagged)
    context = labels.weather_context(rows, crop=crop, long_season_crop=long_season_crop, events=events)
    return rows.withColumn("explanation", labels.full_explanation(
        F.col("yield_z_robust"), F.col("shap_explanation"), F.col("residual_explanation"), context))
