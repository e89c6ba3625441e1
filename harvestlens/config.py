"""Analysis parameters. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

# Fixed values -----------------------------------------------------------------------------
CROPS = ["Corn", "Soybeans"]
YEAR_MIN, YEAR_MAX = 2010, 2024
TRAIN_YEARS = list(range(2010, 2023))
TEST_YEARS = [2023, 2024]
GROWING_MONTHS = list(range(4, 11))
FOCUS_STATES = ["IA", "IL", "IN", "MN", "OH", "NE", "KS", "MO", "SD", "ND"]
TARGET_STATES = [
    "AL", "AR", "CO", "DE", "IA", "IL", "IN", "KS", "KY", "LA", "MD", "MI", "MN", "MO", "MS", "NC",
    "ND", "NE", "NJ", "NY", "OH", "OK", "PA", "SC", "SD", "TN", "TX", "VA", "VT", "WI", "WV", "WY",
]
DAILY_ELEMENTS = ["TMAX", "TMIN", "PRCP", "AWND"]

Z_THRESHOLD = 1.5
CONTAMINATION = 0.08
MIN_COMMON_DAYS = 30
MIN_PAIRS = 20
HEAT_C = 35.0
DRY_MM = 0.5
GDD_BASE_C = 10.0
Z_EPSILON = 1e-6
IQR_TO_SIGMA = 1.349
HOT_DAYS = 20.0
LEAST_GDD = (1200.0, 900.0)
STRESS = 2.0

WEATHER_FEATURES = [
    "tmax_mean_c", "tmin_mean_c", "tavg_mean_c", "precip_total_mm", "gdd_base10", "heat_stress_days",
    "drought_days", "et0_total_mm", "solar_total_mj", "precip_z", "cwsi",
]
ANSWERS_ONLY = ["et0_total_mm", "solar_total_mj"]
IMPUTED_COLUMNS = [
    "tmax_mean_c", "tmin_mean_c", "tavg_mean_c", "precip_total_mm", "gdd_base10", "heat_stress_days",
    "drought_days",
]
EXTREME_EVENTS = {
    2012: "Great Plains Drought",
    2019: "Wet Spring / Prevent Plant",
    2021: "Western Drought / Heat Dome",
    2022: "Southern Heat Wave",
    2023: "Mixed conditions",
}
FEATURE_LABELS = {
    "heat_stress_days": "Heat Stress Days (Tmax > 35 °C)",
    "tmax_mean_c": "Mean Daily Maximum Temperature",
    "tmin_mean_c": "Mean Daily Minimum Temperature",
    "tavg_mean_c": "Mean Daily Average Temperature",
    "precip_total_mm": "Total Growing-Season Precipitation",
    "gdd_base10": "Growing Degree Days (base 10 °C)",
    "drought_days": "Drought Days (precip < 1 mm/day)",
    "precip_z": "Precipitation Anomaly (Z-score)",
    "cwsi": "Crop Water Stress Index (ET0 / precip)",
    "et0_total_mm": "Reference Evapotranspiration (ET0)",
    "solar_total_mj": "Total Solar Radiation",
    "wind_max_mean_ms": "Mean Wind Speed",
}
ANOMALY_TYPES = ["UNEXPLAINED", "WEATHER_DRIVEN", "RESIDUAL_ONLY", "ISOLATION_ONLY"]
ANOMALY_COLUMNS = [
    "fips", "state_abbr", "county_name", "commodity_name", "irr_name", "year", "yield_bu_ac",
    "xgb_predicted_yield", "xgb_residual", "xgb_residual_z", "yield_z_robust", "z_direction",
    "residual_direction", "anomaly_type", "z_anomaly", "residual_anomaly", "if_anomaly",
    "if_anomaly_score", "is_anomaly", "precip_total_mm", "gdd_base10", "heat_stress_days", "precip_z",
    "cwsi", "lat", "lon", "shap_explanation", "residual_explanation", "top_driver", "top_driver_shap",
    "explanation",
]
FALLBACK_CENTROIDS = [
    ("19013", 42.08, -93.54), ("19153", 41.65, -93.60), ("19085", 42.47, -92.32),
    ("17001", 40.16, -88.52), ("17019", 40.56, -88.87), ("18039", 40.20, -86.85),
    ("31055", 41.55, -97.59), ("27049", 44.30, -93.96), ("39047", 40.70, -83.59),
    ("20035", 38.39, -95.70),
]
GSOD_TABLES = ["samples.noaa.gsod", "noaa_gsod.noaa.gsod_stations_data", "noaa.gsod.gsod"]
# Boosted trees: rounds, depth, rate, row share, column share, seed.
BOOSTING = {
    "maxIter": 400, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8", "seed": 42,
}
ISOLATION_TREES = 300
ISOLATION_ROWS = 256
# ------------------------------------------------------------------------------------------
