"""Declared schemas of the inputs (keys are always strings, so leading zeros survive)."""

from pyspark.sql import types as T


# Headers and field names of the input files and answers.


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


YIELD_NAMES = {
    "Commodity Code": "commodity_code", "Commodity Name": "commodity_name", "State Code": "state_code",
    "State Name": "state_name", "State Abbreviation": "state_abbr", "County Code": "county_code",
    "County Name": "county_name", "Irrigation Practice Code": "irr_code",
    "Irrigation Practice Name": "irr_name", "Yield Year": "year", "Yield Amount": "yield_bu_ac",
}

DAILY_CSV = T.StructType(
    _fields(["station_id", "date", "element"], T.StringType())
    + _fields(["data_value"], T.DoubleType())
    + _fields(["m_flag", "q_flag", "s_flag", "obs_time"], T.StringType())
)

DAILY_ARRAYS = [
    "temperature_2m_max", "temperature_2m_min", "precipitation_sum", "et0_fao_evapotranspiration",
    "shortwave_radiation_sum", "windgusts_10m_max",
]
ARRAYS_PAYLOAD = T.StructType([T.StructField("daily", T.StructType(
    [T.StructField("time", T.ArrayType(T.StringType()))]
    + [T.StructField(name, T.ArrayType(T.DoubleType())) for name in DAILY_ARRAYS]
))])

DAILY_MAPS = ["T2M_MAX", "T2M_MIN", "PRECTOTCORR", "ALLSKY_SFC_SW_DWN", "RH2M", "WS2M"]
MAPS_PAYLOAD = T.StructType([T.StructField("properties", T.StructType([T.StructField(
    "parameter", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))]))])
