"""Names, units and orders of columns, as data; and schemas of what is landed. The name tables are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions.expressions import clean_number

#: Fixed values, in canonical order: simple name, name in a station's observation, description, unit, kind.
STATION_COLUMNS = [
    ("precip_rate", "metric.precipRate", "Precipitation Rate", "mm/h or in/h", "float"),
    ("precip_total", "metric.precipTotal", "Precipitation Total", "mm or in", "float"),
    ("time_local", "obsTimeLocal", "Observation Time (Local)", "datetime", "datetime"),
    ("time_utc", "obsTimeUtc", "Observation Time (UTC)", "datetime", "datetime"),
    ("timestamp_unix", "epoch", "Unix Timestamp", "seconds since epoch", "int"),
    ("station_id", "stationID", "Weather Station ID", "string", "object"),
    ("latitude", "lat", "Latitude", "degrees", "float"),
    ("longitude", "lon", "Longitude", "degrees", "float"),
    ("timezone", "tz", "Time Zone", "string", "object"),
    ("temp_avg", "metric.tempAvg", "Temperature Average", "°C or °F", "float"),
    ("temp_high", "metric.tempHigh", "Temperature High", "°C or °F", "float"),
    ("temp_low", "metric.tempLow", "Temperature Low", "°C or °F", "float"),
    ("dewpoint_avg", "metric.dewptAvg", "Dew Point Average", "°C or °F", "float"),
    ("dewpoint_high", "metric.dewptHigh", "Dew Point High", "°C or °F", "float"),
    ("dewpoint_low", "metric.dewptLow", "Dew Point Low", "°C or °F", "float"),
    ("heat_index_avg", "metric.heatindexAvg", "Heat Index Average", "°C or °F", "float"),
    ("heat_index_high", "metric.heatindexHigh", "Heat Index High", "°C or °F", "float"),
    ("heat_index_low", "metric.heatindexLow", "Heat Index Low", "°C or °F", "float"),
    ("wind_chill_avg", "metric.windchillAvg", "Wind Chill Average", "°C or °F", "float"),
    ("wind_chill_high", "metric.windchillHigh", "Wind Chill High", "°C or °F", "float"),
    ("wind_chill_low", "metric.windchillLow", "Wind Chill Low", "°C or °F", "float"),
    ("humidity_avg", "humidityAvg", "Humidity Average", "%", "float"),
    ("humidity_high", "humidityHigh", "Humidity High", "%", "float"),
    ("humidity_low", "humidityLow", "Humidity Low", "%", "float"),
    ("wind_speed_avg", "metric.windspeedAvg", "Wind Speed Average", "km/h or mph", "float"),
    ("wind_speed_high", "metric.windspeedHigh", "Wind Speed High", "km/h or mph", "float"),
    ("wind_speed_low", "metric.windspeedLow", "Wind Speed Low", "km/h or mph", "float"),
    ("wind_gust_avg", "metric.windgustAvg", "Wind Gust Average", "km/h or mph", "float"),
    ("wind_gust_high", "metric.windgustHigh", "Wind Gust High", "km/h or mph", "float"),
    ("wind_gust_low", "metric.windgustLow", "Wind Gust Low", "km/h or mph", "float"),
    ("wind_direction_avg", "winddirAvg", "Wind Direction Average", "degrees (0-360)", "float"),
    ("pressure_max", "metric.pressureMax", "Pressure Maximum", "mb or inHg", "float"),
    ("pressure_min", "metric.pressureMin", "Pressure Minimum", "mb or inHg", "float"),
    ("pressure_trend", "metric.pressureTrend", "Pressure Trend", "mb or inHg", "float"),
    ("solar_radiation_high", "solarRadiationHigh", "Solar Radiation High", "W/m²", "float"),
    ("uv_index_high", "uvHigh", "UV Index High", "index", "float"),
    ("qc_status", "qcStatus", "Quality Control Status", "status code", "int"),
]
SIMPLE_NAMES = {raw: simple for simple, raw, *_ in STATION_COLUMNS}
RAW_NAMES = {simple: raw for simple, raw, *_ in STATION_COLUMNS}
STATION_ORDER = [simple for simple, *_ in STATION_COLUMNS]

_SQL = {"float": T.DoubleType(), "int": T.LongType(), "object": T.StringType(), "datetime": T.StringType()}
#: One observation as the service sends it.
OBSERVATION = T.StructType(
    [T.StructField(raw, _SQL[kind]) for _, raw, _, _, kind in STATION_COLUMNS if "." not in raw]
    + [T.StructField("metric", T.StructType([T.StructField(raw.split(".")[1], _SQL[kind]) for _, raw, _, _, kind in STATION_COLUMNS if "." in raw]))]
)

#: 1-minute airport CSV as landed: all strings.
ASOS_RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("station", "valid(UTC)", "tmpf", "dwpf", "sknt", "drct", "gust_sknt", "gust_drct", "ptype", "precip")])
ASOS_METRIC = T.StructType(
    [T.StructField("datetime", T.TimestampType()), T.StructField("station_id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("temp_c", "dewpoint_c", "wind_speed_ms", "wind_dir_deg", "wind_gust_ms", "wind_gust_dir_deg")]
    + [T.StructField("precip_type", T.StringType()), T.StructField("precip_category", T.StringType()), T.StructField("precip_mm", T.DoubleType())]
)
CML_LONG = T.StructType([T.StructField("sublink", T.IntegerType()), T.StructField("ts", T.TimestampType()), T.StructField("rsl", T.DoubleType()), T.StructField("tsl", T.DoubleType())])
RADAR_LONG = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("data", T.ShortType())])


def conform(df: DataFrame, schema: T.StructType, sentinel: float | None = None) -> DataFrame:
    """Exactly the schema's columns in its order: present ones cast where they can be, absent ones null; NaN and the sentinel null in numbers."""

    def one(f: T.StructField):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{f.name}`").try_cast(f.dataType)
        return (clean_number(c, sentinel) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c).alias(f.name)

    return df.select(*map(one, schema.fields))
