"""Which chunks to fetch: by month, by 31 days; and validated ranges. Rows of a DataFrame, so that fetching can be spread."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def month_chunks(spark: SparkSession, stations: list[str], start: str, end: str) -> DataFrame:
    """station, month, first, last: whole months from that of start on; a month that begins at end is left out."""
    return month_plan(spark.createDataFrame([(s, start, end) for s in stations], "station string, start string, end string"))


def month_plan(ranges: DataFrame) -> DataFrame:
    """month_chunks() of each row of station, start, end."""
    r = ranges.select("station", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    months = F.sequence(F.trunc("start", "MM"), F.greatest("end", F.trunc("start", "MM")), F.expr("INTERVAL 1 MONTH"))
    found = r.withColumn("first", F.explode(months)).where(F.col("first") < F.col("end"))
    return found.select("station", F.date_format("first", "yyyy-MM").alias("month"), "first", F.least(F.last_day("first"), "end").alias("last"))


def day_chunks(spark: SparkSession, start: str, end: str, days: int = 31) -> DataFrame:
    """first, last (and both as yyyyMMdd): up to `days` days in one chunk; else chunks [s, s + days], the next one a day later, while s < end.

    A last single day that falls on end is left out, as in the rule that this follows.
    """
    one = spark.createDataFrame([("", start, end)], "station string, start string, end string")
    return day_plan(one, days).drop("station")


def day_plan(ranges: DataFrame, days: int = 31) -> DataFrame:
    """day_chunks() of each row of station, start, end."""
    s, e = F.col("s"), F.col("e")
    short = F.datediff(e, s) <= days
    many = F.filter(F.sequence(s, F.greatest(s, e), F.expr(f"INTERVAL {days + 1} DAYS")), lambda x: x < e)
    days_of = ranges.select("station", F.col("start").cast("date").alias("s"), F.col("end").cast("date").alias("e"))
    got = days_of.withColumn("first", F.explode(F.when(short, F.array(s)).otherwise(many))).select("station", "first", F.least(F.date_add("first", days), e).alias("last"))
    return got.select("station", "first", "last", F.date_format("first", "yyyyMMdd").alias("first_stamp"), F.date_format("last", "yyyyMMdd").alias("last_stamp"))


@dataclass
class ValidRange:
    start: datetime
    end: datetime
    long: bool


def valid_range(start: datetime, end: datetime, now: datetime) -> ValidRange:
    """end is no later than now; a start not before it becomes a week before; long: more than 31 days."""
    end = min(end, now)
    if start >= end:
        start = end - timedelta(days=7)
    return ValidRange(start, end, (end - start).days > 31)


def valid_ranges(ranges: DataFrame, now: str) -> DataFrame:
    """valid_range() of each row: start and end as timestamps put right, and long."""
    end = F.least(F.col("end"), F.lit(now).cast(ranges.schema["end"].dataType))
    start = F.when(F.col("start") >= F.col("__end"), F.col("__end") - F.make_dt_interval(F.lit(7))).otherwise(F.col("start"))
    got = ranges.withColumn("__end", end).withColumn("start", start).withColumn("end", F.col("__end")).drop("__end")
    return got.withColumn("long", F.floor((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 86_400_000_000) > 31)


#: Parameters of current conditions, and of their unit block in either system.
CURRENT = {
    "stationID": "Station ID", "obsTimeUtc": "Observation Time (UTC)", "obsTimeLocal": "Observation Time (Local)", "neighborhood": "Neighborhood", "softwareType": "Software Type",
    "country": "Country", "solarRadiation": "Solar Radiation (W/m²)", "lon": "Longitude", "realtimeFrequency": "Realtime Frequency", "epoch": "Epoch Time", "lat": "Latitude", "uv": "UV Index",
    "winddir": "Wind Direction (degrees)", "humidity": "Humidity (%)", "qcStatus": "QC Status",
}
IN_UNITS = {
    "temp": ("Temperature", "°C", "°F"), "heatIndex": ("Heat Index", "°C", "°F"), "dewpt": ("Dew Point", "°C", "°F"), "windChill": ("Wind Chill", "°C", "°F"), "windSpeed": ("Wind Speed", "km/h", "mph"),
    "windGust": ("Wind Gust", "km/h", "mph"), "pressure": ("Pressure", "mb", "in"), "precipRate": ("Precipitation Rate", "mm/hr", "in/hr"), "precipTotal": ("Precipitation Total", "mm", "in"), "elev": ("Elevation", "m", "ft"),
}


def parameters(spark: SparkSession) -> DataFrame:
    """system, parameter, description: the catalogue of what a station reports."""
    rows = [("current", k, v) for k, v in CURRENT.items()] + [(s, k, f"{v[0]} ({v[1 + i]})") for i, s in enumerate(("metric", "imperial")) for k, v in IN_UNITS.items()]
    return spark.createDataFrame(rows, "system string, parameter string, description string")
