"""The registered queries over the driver's tables, with their DuckDB twins.

Roles: events is the series (user_id a station or link, ts the instant, value rain or a signal level, event_type a type code,
props a JSON payload); a value of type 'error' counts as missing where null rules matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: DuckDB's events with a missing value where the type is 'error'.
E = "e AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)"


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle.strip()
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))


def r(c, digits: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def ntz(c):
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


from pluvia.jobs import datasets, evaluation, ingest, landed, links, series, spatial, stations, streams  # noqa: E402, F401
