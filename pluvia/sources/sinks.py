"""Writers: by station, combined, JSON, and the export of a cleaned series."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql.types import StructType

from pluvia.operators.stations import named_like, profile

#: How instants are written: to the microsecond, which is all that Spark keeps of them.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _writer(df: DataFrame, *folders: str, header: bool = True) -> DataFrameWriter:
    out = df.write.mode("overwrite").options(**TIMES)
    out = out.option("header", True) if header else out
    return out.partitionBy(*folders) if folders else out


def written(spark: SparkSession, path: str, schema: StructType | str, kind: str = "csv") -> DataFrame:
    """What a sink wrote, with the columns and instants that it had."""
    got = spark.read.schema(schema).options(**TIMES)
    return got.json(path) if kind == "json" else got.option("header", True).csv(path)


def by_station(df: DataFrame, path: str, key: str, *order: str) -> str:
    """CSV below a folder a station; a station with many rows is written by several tasks."""
    _writer(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order), key).csv(path)
    return path


def combined(df: DataFrame, path: str, *order: str) -> str:
    """One sorted CSV in as many parts as the data needs; their names are in the order of the rows."""
    _writer(df.orderBy(*order)).csv(path)
    return path


def json(df: DataFrame, path: str) -> bool:
    _writer(df, header=False).json(path)
    return True


def export(df: DataFrame, path: str, key: str, ts: str, raw: DataFrame | None = None, everything: bool = False) -> dict[str, str]:
    """clean, precipitation (key, time and columns named for it), profile, and the raw payloads as JSON; nothing unless `everything`.

    df is computed once: what follows the clean series is read back from it.
    """
    if not everything:
        return {}
    combined(df, f"{path}/clean", key, ts)
    done = written(df.sparkSession, f"{path}/clean", df.schema)
    combined(named_like(done, "precip", key, ts), f"{path}/precipitation", key, ts)
    _writer(profile(done)).csv(f"{path}/profile")
    kinds = ["clean", "precipitation", "profile"]
    if raw is not None:
        json(raw, f"{path}/raw")
        kinds.append("raw")
    return {k: f"{path}/{k}" for k in kinds}
