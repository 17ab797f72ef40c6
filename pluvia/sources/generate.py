"""Seeded synthetic series, made on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.expressions import projectile


def linspace(spark: SparkSession, start: float, end: float, n: int, out: str = "t") -> DataFrame:
    return spark.range(n).select((F.lit(start) + F.col("id") * (end - start) / max(1, n - 1)).alias(out))


def noisy_projectile(spark: SparkSession, n: int = 20, t_max: float = 2.0, h0: float = 1.0, v0: float = 10.0, g: float = 9.8, sd: float = 0.75, seed: int = 0) -> DataFrame:
    """t, truth, h: heights with normal noise."""
    t = linspace(spark, 0.0, t_max, n).withColumn("truth", projectile(F.col("t"), h0, v0, g))
    return t.withColumn("h", F.col("truth") + F.lit(sd) * F.randn(seed))


def signal_levels(spark: SparkSession, links: int, steps: int, step_s: int = 10, missing: float = 0.01, seed: int = 0) -> DataFrame:
    """sublink, ts, rsl, tsl: normal levels, a part of them missing."""
    ids = spark.range(links * steps).select((F.col("id") % links).cast("int").alias("sublink"), F.timestamp_seconds(F.lit(1_433_116_800) + F.floor(F.col("id") / links) * step_s).alias("ts"))
    return ids.select("sublink", "ts", F.when(F.rand(seed + 1) >= missing, F.lit(-50.0) + F.randn(seed) * 2).alias("rsl"), F.lit(10.0).alias("tsl"))
