"""Quantiles from sketches: within the stated error of the exact ones, whole or merged from parts."""

import numpy as np
from pyspark.sql import functions as F

from pluvia.operators import links, sketches


def made(spark, n=60_000):
    return spark.range(n).select("id", (F.col("id") % 3).cast("int").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 1000).alias("v"))


def test_quantiles_are_within_the_error(spark):
    df = made(spark)
    values = {k: np.sort([r.v for r in df.where(F.col("k") == k).collect()]) for k in range(3)}
    parts = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    days = sketches.by_day(df, ["k"], "t", "v")
    assert days.count() == 3 * 42
    for state in (sketches.merged(days, ["k"]), sketches.merged(sketches.by_day(df.repartition(9), ["k"], "t", "v"), ["k"])):
        got = sketches.quantiles(state, ["k"], parts).collect()
        assert len(got) == 18 and {r.n for r in got} == {20_000}
        for r in got:
            low, high = (np.searchsorted(values[r.k], r.value, side) / len(values[r.k]) for side in ("left", "right"))
            assert low - sketches.ERROR <= r.part <= high + sketches.ERROR
    there = sketches.rank(df, ["k"], "v", sketches.quantiles(sketches.merged(days, ["k"]), ["k"], [0.5])).collect()
    assert len(there) == 3 and all(abs(r.below - 0.5) < sketches.ERROR for r in there)


def test_nothing_and_missing_values(spark):
    df = made(spark, 100).withColumn("v", F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, float("nan")).otherwise(F.col("v")))
    assert sum(r.n for r in sketches.by_day(df, [], "t", "v").collect()) == 50
    assert sketches.quantiles(sketches.merged(sketches.by_day(df.limit(0), ["k"], "t", "v"), ["k"]), ["k"], [0.5]).count() == 0
    level = links.attenuation(made(spark, 3000), ["k"], "v", "sketch").select("k", "baseline").distinct().collect()
    exact = {r.k: r.baseline for r in links.attenuation(made(spark, 3000), ["k"], "v", "quantile").select("k", "baseline").distinct().collect()}
    assert len(level) == 3 and all(abs(r.baseline - exact[r.k]) < 2.0 for r in level)
