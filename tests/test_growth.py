"""What grows no faster than its input: pairs, and rows that a task holds."""

import math
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from pluvia.jobs import catalog
from pluvia.operators import joins
from pluvia.sources import archive
from pluvia.streaming import series

from conftest import SF


def _counted(monkeypatch, name):
    made, plain = [], getattr(joins, name)
    monkeypatch.setattr(joins, name, lambda *a: made.append((got := plain(*a)).count()) or got)
    return made


def test_places_are_compared_once(spark, monkeypatch):
    made = _counted(monkeypatch, "within_km")
    links = spark.createDataFrame([(i, 40.0 + i % 2, -74.0) for i in range(50)], "link int, lat double, lon double")
    gauges = spark.createDataFrame([(40.01, -74.0)] * 1000, "g_lat double, g_lon double")
    got = joins.near_gauges(links, gauges, "link", ("lat", "lon"), ("g_lat", "g_lon"), 6.0)
    assert sorted(x.link for x in got.collect()) == list(range(0, 50, 2)) and made == [1]


def test_totals_are_scanned_before_the_spine(spark):
    plan = catalog.QUERIES["resample_hourly_running_total"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")  # from the top: the spine comes last


def test_archives_are_packed_by_a_stream(spark, tmp_path):
    rows = spark.range(30_000).select(F.concat(F.lit(f"{tmp_path}/z/"), F.col("id") % 2, F.lit(".zip")).alias("archive"), F.concat(F.lit("m/"), F.col("id") % 3, F.lit(".csv")).alias("member"), F.concat_ws(",", "id", F.col("id") / 2).alias("text"))
    archive.packed(rows, "id,half", {"README.txt": "no data"})
    got = archive.csv(spark, f"{tmp_path}/z", "id LONG, half DOUBLE").agg(F.count("*"), F.countDistinct("id"), F.sum("half"), F.count_if(F.expr("member = concat('m/', id % 3, '.csv')"))).first()
    assert tuple(got) == (30_000, 30_000, sum(range(30_000)) / 2, 30_000)
    assert archive.members(spark, f"{tmp_path}/z").count() == 8



def test_nearest_within_meets_few_pairs(spark, monkeypatch):
    made = _counted(monkeypatch, "within")
    r = random.Random(1)
    at = [(r.gauss(0, 0.004), r.gauss(0, 0.004)) for _ in range(1500)] + [(0.5, 0.5)] * 3 + [(0.5, 0.515), (0.9, 0.9), (None, 0.0), (float("inf"), 0.0), (float("inf"), 0.0)]
    got = joins.nearest_within(spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id int, x double, y double"), "id", ("x", "y"), 0.02).collect()
    want = {}
    for i, (x, y) in enumerate(at[:1505]):
        near = min(((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, (u, v) in enumerate(at[:1505]) if j != i))
        if near[0] <= 0.02:
            want[i] = near[1]
    assert {x.id: x.other for x in got} == want and len(got) == len(want)
    assert sum(made) < 40 * len(at)


def _emitted(spark, rows, name):
    with series.rocksdb(spark):
        q = rows.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress]
    return spark.table(name), max(timers)


def test_rolling_calls_its_state_by_bucket(spark, tmp_path):
    """3,000 series of two rows: timers and calls of the state are as many as buckets at most."""
    rows = spark.range(6000).select((F.col("id") % 3000).alias("k"), F.timestamp_seconds(F.col("id") + 1).alias("t"), F.floor(F.col("id") / 3000).cast("double").alias("v"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    got, timers = _emitted(spark, series.rolling_deviation(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "k", "t", "v", 8, "1 second"), "by_bucket")
    assert got.schema["k"].dataType == rows.schema["k"].dataType
    assert sorted(map(tuple, got.groupBy("v", "sigma").count().collect())) == [(0.0, 0.0, 3000), (1.0, 0.5, 2999)]
    assert timers <= 1024


def test_series_of_a_bucket_stay_apart(spark, tmp_path):
    """All series in one bucket, over several batches, with a null key, missing values, ties and rows out of order."""
    r = random.Random(3)
    batches = [[(r.choice([None, 1 << 60, (1 << 60) + 1, -5]), b * 3_600_000_000 + r.randrange(5_000_000) * 1000, r.choice([None, math.nan, float(r.randrange(50)), float(r.randrange(50))])) for _ in range(60)] for b in range(5)]
    batches[2] += batches[2][:9]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, at long, v double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema("k long, at long, v double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    timed = src.select("k", F.timestamp_micros("at").alias("t"), "v")
    got, timers = _emitted(spark, series.rolling_deviation(timed, "k", "t", "v", 3, "2 hours", buckets=1), "one_bucket")
    assert timers <= 2
    missing = lambda v: v is None or math.isnan(v)
    every = sorted({(k is None, k or 0) for b in batches for k, _, _ in b})
    mark = (max(at for b in batches for _, at, _ in b) // 1000 - 7_200_000) * 1000
    want = []
    for null, k in every:
        own = sorted(((at, missing(v), 0.0 if missing(v) else v) for b in batches for key, at, v in b if (key is None, key or 0) == (null, k)))
        for i, (at, no, v) in enumerate(own):
            known = [v for _, no, v in own[max(0, i - 2) : i + 1] if not no]
            if at <= mark:
                want.append((null, k, at, no, v, round(statistics.pstdev(known), 9) if known else None))
    said = got.select("k", F.unix_micros("t").alias("at"), "v", "sigma").collect()
    assert sorted(map(repr, want)) == sorted(repr((x.k is None, x.k or 0, x.at, missing(x.v), 0.0 if missing(x.v) else x.v, None if x.sigma is None else round(x.sigma, 9))) for x in said)
    assert len(want) > 150


def test_deviations_are_taken_some_rows_at_a_time(monkeypatch):
    monkeypatch.setattr(series, "_ROWS", 4)
    r = np.random.default_rng(5)
    of, value, wanted = np.sort(r.integers(0, 4, 50)), r.integers(0, 9, 50).astype(float), r.random(50) < 0.8
    got = dict(x for rows, sigma in series.RollingDeviation(5, 0)._deviations(of, value, wanted) for x in zip(rows.tolist(), sigma.tolist(), strict=True))
    assert got.keys() == set(np.flatnonzero(wanted).tolist())
    assert all(math.isclose(s, statistics.pstdev([v for j, v in zip(of[: i + 1], value) if j == of[i]][-5:]), abs_tol=1e-12) for i, s in got.items())


def test_rows_just_behind_the_watermark_are_emitted_later(spark, tmp_path):
    """The watermark stops at 100 s, in the millisecond of one row and at another one, and then goes on."""
    for i, rows in enumerate([[("a", 100_000_005), ("c", 100_000_000), ("d", 100_001_000), ("b", 160_000_000)], [("b", 160_000_100)], [("b", 162_000_000)]]):
        spark.createDataFrame(rows, "k string, at long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema("k string, at long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows = src.select("k", F.timestamp_micros("at").alias("t"), F.lit(1.0).alias("v"))
    for buckets in (1, 1024):
        got, _ = _emitted(spark, series.rolling_deviation(rows, "k", "t", "v", 2, "1 minute", buckets), f"just_behind_{buckets}")
        assert sorted(x.k for x in got.collect()) == ["a", "c", "d"]
