"""Semantic rules on tiny frames with literal results."""

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pluvia.functions import expressions as x
from pluvia.functions.schemas import STATION_ORDER, conform
from pluvia.operators import evaluate, joins, links, spatial, stations
from pluvia.operators import timeseries as ts


def test_a_stray_time_fills_a_long_gap_in_stretches(spark):
    import datetime as dt

    rows = [("a", dt.datetime(2020, 1, 1), 1.0), ("a", dt.datetime(2020, 3, 1), 2.0), ("a", None, 9.0)]
    got = ts.resample(spark.createDataFrame(rows, "k string, t timestamp, v double"), ["k"], "t", 300, {"s": ("sum", "v"), "m": ("mean", "v")})
    assert got.count() == 60 * 288 + 1 and got.agg({"s": "sum"}).first()[0] == 3.0 and got.select("bin").distinct().count() == 60 * 288 + 1


def at(s):
    return datetime.fromisoformat(s)


def one(df, c):
    return [r[c] for r in df.collect()]


def series(spark, values, key="k"):
    rows = [(key, i, datetime(2024, 1, 1, 0, i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, n int, t timestamp, v double")


def test_tolerant_parse(spark):
    df = spark.createDataFrame([(s,) for s in ("M", "1.0d", "NaN", " 3 ", "T", "", "-2.5e1")], "s string")
    assert one(df.select(x.parse_number(F.col("s")).alias("v")), "v") == [None, None, None, 3.0, None, None, -25.0]


def test_empty_bins(spark):
    df = spark.createDataFrame([("k", at("2024-01-01 00:01:00"), 1.0), ("k", at("2024-01-01 00:16:00"), 2.0)], "k string, t timestamp, v double")
    got = ts.resample(df, ["k"], "t", 300, {"s": ("sum", "v"), "m": ("mean", "v")}).orderBy("bin").collect()
    assert [(r.s, r.m) for r in got] == [(1.0, 1.0), (0.0, None), (0.0, None), (2.0, 2.0)]


def test_bins_start_at_the_first_midnight(spark):
    df = spark.createDataFrame([("k", at("2024-01-02 01:00:00"), 1.0)], "k string, t timestamp, v double")
    assert one(ts.resample(df, ["k"], "t", 7 * 3600, {"s": ("sum", "v")}), "bin") == [at("2024-01-02 00:00:00")]


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([(s,) for s in "baba"] + [(None,)], "s string")
    assert df.agg(ts.aggregate("mode", "s")).first()[0] == "a"
    assert df.limit(0).agg(ts.aggregate("mode", "s")).first()[0] is None


@pytest.mark.parametrize("nulls,want", [("skip", [1, None, 3]), ("zero", [1, 1, 3])])
def test_running_totals(spark, nulls, want):
    assert one(ts.running_total(series(spark, [1.0, None, 2.0]), ["k"], "t", "v", nulls=nulls, chunk=60).orderBy("n"), "total") == want


def test_clipped_total(spark):
    assert one(ts.running_total(series(spark, [1.0, -5.0, 2.0]), ["k"], "t", "v", nulls="clip").orderBy("n"), "total") == [1, 1, 3]


def test_constant_series_has_no_outliers(spark):
    assert one(links.mask_outliers(series(spark, [1.0, 1.0]), ["k"], "v"), "clean") == [1, 1]


def test_quantile_baseline(spark):
    got = links.attenuation(series(spark, [1.0, 2.0, 3.0, 10.0]), ["k"], "v", "quantile")
    assert abs(got.first()["baseline"] - 8.95) < 1e-12


@pytest.mark.parametrize("each,want", [(True, 4), (False, 3)])
def test_runs_of_nulls(spark, each, want):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(["a", None, None, "a"])], "k string, n int, s string")
    got = ts.runs(df, ["k"], "n", "s", each_null=each).collect()
    assert sorted(r.run for r in got) == list(range(1, want + 1)) and sum(r.n for r in got) == 4


def test_pivot_is_a_mean(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 3), ("dry", "y", 2)], "kind string, st string, n int")
    got = {r["kind"]: (r["x"], r["y"]) for r in stations.type_table(df, "st", "kind").collect()}
    assert got == {"a": (2.0, 0.0), "dry": (0.0, 2.0)}


def test_fills(spark):
    df = series(spark, [None, 1.0, None, 3.0, None])
    assert one(ts.fill(df, ["k"], "t", "v", "linear").orderBy("n"), "filled") == [None, 1, 2, 3, 3]
    assert one(ts.fill(df, ["k"], "t", "v", "forward").orderBy("n"), "filled") == [1, 1, 1, 3, 3]
    assert one(ts.fill(df, ["k"], "t", "v", "zero").orderBy("n"), "filled") == [0, 1, 0, 3, 0]


def test_attenuation_and_rain(spark):
    got = links.attenuation(series(spark, [-40.0, -45.0, None]), ["k"], "v").withColumn("r", x.rain_from_attenuation(F.col("attenuation"), F.lit(10.0))).orderBy("n").collect()
    assert [r.attenuation for r in got] == [0, 5, None]
    assert [r.r for r in got] == [0, 5 / (0.91 + 1e-10), 0]


def test_ends_of_ranges(spark):
    df = spark.createDataFrame([(datetime(2015, 6, 1 + h // 24, h % 24),) for h in range(0, 12 * 24, 6)], "t timestamp")
    assert ts.slice_days(df, "t", "2015-06-01", "2015-06-10").count() == 40
    assert ts.between_instants(df, "t", "2015-06-01 00:00:00", "2015-06-10 00:00:00").count() == 37


def test_categories_and_units(spark):
    codes = [None, "", "NP", "R+", "S-", "P?", "?2", "np", "RX", "PL", "Z"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert one(df.select(x.precip_category(F.col("c")).alias("v")), "v") == ["missing", "missing", "dry", "rain", "snow", "precip", "missing", "dry", "rain", "precip", "missing"]
    r = spark.range(1).select(x.fahrenheit_to_celsius(F.lit(212.0)), x.knots_to_ms(F.lit(10.0)), x.inches_to_mm(F.lit(0.1)), x.unpack_radar(F.lit(100)), x.unpack_radar(F.lit(255))).first()
    assert [round(v, 6) if v is not None else None for v in r] == [100, 5.1444, 2.54, 10, None]


def test_blocks_leave_a_shorter_rest_out(spark):
    df = spark.range(70).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = ts.blocks(df, ["k"], "t", ["v"], 32).orderBy("block").collect()
    assert [r.v for r in got] == [list(range(32)), list(range(32, 64))]


def test_split(spark):
    df = spark.range(10).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    assert [r.t for r in ts.temporal_split(df, ["k"], "t").where("train").orderBy("t").collect()] == list(range(7))
    assert 700 < ts.hash_split(spark.range(1000), "id").where("train").count() < 900


def test_resampling_conserves_the_sum_and_totals_grow(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id") * 777).alias("t"), F.rand(3).alias("v"))
    got = ts.resample(df, ["k"], "t", 3600, {"s": ("sum", "v")})
    assert abs(got.agg(F.sum("s")).first()[0] - df.agg(F.sum("v")).first()[0]) < 1e-9
    total = [r.total for r in ts.running_total(got.where("k = 3"), ["k"], "bin", "s", chunk=10_000).orderBy("bin").collect()]
    assert total == sorted(total)


def test_chunked_totals_equal_one_window(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 5000).alias("t"), (F.col("id") % 11).cast("double").alias("v"))
    a, b = (sorted((r.k, r.t, r.total) for r in ts.running_total(df, ["k"], "t", "v", chunk=c).collect()) for c in (3600, 10**9))
    assert a == b


def test_as_of(spark):
    a = spark.createDataFrame([("k", datetime(2024, 1, d), d) for d in (1, 3, 9)], "k string, t timestamp, i int")
    b = spark.createDataFrame([("k", datetime(2024, 1, d), float(d)) for d in (2, 3)], "k string, t timestamp, v double")
    assert sorted((r.i, r.matched_v) for r in joins.as_of(a, b, ["k"], "t", ["v"]).collect()) == [(1, None), (3, 3.0), (9, 3.0)]
    assert sorted((r.i, r.matched_v) for r in joins.as_of(a, b, ["k"], "t", ["v"], tolerance=86400).collect()) == [(1, None), (3, 3.0), (9, None)]


def test_distances_across_the_date_line_and_poles(spark):
    a = spark.createDataFrame([(1, 0.0, 179.99), (2, 89.99, 0.0), (3, 10.0, 10.0)], "i int, la double, lo double")
    b = spark.createDataFrame([(1, 0.0, -179.99), (2, 89.99, 180.0), (3, 10.5, 10.0)], "j int, lb double, ob double")
    got = {(r.i, r.j): r.distance_km for r in joins.within_km(a, b, ("la", "lo"), ("lb", "ob"), 20).collect()}
    assert set(got) == {(1, 1), (2, 2)} and abs(got[1, 1] - 2.2239) < 1e-3


def test_maps_stay_within_what_they_interpolate(spark):
    points = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)], "point int, x double, y double")
    values = points.select("point", F.lit(0).alias("t"), (F.col("point") % 9).cast("double").alias("r"))
    got = spatial.interpolate(values, spatial.weights(points, spatial.grid(spark, (0, 4, 0.5), (0, 4, 0.5)), 1.2), ["t"], "r").collect()
    assert len(got) == 81 and all(0 <= r.r <= 8 for r in got)
    assert {(r.gx, r.gy): r.r for r in got}[2.0, 1.0] == 7.0


def test_refined_points_keep_their_links_mean(spark):
    lk = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 0.0), (2, 0.0, 1.0, 2.0, 1.0), (3, 9.0, 9.0, 10.0, 9.0)], "link int, x0 double, y0 double, x1 double, y1 double")
    rain = spark.createDataFrame([(0, 1, 4.0), (0, 2, 8.0), (0, 3, 1.0)], "t int, link int, rain double")
    got, losses = spatial.refine(rain, spatial.virtual_points(lk, 2), ["t"], 1.1, 3.0, rounds=3)
    means = {r.link: r.m for r in got.groupBy("link").agg(F.avg(F.pow("rain", F.lit(1.1))).alias("m")).collect()}
    assert all(abs(means[k] - v**1.1) < 1e-9 for k, v in {1: 4.0, 2: 8.0, 3: 1.0}.items())
    assert losses.count() == 3


def test_front_falls_strictly(spark):
    rows = [(i % 12 + 1, 100.0 / (i + 1) + i % 5, f"e{i}") for i in range(60)]
    got = evaluate.pareto(spark.createDataFrame(rows, "c int, loss double, e string"), "c", "loss", ["e"]).orderBy("c").collect()
    assert [r.loss for r in got] == sorted({r.loss for r in got}, reverse=True)


def test_profile_and_compliance(spark):
    got = {r["column"]: r for r in stations.profile(series(spark, [None, 1.0]).withColumnRenamed("v", "precip_rate")).collect()}
    assert got["precip_rate"].description == "Precipitation Rate" and got["precip_rate"].null_count == 1 and got["k"].description == "Unknown"
    assert len(STATION_ORDER) == 37


def test_conform(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("1e10", "x", float("nan")), ("2.5", "7", 1.0)], "a string, b string, c double")
    kinds = T.StructType([T.StructField("c", T.DoubleType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.IntegerType()), T.StructField("d", T.StringType())])
    assert [tuple(r) for r in conform(df, kinds, 1e10).collect()] == [(None, None, None, None), (1.0, 2.5, 7, None)]


def test_symbolic_functions(spark):
    r = spark.range(1).select(*[f(F.lit(0.5)).alias(n) for n, f in x.UNARY.items()], *[f(F.lit(3.0), F.lit(0.0)).alias(n) for n, f in x.BINARY.items()]).first()
    assert r["/"] is None and r["inv"] == 2.0 and r["cube"] == 0.125


def test_refined_points_by_plain_loops(spark):
    """Virtual points, their losses and the map from them, against loops over the same rules."""
    import itertools
    import random

    r = random.Random(5)
    ends = [(k, r.random() * 4, r.random() * 4, r.random() * 4, r.random() * 4) for k in range(6)]
    rain = {(k, t): r.random() * 5 + 0.1 for k in range(6) for t in range(2)}
    b, roi, rounds = 1.1, 2.5, 3
    links = spark.createDataFrame(ends, "link long, x0 double, y0 double, x1 double, y1 double")
    points = spatial.virtual_points(links, 3)
    got, losses = spatial.refine(spark.createDataFrame([(k, t, v) for (k, t), v in rain.items()], "link long, step int, rain double"), points, ["step"], b, roi, rounds=rounds)

    place = {(k, i): (x0 + (i + 0.5) / 3 * (x1 - x0), y0 + (i + 0.5) / 3 * (y1 - y0)) for k, x0, y0, x1, y1 in ends for i in range(3)}
    now = {(p, t): rain[p[0], t] for p in place for t in range(2)}
    want = []
    for _ in range(rounds):
        new = {}
        for t in range(2):
            guess = {}
            for p, (x, y) in place.items():
                near = [(max(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 1e-6) ** -2, now[q, t]) for q, (u, v) in place.items() if q[0] != p[0] and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= roi]
                guess[p] = sum(w * v for w, v in near) / sum(w for w, _ in near) if near else now[p, t]
            for k in range(6):
                mean = sum(guess[k, i] ** b for i in range(3)) / 3
                for i in range(3):
                    new[(k, i), t] = guess[k, i] * (rain[k, t] ** b / mean) ** (1 / b)
        want.append(sum((new[x] - now[x]) ** 2 for x in now) / len(now))
        now = new
    found = {((x.link, int(x.point.split("/")[1])), x.step): x.rain for x in got.collect()}
    assert found.keys() == now.keys() and all(abs(found[k] - v) < 1e-9 for k, v in now.items())
    assert [x.loss for x in losses.orderBy("round").collect()] == [pytest.approx(x) for x in want]
    cells = spatial.grid(spark, (0, 4, 1), (0, 4, 1))
    shown = {(c.step, c.gx, c.gy): c.rain for c in spatial.interpolate(got.select("point", "step", "rain"), spatial.weights(points, cells, 1.5), ["step"], "rain").collect()}
    for t, gx, gy in itertools.product(range(2), range(5), range(5)):
        near = [(((gx - x) ** 2 + (gy - y) ** 2) ** -1, now[p, t]) for p, (x, y) in place.items() if 0 < ((gx - x) ** 2 + (gy - y) ** 2) ** 0.5 <= 1.5]
        assert ((t, gx, gy) in shown) == bool(near)
        if near:
            assert abs(shown[t, gx, gy] - sum(w * v for w, v in near) / sum(w for w, _ in near)) < 1e-9
