"""Kriging against plain solutions, exact at its points; merged maps equal their gauges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import geostatistics as geo

MODEL = {"kind": "exponential", "nugget": 0.2, "sill": 3.0, "reach": 4.0}


def made(spark, n=40, seed=1):
    r = random.Random(seed)
    rows = [(i, r.random() * 10, r.random() * 10, r.random() * 5) for i in range(n)]
    return rows, spark.createDataFrame(rows, "point long, x double, y double, v double")


def test_kriging_solves_each_cells_system(spark):
    rows, points = made(spark)
    cells = [(float(i), float(j)) for i in range(0, 12, 3) for j in range(0, 12, 3)]
    w = geo.kriging_weights(points, spark.createDataFrame(cells, "gx double, gy double"), 3.0, MODEL, 5)
    got = {(r.gx, r.gy): (r.v, r.variance, r.n) for r in geo.kriged(points.select("point", "v"), w, [], "v").collect()}
    for gx, gy in cells:
        near = sorted((np.hypot(x - gx, y - gy), i, x, y, v) for i, x, y, v in rows if np.hypot(x - gx, y - gy) <= 3.0)[:5]
        if not near:
            assert (gx, gy) not in got
            continue
        m = len(near)
        a = np.ones((m + 1, m + 1))
        a[m, m] = 0
        for i in range(m):
            for j in range(m):
                a[i, j] = geo.semivariance(np.hypot(near[i][2] - near[j][2], near[i][3] - near[j][3]), **MODEL)
        b = np.append(geo.semivariance([n[0] for n in near], **MODEL), 1.0)
        x = np.linalg.solve(a, b)
        assert got[gx, gy] == pytest.approx((x[:m] @ [n[4] for n in near], max(0.0, x @ b), m))


def test_kriging_is_exact_at_its_points(spark):
    rows, points = made(spark)
    twice = points.unionByName(points.limit(5).withColumn("point", F.col("point") + 100))  # points at one place
    cells = points.select(F.col("x").alias("gx"), F.col("y").alias("gy"))
    w = geo.kriging_weights(twice, cells, 4.0, MODEL, 6)
    got = geo.kriged(points.select("point", "v"), w, [], "v").join(points.select(F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("v").alias("own")), ["gx", "gy"]).collect()
    assert len(got) == 40 and all(abs(r.v - r.own) < 1e-9 and r.variance < 1e-9 for r in got)
    # one point alone is its own estimate everywhere near; none gives no cell
    one = geo.kriged(points.select("point", "v").where("point = 3"), geo.kriging_weights(points.where("point = 3"), cells, 4.0, MODEL), [], "v").collect()
    assert one and all(r.v == pytest.approx(rows[3][3]) for r in one)
    assert geo.kriging_weights(points.limit(0), cells, 4.0, MODEL).count() == 0


def test_variogram_and_its_model(spark):
    """A field with a known variogram: values are sums of cosines, too regular for one, so the model is fitted to classes made from it."""
    rows, points = made(spark, 60)
    got = {r["class"]: (r.lag, r.gamma, r.n) for r in geo.variogram(points, "v", 4.0, 4).collect()}
    by = {}
    for i, x, y, v in rows:
        for j, x2, y2, v2 in rows:
            h = np.hypot(x - x2, y - y2)
            if i < j and h <= 4.0:
                by.setdefault(min(3, int(h // 1.0)), []).append((h, (v - v2) ** 2))
    assert got == {k: (pytest.approx(np.mean([h for h, _ in p])), pytest.approx(np.mean([s for _, s in p]) / 2), len(p)) for k, p in by.items()}
    lags = np.arange(0.25, 8, 0.5)
    classes = spark.createDataFrame([(i, float(h), float(geo.semivariance(h, "exponential", 0.5, 2.0, 5.0)), 100) for i, h in enumerate(lags)], "class int, lag double, gamma double, n long")
    model = geo.fitted(classes)
    assert model["nugget"] == pytest.approx(0.5, abs=0.1) and model["sill"] == pytest.approx(2.0, abs=0.1) and model["reach"] == pytest.approx(5.0, abs=0.5)


def test_merged_maps_equal_their_gauges(spark):
    rows, points = made(spark, 15)
    background = spark.createDataFrame([(t, float(i), float(j), i * 0.5 + j * t) for t in (0, 1) for i in range(11) for j in range(11)], "t int, gx double, gy double, v double")
    gauges = points.crossJoin(spark.createDataFrame([(0,), (1,)], "t int")).select("t", "point", (F.col("v") + F.col("t")).alias("v"))
    targets = points.select(F.col("x").alias("gx"), F.col("y").alias("gy"))
    at = geo.merged(background, gauges, points, ["t"], "v", 2.0, targets=targets).collect()
    want = {(t, x, y): v + t for t in (0, 1) for _, x, y, v in rows}
    assert {(r.t, r.gx, r.gy): r.v for r in at} == {k: pytest.approx(v) for k, v in want.items()}
    whole = geo.merged(background, gauges, points, ["t"], "v", 2.0).collect()
    assert len(whole) == 242
    far = [r for r in whole if all(np.hypot(r.gx - x, r.gy - y) > 2.0 for _, x, y, _ in rows)]
    assert all(r.correction == 0 and r.v == r.gx * 0.5 + r.gy * r.t for r in far)
    none = geo.merged(background, gauges.limit(0), points, ["t"], "v", 2.0)
    assert none.where("correction <> 0").count() == 0 and none.count() == 242
