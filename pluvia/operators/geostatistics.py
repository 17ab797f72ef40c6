"""Interpolation with an error, and maps of several sensors in one: variograms, local kriging, conditional merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.expressions import idw_weight
from pluvia.operators.joins import within


def variogram(points: DataFrame, value: str, radius: float, classes: int = 10) -> DataFrame:
    """class (0, 1, ...), lag (mean distance), gamma (half the mean square difference) and n of the pairs of points (point, x, y, value) no farther apart than radius.

    Pairs come from cells as wide as the radius; classes are summed in parts. Points without a value are left out; one class a distance of radius / classes.
    """
    known = points.where(F.col(value).isNotNull())
    a, b = (known.select(F.col("point").alias(f"p{t}"), F.col("x").alias(f"x{t}"), F.col("y").alias(f"y{t}"), F.col(value).alias(f"v{t}")) for t in "ab")
    pairs = within(a, b, [("xa", "xb"), ("ya", "yb")], radius).where("pa < pb")
    at = F.least(F.floor(F.col("distance") / radius * classes), F.lit(classes - 1)).cast("int")
    return pairs.groupBy(at.alias("class")).agg(F.avg("distance").alias("lag"), (F.avg(F.pow(F.col("va") - F.col("vb"), F.lit(2.0))) / 2).alias("gamma"), F.count(F.lit(1)).alias("n"))


def semivariance(h, kind: str, nugget: float, sill: float, reach: float):
    """gamma of distances h (numpy); 0 at no distance. kind: linear (sill per reach, without bound), exponential or spherical (reach: where it is nearly or wholly flat)."""
    h = np.asarray(h, float)
    part = {"linear": lambda: h / reach, "exponential": lambda: 1 - np.exp(-3 * h / reach), "spherical": lambda: np.where(h < reach, 1.5 * h / reach - 0.5 * (h / reach) ** 3, 1.0)}[kind]()
    return np.where(h > 0, nugget + (sill - nugget) * part, 0.0)


def fitted(classes: DataFrame, kind: str = "exponential") -> dict[str, float | str]:
    """The model (kind, nugget, sill, reach) that comes nearest to a variogram's classes, each weighing as many pairs as it has. There are few classes, so the driver tries the reaches."""
    rows = classes.where("gamma IS NOT NULL").collect()  # as many rows as classes
    lag, gamma, n = (np.array([r[c] for r in rows], float) for c in ("lag", "gamma", "n"))
    best = None
    for reach in np.linspace(lag.max() / 10, 3 * lag.max(), 60):
        shape = semivariance(np.maximum(lag, 1e-12), kind, 0.0, 1.0, reach)
        for a in (np.stack([1 - shape, shape], axis=1), shape[:, None]):  # with a nugget, and without
            got = np.linalg.lstsq(a * np.sqrt(n)[:, None], gamma * np.sqrt(n), rcond=None)[0]
            nugget, sill = (got[0], got[1]) if len(got) == 2 else (0.0, got[0])
            if 0 <= nugget <= sill:
                loss = float((n * (a @ got - gamma) ** 2).sum())
                if best is None or loss < best[0]:
                    best = (loss, {"kind": kind, "nugget": float(nugget), "sill": float(sill), "reach": float(reach)})
    if best is None:
        raise ValueError("no model with a nugget below its sill comes near these classes")
    return best[1]


def kriging_weights(points: DataFrame, cells: DataFrame, roi: float, model: dict, neighbours: int = 8) -> DataFrame:
    """gx, gy, point, w, variance: ordinary kriging of each cell by its nearest points (point, x, y; ties: the smaller ones), no farther than roi.

    A system has as many rows as neighbours, whatever the number of points; equally large systems of a batch are solved together. Points at one place count as their first one, since a system
    with both has no answer. A cell without points nearby has no rows. Weights of a cell add up to 1 and are found once for all times; variance is that of the estimate.
    """
    apart = points.groupBy("x", "y").agg(F.min("point").alias("point"))
    near = within(apart.select("point", "x", "y"), cells.select("gx", "gy"), [("x", "gx"), ("y", "gy")], roi)
    nth = F.row_number().over(Window.partitionBy("gx", "gy").orderBy("distance", "point"))
    chosen = near.withColumn("nth", nth).where(F.col("nth") <= neighbours).groupBy("gx", "gy").agg(F.array_sort(F.collect_list(F.struct("nth", "point", "x", "y", "distance"))).alias("near"))
    kind = points.schema["point"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = b.column("near")
            size = np.diff(near.offsets.to_numpy())
            flat = near.flatten()
            x, y, d = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "distance"))
            start = near.offsets.to_numpy()[:-1] - near.offsets[0].as_py()
            w, variance = np.empty(len(flat)), np.empty(len(flat))
            for m in np.unique(size[size > 0]):
                at = start[size == m][:, None] + np.arange(m)
                left = np.ones((len(at), m + 1, m + 1))
                left[:, m, m] = 0
                left[:, :m, :m] = semivariance(np.hypot(x[at][:, :, None] - x[at][:, None, :], y[at][:, :, None] - y[at][:, None, :]), **model)
                right = np.ones((len(at), m + 1))
                right[:, :m] = semivariance(d[at], **model)
                got = np.linalg.solve(left, right[:, :, None])[:, :, 0]
                w[at] = got[:, :m]
                variance[at] = (got * right).sum(axis=1)[:, None]
            cell = np.repeat(np.arange(b.num_rows), size)
            yield pa.RecordBatch.from_arrays([b.column("gx").take(pa.array(cell)), b.column("gy").take(pa.array(cell)), flat.field("point"), pa.array(w), pa.array(np.maximum(variance, 0.0))], ["gx", "gy", "point", "w", "variance"])

    return chosen.mapInArrow(run, f"gx double, gy double, point {kind}, w double, variance double")


def kriged(values: DataFrame, weights: DataFrame, time: list[str], value: str) -> DataFrame:
    """time, gx, gy, value, variance, n from values (time, point, value). Where some of a cell's points have no value, the weights of the others are scaled to add up to 1."""
    got = values.where(F.col(value).isNotNull()).join(weights, "point").groupBy(*time, "gx", "gy")
    return got.agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias(value), F.first("variance").alias("variance"), F.count(F.lit(1)).alias("n"))


def at_points(background: DataFrame, points: DataFrame, time: list[str], value: str, roi: float, power: float = 2.0) -> DataFrame:
    """time, point, value of a map (time, gx, gy, value) at points (point, x, y), by distance; a point on a cell takes its value."""
    cells = background.select("gx", "gy").distinct()
    w = within(cells, points.select("point", "x", "y"), [("gx", "x"), ("gy", "y")], roi).select("gx", "gy", "point", idw_weight(F.col("distance"), power).alias("w"))
    v = F.col(value)
    got = background.where(v.isNotNull()).join(w, ["gx", "gy"]).groupBy(*time, "point")
    got = got.agg(F.avg(F.when(F.col("w").isNull(), v)).alias("on"), F.try_divide(F.sum(F.col("w") * v), F.sum("w")).alias("near"))
    return got.select(*time, "point", F.coalesce("on", "near").alias(value))


def merged(background: DataFrame, gauges: DataFrame, points: DataFrame, time: list[str], value: str, roi: float, power: float = 2.0, targets: DataFrame | None = None) -> DataFrame:
    """Conditional merging of a map (of radar or links: time, gx, gy, value) with gauges (time, point, value): the gauges' differences from the map, spread by distance, are added to it.

    At a gauge the result is the gauge's value, farther off it is the map's pattern; cells without a gauge within roi keep the map. Gauges beyond the map add nothing.
    targets: other places (gx, gy) to return, at which the map is taken by distance; else the map's cells. Returns time, gx, gy, value, correction.
    """
    there = background if targets is None else at_points(background, targets.select(F.struct("gx", "gy").alias("point"), F.col("gx").alias("x"), F.col("gy").alias("y")), time, value, roi, power).select(*time, "point.*", value)
    off = gauges.join(at_points(background, points, time, value, roi, power).withColumnRenamed(value, "__map"), [*time, "point"]).select(*time, "point", (F.col(value) - F.col("__map")).alias("__off"))
    cells = there.select("gx", "gy").distinct()
    w = within(points.select("point", "x", "y"), cells, [("x", "gx"), ("y", "gy")], roi).select("point", "gx", "gy", idw_weight(F.col("distance"), power).alias("w"))
    spread = off.where("__off IS NOT NULL").join(w, "point").groupBy(*time, "gx", "gy")
    spread = spread.agg(F.avg(F.when(F.col("w").isNull(), F.col("__off"))).alias("on"), F.try_divide(F.sum(F.col("w") * F.col("__off")), F.sum("w")).alias("near"))
    correction = F.coalesce("on", "near", F.lit(0.0))
    return there.join(spread, [*time, "gx", "gy"], "left").select(*time, "gx", "gy", (F.col(value) + correction).alias(value), correction.alias("correction"))
