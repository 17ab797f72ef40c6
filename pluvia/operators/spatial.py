"""Rain maps from links: inverse-distance weights on a grid, and the iterative virtual-point variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.expressions import idw_weight
from pluvia.operators.joins import within


def grid(spark: SparkSession, x: tuple[float, float, float], y: tuple[float, float, float]) -> DataFrame:
    """gx, gy over (from, to, step) of each axis, both ends included."""

    def axis(a):
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(round((a[1] - a[0]) / a[2]))), lambda i: F.lit(a[0]) + i * F.lit(a[2])))

    return spark.range(1).select(axis(x).alias("gx")).select("gx", axis(y).alias("gy"))


def weights(points: DataFrame, cells: DataFrame, roi: float, power: float = 2.0) -> DataFrame:
    """gx, gy, point, w of points (point, x, y) no farther than roi; w is null at distance 0. Found once, then used for every time."""
    pairs = within(points, cells, [("x", "gx"), ("y", "gy")], roi)
    return pairs.select("point", "gx", "gy", idw_weight(F.col("distance"), power).alias("w"))


def interpolate(values: DataFrame, w: DataFrame, time: list[str], value: str) -> DataFrame:
    """Weighted mean by time and cell; a point that lies on a cell gives it its own value (the mean of several)."""
    v = F.col(value)
    got = values.where(v.isNotNull()).join(w, "point").groupBy(*time, "gx", "gy").agg(
        F.avg(F.when(F.col("w").isNull(), v)).alias("on"), F.try_divide(F.sum(F.col("w") * v), F.sum(F.when(v.isNotNull(), F.col("w")))).alias("near"), F.count(F.lit(1)).alias("n")
    )
    return got.select(*time, "gx", "gy", F.coalesce("on", "near").alias(value), "n")


def virtual_points(links: DataFrame, k: int = 2) -> DataFrame:
    """k points along each link (link, x0, y0, x1, y1): link, point, x, y; the middle for k = 1."""
    at: Column = (F.col("i") + 0.5) / k
    return links.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        "link", F.concat_ws("/", F.col("link").cast("string"), F.col("i").cast("string")).alias("point"), (F.col("x0") + at * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + at * (F.col("y1") - F.col("y0"))).alias("y")
    )


def refine(rain: DataFrame, points: DataFrame, time: list[str], b: float, roi: float, power: float = 2.0, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Virtual points that vary along a link: (point values, losses by round).

    rain: time, link, rain (a link's mean). Each round gives a point the weighted mean of other links' points nearby (its own value where
    there are none), then scales a link's points so that the mean of their rain ** b is the link's rain ** b again. The loss is
    the mean square change. An interpretation of the published method: its iteration isn't specified further.
    Rounds are cut by checkpoints, so the session needs a folder for them (spark.checkpoint.dir).
    """
    if points.sparkSession.sparkContext.getCheckpointDir() is None:
        raise ValueError("refine() needs a checkpoint folder: set spark.checkpoint.dir")
    other = points.select(F.col("link").alias("link2"), F.col("point").alias("point2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = within(points, other, [("x", "x2"), ("y", "y2")], roi).where("link != link2").select("point", "point2", idw_weight(F.greatest("distance", F.lit(1e-6)), power).alias("w")).checkpoint()
    now = points.select("link", "point").join(rain, "link").withColumnRenamed("rain", "link_rain").withColumn("rain", F.col("link_rain")).checkpoint()
    losses = None
    for i in range(rounds):
        around = near.join(now.select(*time, F.col("point").alias("point2"), F.col("rain").alias("r")), "point2").groupBy(*time, "point").agg(F.try_divide(F.sum(F.col("w") * F.col("r")), F.sum("w")).alias("around"))
        guess = now.join(around, [*time, "point"], "left").withColumn("guess", F.coalesce("around", "rain"))
        mean = guess.groupBy(*time, "link").agg(F.avg(F.pow("guess", F.lit(b))).alias("m"))
        scale = F.pow(F.try_divide(F.pow("link_rain", F.lit(b)), F.col("m")), F.lit(1 / b))
        new = guess.join(mean, [*time, "link"]).withColumn("new", F.coalesce(F.col("guess") * scale, F.col("link_rain"))).checkpoint()
        loss = new.agg(F.lit(i + 1).alias("round"), F.avg(F.pow(F.col("new") - F.col("rain"), 2)).alias("loss"))
        losses = loss if losses is None else losses.unionByName(loss)
        now = new.select("link", "point", *time, "link_rain", F.col("new").alias("rain"))
    return now.drop("link_rain"), losses


def most_variable(maps: DataFrame, time: str, value: str, n: int = 1) -> DataFrame:
    """Times whose map has the largest population deviation, the earlier one of ties."""
    return maps.groupBy(time).agg(F.stddev_pop(value).alias("deviation")).orderBy(F.col("deviation").desc(), time).limit(n)
