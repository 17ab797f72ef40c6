"""Microwave links: outliers, attenuation, wet and dry, baselines, rain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.expressions import non_negative, rain_power_law
from pluvia.operators import segments, sketches
from pluvia.operators.joins import in_box, join_back, lookup, near_gauges
from pluvia.operators.timeseries import between_instants, bins


def _with_key_stats(df: DataFrame, keys: list[str], **stats) -> DataFrame:
    """Statistics by key joined to the rows: aggregated in parts first, so a key with very many rows is no single window."""
    return join_back(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)


def mask_outliers(df: DataFrame, keys: list[str], value: str, threshold: float = 3.0, out: str = "clean") -> DataFrame:
    """Null where |z| > threshold, by population standard deviation of the key's values; a deviation of 0 masks nothing. NaN counts as null."""
    known = F.when(~F.isnan(value), F.col(value))
    got = _with_key_stats(df, keys, __m=F.avg(known), __s=F.stddev_pop(known))
    z = F.try_divide(F.abs(known - F.col("__m")), F.nullif(F.col("__s"), F.lit(0.0)))
    return got.withColumn(out, F.when(F.coalesce(z > threshold, F.lit(False)), None).otherwise(known)).drop("__m", "__s")


def attenuation(df: DataFrame, keys: list[str], level: str, method: str = "dynamic", baseline: str | None = None, out: str = "attenuation") -> DataFrame:
    """Baseline minus level, negatives 0. method: 'dynamic' (maximum of the period), 'quantile' (its 95th percentile), 'sketch' (that
    within sketches.ERROR of the rank, without keeping all values of a key), 'mean'; or a column as baseline."""
    if baseline is None:
        stat = {"dynamic": F.max(level), "quantile": F.percentile(level, 0.95), "sketch": sketches.quantile(F.kll_sketch_agg_double(F.col(level).cast("double"), sketches.SIZE), 0.95), "mean": F.avg(level)}[method]
        df, baseline = _with_key_stats(df, keys, baseline=stat), "baseline"
    return df.withColumn(out, non_negative(F.col(baseline) - F.col(level)))


def path_loss(df: DataFrame, tsl: str = "tsl", rsl: str = "rsl", out: str = "attenuation") -> DataFrame:
    return df.withColumn(out, F.col(tsl) - F.col(rsl))


def min_max(df: DataFrame, keys: list[str], ts: str, value: str, step: int = 900) -> DataFrame:
    """Largest and smallest value in each step of seconds."""
    return bins(df, keys, ts, step).groupBy(*keys, "bin").agg(F.max(value).alias("att_max"), F.min(value).alias("att_min"))


def wet_dry(df: DataFrame, keys: list[str], ts: str, value: str, window: int = 8, threshold: float = 0.1, tie: tuple[str, ...] = (), min_periods: int = 1) -> DataFrame:
    """sigma: population deviation of a row and the ones that follow, `window` in all (at least min_periods, else null); wet: sigma > threshold."""
    got = segments.rolled(df, keys, ts, tie, window, lambda w: {"sigma": F.when(F.count(value).over(w) >= min_periods, F.stddev_pop(value).over(w))})
    return got.withColumn("wet", F.col("sigma") > threshold)


def dynamic_baseline(df: DataFrame, keys: list[str], ts: str, value: str, window: int = 4, tie: tuple[str, ...] = ()) -> DataFrame:
    """Moving minimum over a row and the ones that follow."""
    return segments.rolled(df, keys, ts, tie, window, lambda w: {"baseline": F.min(value).over(w)})


def constant_baseline(df: DataFrame, keys: list[str], ts: str, value: str, wet: str = "wet", tie: tuple[str, ...] = ()) -> DataFrame:
    """The value at the last dry row so far."""
    dry = F.when(~F.col(wet), F.col(value))
    edge = {"__past": (F.max_by(dry, F.when(dry.isNotNull(), segments.order_of(ts, tie))), segments.last_before)}
    rows, w = segments.chunked(df, keys, ts, tie, edge)
    return segments.without(rows.withColumn("baseline", F.coalesce(F.last(dry, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__past")), "__past")


def above_baseline(df: DataFrame, value: str, baseline: str = "baseline", wet_antenna: float = 0.0, out: str = "normalized") -> DataFrame:
    """max(value - baseline - wet antenna attenuation, 0); null stays null."""
    return df.withColumn(out, non_negative(F.col(value) - F.col(baseline) - F.lit(float(wet_antenna))))


def two_step_rain(df: DataFrame, keys: list[str], ts: str, value: str, length_km: str, a: str, b: str, window: int = 8, threshold: float = 0.1, wet_antenna: float = 1.6, r_min: float = 0.3, tie: tuple[str, ...] = ()) -> DataFrame:
    """Wet or dry, constant baseline, then the power law; dry rows have no rain.

    The wet-antenna part and r_min are read as a loss that is taken off and a least rate that is reported; both are parameters.
    """
    got = above_baseline(constant_baseline(wet_dry(df, keys, ts, value, window, threshold, tie), keys, ts, value, tie=tie), value, wet_antenna=wet_antenna)
    return got.withColumn("rain", F.when(F.col("wet"), rain_power_law(F.col("normalized"), F.col(length_km), F.col(a), F.col(b), r_min)).otherwise(0.0))


def one_step_rain(df: DataFrame, keys: list[str], ts: str, value: str, length_km: str, a: str, b: str, window: int = 4, r_min: float = 0.3, tie: tuple[str, ...] = ()) -> DataFrame:
    """Moving-minimum baseline, then the power law."""
    got = above_baseline(dynamic_baseline(df, keys, ts, value, window, tie), value)
    return got.withColumn("rain", rain_power_law(F.col("normalized"), F.col(length_km), F.col(a), F.col(b), r_min))


def global_stats(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))


def dataset(facts: DataFrame, metadata: DataFrame, link: str, ts: str, values: list[str], start=None, end=None, step: int | None = None, xy_min: tuple | None = None, xy_max: tuple | None = None,
            gauges: DataFrame | None = None, gauge_lat_lon: tuple[str, str] = ("gauge_lat", "gauge_lon"), gauge_km: float | None = None) -> DataFrame:
    """Link series with their metadata: the loader of a link data set.

    metadata: link, site_0_lat, site_0_lon, site_1_lat, site_1_lon and what else it has; lat and lon (midpoints) are added. start, end: instants,
    both included. step: largest and smallest of each value by so many seconds (<value>_max, <value>_min at bin) instead of the rows.
    xy_min, xy_max: (longitude, latitude) of a box that midpoints lie in. gauges with gauge_km: links with a gauge that near alone.
    Links without metadata stay, unless a box or gauges choose; then links are chosen first, so that the series are read for those alone.
    """
    about = metadata.withColumns({"lat": (F.col("site_0_lat") + F.col("site_1_lat")) / 2, "lon": (F.col("site_0_lon") + F.col("site_1_lon")) / 2})
    chosen = about
    if xy_min is not None and xy_max is not None:
        chosen = chosen.where(in_box(F.col("lon"), F.col("lat"), xy_min, xy_max))
    if gauges is not None and gauge_km is not None:
        chosen = near_gauges(chosen, gauges, link, ("lat", "lon"), gauge_lat_lon, gauge_km)
    rows = between_instants(facts.select(link, ts, *values), ts, start, end)
    if chosen is not about:
        rows = rows.join(chosen.select(link), link, "left_semi")
    if step is not None:
        rows = bins(rows, [link], ts, step).groupBy(link, "bin").agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("max", F.max), ("min", F.min))])
    return lookup(rows, about, [link])
