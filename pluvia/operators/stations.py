"""Stations: counts by type, rankings, daily totals, completeness, profiles, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions.expressions import NO_VALUE, PRECIP_ORDER, precip_category
from pluvia.functions.schemas import STATION_COLUMNS
from pluvia.operators.timeseries import seconds


def with_category(df: DataFrame, kind: str = "precip_type", out: str = "precip_category") -> DataFrame:
    """The category of each row, derived from its code where there is none; a frame that has neither has no category (null)."""
    if out in df.columns:
        return df if kind not in df.columns else df.withColumn(out, F.coalesce(F.col(out), precip_category(F.col(kind))))
    return df.withColumn(out, precip_category(F.col(kind)) if kind in df.columns else F.lit(None).cast("string"))


def of_types(df: DataFrame, wanted: list[str], kind: str = "precip_type") -> DataFrame:
    """Rows whose code is one of those wanted; null is none."""
    return df.where(F.col(kind).isin(wanted))


def distinct_values(df: DataFrame, value: str) -> DataFrame:
    """Each value once, in order, null left out."""
    return df.select(value).where(F.col(value).isNotNull()).distinct().orderBy(value)


def bundle_totals(rows: DataFrame, product: str, key: str) -> DataFrame:
    """Observations and stations of each product, and of all (product null)."""
    return rows.rollup(product).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("stations"))


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "measure", out: str = "amount") -> DataFrame:
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, name, out)


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list) -> DataFrame:
    """A column for each of names, the mean of repeated cells."""
    return df.groupBy(*ids).pivot(name, names).agg(F.avg(value))


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def named_like(df: DataFrame, part: str, *first: str) -> DataFrame:
    """The columns `first`, then those whose names hold part, in any case."""
    return df.select(*first, *[F.col(f"`{c}`") for c in df.columns if part.lower() in c.lower() and c not in first])


def wet(rain: Column, least: float = 0.1) -> Column:
    """More rain than `least`; dry is exactly 0."""
    return rain > least


def with_rain(df: DataFrame, rain: str) -> DataFrame:
    return df.where(F.col(rain) > 0)


def nth_stations(df: DataFrame, key: str, nth: list[int]) -> DataFrame:
    """Rows of the stations at these places (0: the first) in the order of keys; the keys are ranked as a summary."""
    ranked = df.select(key).distinct().withColumn("__n", F.row_number().over(Window.orderBy(key)) - 1)
    return df.join(ranked.where(F.col("__n").isin(nth)).select(key), key, "left_semi")


def type_counts(df: DataFrame, key: str, kind: str) -> DataFrame:
    """key, kind, n; nulls and strings that stand for no value are left out."""
    return df.where(F.col(kind).isNotNull() & ~F.col(kind).isin(NO_VALUE)).groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))


def type_shares(counts: DataFrame, key: str, kind: str) -> DataFrame:
    """Adds share: percent of the key's rows, one decimal. Counts are few, so this window is over a summary."""
    return counts.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(key)), 1))


def type_table(counts: DataFrame, key: str, kind: str, keys: list | None = None, value: str = "n") -> DataFrame:
    """One row a kind and one column a key (mean of repeated cells, 0 for none); known categories in their usual order.

    keys: the columns wanted. Without them Spark first finds the distinct keys, in a job of its own.
    """
    wide = counts.groupBy(kind).pivot(key, keys).agg(F.avg(value)).na.fill(0)
    rank = F.array_position(F.array(*map(F.lit, PRECIP_ORDER)), F.col(kind))
    return wide.orderBy(F.when(rank == 0, len(PRECIP_ORDER) + 1).otherwise(rank), kind)


def summary(df: DataFrame, key: str, rain: str, temp: str | None = None, wind: str | None = None) -> DataFrame:
    """Total (also the per-station total of a conversion over all stations), rows with rain, and mean temperature and wind by station."""
    return df.groupBy(key).agg(F.coalesce(F.sum(rain), F.lit(0.0)).alias("total"), F.count_if(F.col(rain) > 0).alias("rainy"), *[F.avg(c).alias(f"mean_{c}") for c in (temp, wind) if c])


def daily(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Sum by key and date of the (local) time."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def rank_stats(df: DataFrame, key: str, ts: str, rain: str) -> DataFrame:
    """Total, rows with rain, largest, mean of rows with rain (0 if none), days with rain: two levels, first by day."""
    wet = F.when(F.col(rain) > 0, F.col(rain))
    day = df.groupBy(key, F.to_date(ts).alias("day")).agg(F.coalesce(F.sum(rain), F.lit(0.0)).alias("s"), F.count(wet).alias("k"), F.max(rain).alias("m"), F.sum(wet).alias("w"))
    return day.groupBy(key).agg(
        F.sum("s").alias("total"), F.sum("k").alias("wet_rows"), F.max("m").alias("largest"), F.coalesce(F.try_divide(F.sum("w"), F.sum("k")), F.lit(0.0)).alias("wet_mean"), F.count_if(F.col("s") > 0).alias("wet_days")
    )


def across(stats: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, least, largest, sample deviation, and which station has the least and the largest (the smaller key of ties)."""
    return stats.agg(
        F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("least"), F.max(value).alias("largest"), F.stddev_samp(value).alias("deviation"),
        F.min_by(key, F.struct(F.col(value), F.col(key))).alias("least_at"), F.min_by(key, F.struct(-F.col(value), F.col(key))).alias("largest_at"),
    )


def top(stats: DataFrame, value: str, key: str, n: int = 5, largest: bool = True) -> DataFrame:
    """The n first by value, ties by key; each task keeps n rows."""
    return stats.orderBy(F.col(value).desc() if largest else F.col(value).asc(), key).limit(n)


def wettest_day(days: DataFrame, keys: list[str]) -> DataFrame:
    """The first of the days with the largest total."""
    return days.groupBy(*keys).agg(F.min_by(F.struct("day", "total"), F.struct(-F.col("total"), F.col("day"))).alias("d")).select(*keys, "d.*")


def completeness(df: DataFrame, key: str, ts: str, value: str, longest_gap: float = 7200) -> DataFrame:
    """First and last time, days between (whole), rows, percent of an hourly record, number of gaps over longest_gap seconds."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = (seconds(F.col(ts)) - seconds(F.lag(ts).over(w)) > longest_gap).cast("long")
    got = df.withColumn("__gap", gap).groupBy(key).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(value).alias("n"), F.coalesce(F.sum("__gap"), F.lit(0)).alias("gaps"))
    days = F.floor((seconds(F.col("last")) - seconds(F.col("first"))) / 86400)
    return got.withColumn("days", days).withColumn("completeness", F.try_divide(F.col("n") * 100.0, F.col("days") * 24))


def profile(df: DataFrame) -> DataFrame:
    """column, description, units, data_type, has_data, non_null_count, null_count of each column, from one pass over the data."""
    names = df.columns
    counted = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("non_null_count")) for i, c in enumerate(names)])
    flat = counted.select("__n", F.inline(rows))
    known = F.create_map(*[x for simple, _, said, unit, kind in STATION_COLUMNS for x in (F.lit(simple), F.struct(F.lit(said).alias("d"), F.lit(unit).alias("u"), F.lit(kind).alias("k")))])
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    of = F.try_element_at(known, F.col("column"))
    return flat.select(
        "column", F.coalesce(of["d"], F.lit("Unknown")).alias("description"), F.coalesce(of["u"], F.lit("Unknown")).alias("units"), F.coalesce(of["k"], types[F.col("column")]).alias("data_type"),
        (F.col("non_null_count") > 0).alias("has_data"), "non_null_count", (F.col("__n") - F.col("non_null_count")).alias("null_count"),
    )


def rain_stats(df: DataFrame, keys: list[str], rain: str) -> DataFrame:
    """n, wet rows and their percent, least, largest, sum, mean of wet rows."""
    wet = F.when(F.col(rain) > 0, F.col(rain))
    n = F.count(rain)
    return df.groupBy(*keys).agg(
        n.alias("n"), F.count(wet).alias("wet"), F.try_divide(100.0 * F.count(wet), n).alias("wet_percent"), F.min(rain).alias("least"), F.max(rain).alias("largest"),
        F.coalesce(F.sum(rain), F.lit(0.0)).alias("total"), F.coalesce(F.avg(wet), F.lit(0.0)).alias("wet_mean"),
    )


def rain_distribution(df: DataFrame, rain: str) -> DataFrame:
    """Mean, population deviation, wet and dry parts, and the exponential fit (location: least, scale: mean above it)."""
    x = F.col(rain)
    return df.agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"), F.avg((x > 0.1).cast("double")).alias("wet_part"), F.avg((x == 0).cast("double")).alias("dry_part"),
        F.min(x).alias("location"), (F.avg(x) - F.min(x)).alias("scale"),
    )


def histogram(df: DataFrame, value: str, n_bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin (1..n), start, n, density: equal bins from the least to the largest value (or given bounds), the last one closed."""
    got = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    ends = got.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total")) if low is None else got.agg(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"), F.count_if(F.col("x").between(low, high)).alias("total"))
    ends = F.broadcast(ends.withColumn("one", F.lit(1)))  # one row
    rows = got.withColumn("one", F.lit(1)).join(ends, "one").where(F.col("x").between(F.col("lo"), F.col("hi")))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(n_bins), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins) + 1)).otherwise(F.lit(1))
    counts = rows.groupBy(at.cast("int").alias("bin"), "lo", "hi", "total").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    return counts.select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("start"), "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(value)


def coverage(df: DataFrame, links: list[str], ts: str) -> DataFrame:
    """Sizes of each dimension, rows, first and last time, days covered."""
    return df.agg(
        *[F.count_distinct(c).alias(f"n_{c}") for c in links], F.count(F.lit(1)).alias("points"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        ((F.max(seconds(F.col(ts))) - F.min(seconds(F.col(ts)))) / 86400).alias("days"),
    )


def first_stations(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the n first keys: the keys are found first, at n a task, and joined."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def compliance(df: DataFrame, required: dict[str, type[T.DataType]], unique: list[str], ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """check, passed: columns present, of their type, in order; the key unique; values in range; and all of it.

    Schema checks need no data; the others are one aggregate each over it.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    checks: list[tuple[str, bool]] = []
    for name, kind in required.items():
        checks.append((f"has {name}", name in kinds))
        checks.append((f"type of {name}", isinstance(kinds.get(name), kind)))
    present = [c for c in df.columns if c in required]
    checks.append(("column order", present == [c for c in required if c in kinds]))
    spark = df.sparkSession
    out = spark.createDataFrame(checks, "check string, passed boolean")
    if all(c in kinds for c in unique):
        many = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) <= 1).alias("passed"))
        out = out.unionByName(many.select(F.lit("unique key").alias("check"), "passed"))
    for c, (lo, hi) in (ranges or {}).items():
        if c in kinds:
            out = out.unionByName(df.agg(F.coalesce(F.bool_and(F.col(c).between(lo, hi)), F.lit(True)).alias("passed")).select(F.lit(f"range of {c}").alias("check"), "passed"))
    return out.unionByName(out.agg(F.bool_and("passed").alias("passed")).select(F.lit("all").alias("check"), "passed"))


def first_product(products: DataFrame, key: str, order: list[str], product: str = "product") -> DataFrame:
    """Of each station's rows those of the first product that it has, in the given order."""
    rank: Column = F.array_position(F.array(*map(F.lit, order)), F.col(product))
    ranked = products.withColumn("__rank", rank).where("__rank > 0")
    best = ranked.groupBy(key).agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, [key, "__rank"]).drop("__rank")
