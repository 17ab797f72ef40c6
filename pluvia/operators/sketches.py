"""Quantiles of series too long to sort: mergeable sketches by day, kept and merged over any days, beside the exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: a few KB. A rank that it says is off by at most ERROR of the rows, with a confidence of 99 %.
SIZE, ERROR = 400, 0.0069


def by_day(df: DataFrame, keys: list[str], ts: str, value: str, size: int = SIZE) -> DataFrame:
    """keys, day, n, sketch of the values that are neither null nor NaN; days without any have no row. What moves is a sketch a task and (key, day), never the values."""
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v))
    return known.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, size).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """A sketch draws which values it keeps, so one that is made anew differs within the error: write it to use it twice.

    keys, n, sketch: sketches of several days (or of any parts) as one of all their values, within the same error."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def quantile(sketch: Column | str, part: float) -> Column:
    """A value that about `part` of a sketch's values don't exceed; it is one of them."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(part)))


def quantiles(sketches: DataFrame, keys: list[str], parts: list[float]) -> DataFrame:
    """keys, n, part, value."""
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("part"), quantile("sketch", p).alias("value")) for p in parts]))
    return sketches.select(*keys, "n", each.alias("q")).select(*keys, "n", "q.*")


def rank(values: DataFrame, keys: list[str], value: str, asked: DataFrame) -> DataFrame:
    """asked (keys, part, value and others) with below and upto: the parts of the values that are smaller, and that aren't larger. Holds a quantile against all values; there are few asked for."""
    v = F.col(f"v.{value}").cast("double")
    rows = values.alias("v").join(F.broadcast(asked.alias("a")), [F.col(f"v.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]).where(v.isNotNull() & ~F.isnan(v))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*[F.col(f"a.{c}").alias(c) for c in asked.columns]).agg(share(v < F.col("a.value")).alias("below"), share(v <= F.col("a.value")).alias("upto"))
