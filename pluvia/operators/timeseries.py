"""Irregular series keyed by station or link: resampling, filling, running totals, gaps, runs, rolling windows.

All take a DataFrame with key columns and a time column. A series of one key is ordered by time and then by `tie`, so results don't depend on the order of
rows; it is cut into chunks of time (see segments.py), so that one key may have all rows.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pluvia.operators import segments
from pluvia.operators.joins import join_back

#: The largest finite double.
LARGEST = sys.float_info.max
#: Steps of a gap that are made from one row at a time.
SPINE = 4096
_EMPTY = {"sum": 0.0, "count": 0}


def seconds(ts: Column) -> Column:
    """Seconds since the epoch as double, of a timestamp with or without time zone (read as UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def series(keys: list[str], ts: str, *tie: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts, *tie)


def so_far(keys: list[str], ts: str, *tie: str) -> WindowSpec:
    return series(keys, ts, *tie).rowsBetween(Window.unboundedPreceding, 0)


def mean_direction(degrees: Column) -> Column:
    """Direction of the mean vector, 0 to 360: what "mean" of directions is not across north."""
    a = F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))
    return F.when(a < 0, a + 360).otherwise(a)


def aggregate(rule: str, c: str) -> Column:
    """sum of nothing is 0; mean, max and min of nothing are null; mode ignores nulls and takes the smallest of ties."""
    return {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0.0)), "mean": lambda: F.avg(c), "max": lambda: F.max(c), "min": lambda: F.min(c),
        "mode": lambda: F.mode(c, True), "count": lambda: F.count(c), "first": lambda: F.first(c, True), "direction": lambda: mean_direction(F.col(c)),
    }[rule]()


def bins(df: DataFrame, keys: list[str], ts: str, step: int, out: str = "bin") -> DataFrame:
    """Start of the step (in seconds) that a row falls into, closed on the left, counted from midnight of the key's first day."""
    s = F.floor(seconds(F.col(ts))).cast("long")
    if 86400 % step == 0:
        return df.withColumn(out, F.timestamp_seconds(s - F.pmod(s, F.lit(step))))
    origin = df.groupBy(*keys).agg((F.floor(F.min(seconds(F.col(ts))) / 86400) * 86400).cast("long").alias("__origin"))
    return join_back(df, origin, keys).withColumn(out, F.timestamp_seconds(s - F.pmod(s - F.col("__origin"), F.lit(step)))).drop("__origin")


def resample(df: DataFrame, keys: list[str], ts: str, step: int, rules: dict[str, tuple[str, str]], spine: bool = True, out: str = "bin") -> DataFrame:
    """rules: new column -> (rule, column). With spine, every step between a key's first and last is there, empty ones included.

    Binned rows are aggregated in parts before the shuffle. The spine needs no join: each bin fills the gap up to the next one, in stretches of SPINE
    steps, so that a stray time decades away makes many rows but no array of them. Rows without a time are left out.
    """
    got = bins(df.where(F.col(ts).isNotNull()), keys, ts, step, out).groupBy(*keys, out).agg(*[aggregate(r, c).alias(n) for n, (r, c) in rules.items()])
    return spined(got, keys, step, {n: _EMPTY[r] for n, (r, _) in rules.items() if r in _EMPTY}, out=out) if spine else got


def spined(df: DataFrame, keys: list[str], step: int, empty: dict[str, float], carried: tuple[str, ...] = (), out: str = "bin") -> DataFrame:
    """df (one row a bin of a key) with every step between a key's first and last bin: in those that it hasn't, columns are null, but for those of `empty`,
    and for carried ones, which stay what they were. What is scanned before this (a running total) is scanned over the bins that are there alone."""
    got = df
    after, here = F.unix_seconds(F.lead(out).over(Window.partitionBy(*keys).orderBy(out))), F.unix_seconds(out)
    steps = got.withColumn("__n", F.coalesce(F.floor((after - here) / step).cast("long") - 1, F.lit(0).cast("long")))  # that follow in the gap
    parts = steps.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__n") / SPINE))))
    filled = parts.withColumn("__i", F.explode(F.sequence(F.col("__part") * SPINE, F.least(F.col("__n"), F.col("__part") * SPINE + SPINE - 1))))
    filled = filled.withColumn("__at", F.timestamp_seconds(here + F.col("__i") * step))
    real = F.col("__at") == F.col(out)

    def value(n: str) -> Column:
        kept = F.when(real, F.col(n))
        return F.col(n) if n in carried else (kept.otherwise(F.lit(empty[n])) if n in empty else kept).alias(n)

    return filled.select(*keys, F.col("__at").alias(out), *[value(n) for n in df.columns if n not in (*keys, out)])


def running_total(df: DataFrame, keys: list[str], ts: str, value: str, out: str = "total", nulls: str = "zero", tie: tuple[str, ...] = (), chunk: int = 86400) -> DataFrame:
    """Cumulative sum by key. nulls: 'zero' (a null adds nothing), 'skip' (null stays null, the sum goes on), 'clip' (negatives add nothing either).

    NaN counts as null. Every row stays: null keys are a key, and rows without a time come first in their series.

    In two levels, so that a key with very many rows is no single window: sums by (key, chunk of time) first, then within a chunk.
    """
    known = F.when(~F.isnan(value), F.col(value))
    x = F.coalesce(known, F.lit(0.0))
    if nulls == "clip":
        x = F.greatest(x, F.lit(0.0))
    rows, w = segments.chunked(df.withColumn("__x", x), keys, ts, tie, {"__before": (F.sum("__x"), segments.before)}, chunk)
    total = F.col("__before") + F.sum("__x").over(w.rowsBetween(Window.unboundedPreceding, 0))
    done = segments.without(rows.withColumn(out, total), "__x", "__before")
    return done.withColumn(out, F.when(known.isNotNull(), F.col(out))) if nulls == "skip" else done


def fill(df: DataFrame, keys: list[str], ts: str, value: str, how: str, out: str = "filled", tie: tuple[str, ...] = (), chunk: float = segments.CHUNK) -> DataFrame:
    """how: 'zero' (infinities become the largest finite numbers); 'forward' (then backward at the start); 'linear' (by position: leading nulls
    stay, trailing ones take the last value). NaN counts as null."""
    v = F.when(~F.isnan(value), F.col(value))
    if how == "zero":
        return df.withColumn(out, F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.coalesce(v, F.lit(0.0)))))
    order = segments.order_of(ts, tie)
    known = F.when(v.isNotNull(), order)
    edges = {"__p": (F.max_by(v, known), segments.last_before), "__q": (F.min_by(v, known), segments.first_after)}
    if how == "forward":
        rows, w = segments.chunked(df, keys, ts, tie, edges, chunk)
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        return segments.without(rows.withColumn(out, F.coalesce(F.last(v, True).over(back), "__p", F.first(v, True).over(ahead), "__q")), "__p", "__q")
    here = segments.numbered(df, keys, ts, tie, "__n", chunk, keep=True)
    point = F.when(v.isNotNull(), F.struct(F.col("__n").alias("n"), v.alias("v")))
    rows, w = segments.chunked(here.withColumn("__point", point), keys, ts, tie, {"__p": (F.max_by("__point", known), segments.last_before), "__q": (F.min_by("__point", known), segments.first_after)}, chunk, dealt=True)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("__p", F.coalesce(F.last("__point", True).over(back), "__p")).withColumn("__q", F.coalesce(F.first("__point", True).over(ahead), "__q"))
    p, q = F.col("__p"), F.col("__q")
    slope = F.try_divide(q["v"] - p["v"], q["n"] - p["n"])
    line = F.when(p.isNull(), None).when(q.isNull() | (q["n"] == p["n"]), p["v"]).otherwise(p["v"] + slope * (F.col("__n") - p["n"]))
    return segments.without(rows.withColumn(out, line), "__n", "__p", "__q", "__point")


def gaps(df: DataFrame, keys: list[str], ts: str, longest: float = 7200, tie: tuple[str, ...] = (), chunk: float = segments.CHUNK) -> DataFrame:
    """Rows that follow the one before by more than `longest` seconds, with previous_ts and gap_s."""
    return segments.neighbour(df, keys, ts, tie, {"previous_ts": F.col(ts)}, chunk).withColumn("gap_s", seconds(F.col(ts)) - seconds(F.col("previous_ts"))).where(F.col("gap_s") > longest)


def runs(df: DataFrame, keys: list[str], ts: str, value: str, tie: tuple[str, ...] = (), each_null: bool = True, chunk: float = segments.CHUNK) -> DataFrame:
    """Stretches of equal values: keys, run (1, 2, ...), value, start, end, n. each_null: every null is a run of its own; else nulls are equal.

    Runs are found in each chunk; one that goes on over a border is joined to the chunk before by the values on both sides of it."""
    rows = df.withColumn("__k", segments.key_of(keys)).withColumn("__chunk", segments.chunk_of(df, ts, chunk))
    w = Window.partitionBy("__k", "__chunk").orderBy(ts, *tie)

    def goes_on(here: Column, past: Column) -> Column:
        same = here.eqNullSafe(past)
        return same & here.isNotNull() if each_null else same

    same = goes_on(F.col(value), F.lag(value).over(w)) & F.lag(F.lit(True)).over(w).isNotNull()
    marked = rows.withColumn("__new", (~same).cast("long")).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = marked.groupBy("__k", "__chunk", "__run").agg(F.first(value).alias("__value"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))
    edges = parts.groupBy("__k", "__chunk").agg(F.max("__run").alias("runs"), F.min_by(F.struct("__value"), "__run").alias("first"), F.max_by(F.struct("__value"), "__run").alias("last"))
    over = Window.partitionBy("__k").orderBy("__chunk")
    past = F.lag("last").over(over)
    edges = edges.withColumn("on", (past.isNotNull() & goes_on(F.col("first")["__value"], past["__value"])).cast("long"))
    edges = edges.withColumn("ahead", segments.before("runs", over) - F.sum("on").over(over.rowsBetween(Window.unboundedPreceding, 0))).select("__k", "__chunk", "ahead")
    whole = parts.join(edges, ["__k", "__chunk"]).groupBy("__k", (F.col("ahead") + F.col("__run")).alias("run")).agg(F.first("__value").alias(value), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return whole.select(*[F.col("__k")[k].alias(k) for k in keys], "run", value, "start", "end", "n")


def rolling(keys: list[str], ts: str, ahead: int, *tie: str) -> WindowSpec:
    """A row and the ones that follow, `ahead` rows in all; shorter at the end of a series."""
    return series(keys, ts, *tie).rowsBetween(0, ahead - 1)


def at_instant(df: DataFrame, ts: str, instant) -> DataFrame:
    """Rows of exactly that time; none if there is none (not the first step, as a search for the largest match would give)."""
    return df.where(F.col(ts) == F.lit(instant).cast(df.schema[ts].dataType))


def last_days(df: DataFrame, ts: str, end: str, days: int) -> DataFrame:
    """Rows of the `days` days up to the instant end, both ends included."""
    kind = df.schema[ts].dataType
    until = F.lit(end).cast(kind)
    return df.where((F.col(ts) >= until - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= until))


def between_instants(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """start <= ts <= end; either may be missing. A day as end means its midnight."""
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is not None:
            lit = F.lit(bound).cast(df.schema[ts].dataType)
            df = df.where(F.col(ts) >= lit if op == ">=" else F.col(ts) <= lit)
    return df


def slice_days(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Whole days, the last one included; half-open, so it is pushed to the scan."""
    kind = df.schema[ts].dataType
    return df.where((F.col(ts) >= F.lit(first).cast(kind)) & (F.col(ts) < F.date_add(F.lit(last).cast("date"), 1).cast(kind)))


def latest(df: DataFrame, keys: list[str], ts: str, *tie: str) -> DataFrame:
    """The last row of each key, by a partial maximum instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("__r")).select(*keys, "__r.*")


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def resolution(df: DataFrame, keys: list[str], ts: str, *tie: str) -> DataFrame:
    """Median of the seconds between neighbours, by key."""
    step = seconds(F.col(ts)) - seconds(F.col("__past"))
    return segments.neighbour(df, keys, ts, tie, {"__past": F.col(ts)}).withColumn("__s", step).groupBy(*keys).agg(F.percentile("__s", 0.5).alias("resolution_s"))


def temporal_split(df: DataFrame, keys: list[str], ts: str, part: float = 0.7, tie: tuple[str, ...] = ()) -> DataFrame:
    """train: the first floor(part * n) rows of each key."""
    whole = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows, w = segments.chunked(df, keys, ts, tie, {"__ahead": (F.count(F.lit(1)), segments.before), "__all": (F.count(F.lit(1)), whole)})
    return segments.without(rows.withColumn("train", F.col("__ahead") + F.row_number().over(w) <= F.floor(F.lit(part) * F.col("__all"))), "__ahead", "__all")


def hash_split(df: DataFrame, ident: str, part: float = 0.8, seed: int = 0) -> DataFrame:
    """train: a deterministic random share of rows, by the first 32 bits of an MD5 of seed and identifier."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("train", drawn < F.lit(int(part * (1 << 32))))


def blocks(df: DataFrame, keys: list[str], ts: str, values: list[str], width: int = 32, tie: tuple[str, ...] = ()) -> DataFrame:
    """Non-overlapping blocks of `width` rows as arrays; a shorter rest is left out. Columns: keys, block, start, values..."""
    rows = segments.numbered(df, keys, ts, tie, "__n").withColumn("block", F.floor((F.col("__n") - 1) / width)).groupBy(*keys, "block").agg(F.min(ts).alias("start"), F.array_sort(F.collect_list(F.struct(ts, *tie, *values))).alias("__r"))
    def column(v: str) -> Column:
        return F.transform("__r", lambda row: row[v]).alias(v)

    return rows.where(F.size("__r") == width).select(*keys, "block", "start", *map(column, values))


def training_dataset(df: DataFrame, keys: list[str], ts: str, values: list[str], width: int = 32, part: float = 0.7, tie: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of `width` rows with values brought to mean 0 and deviation 1 over all rows; train: the first `part` of each key's blocks."""
    stats = df.agg(*[f(v).alias(f"__{n}_{v}") for v in values for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = df.crossJoin(F.broadcast(stats)).withColumns({v: F.try_divide(F.col(v) - F.col(f"__m_{v}"), F.col(f"__s_{v}")) for v in values})  # one row
    return temporal_split(blocks(scaled.select(*df.columns), keys, ts, values, width, tie), keys, "block", part)


def derivative(df: DataFrame, keys: list[str], ts: str, values: list[str], tie: tuple[str, ...] = (), chunk: float = segments.CHUNK) -> DataFrame:
    """d_<value>: central differences over a numeric time, one-sided at both ends. chunk: in units of that time."""
    row, order = F.struct(ts, *values), segments.order_of(ts, tie)
    rows, w = segments.chunked(df, keys, ts, tie, {"__past": (F.max_by(row, order), segments.last_before), "__next": (F.min_by(row, order), segments.first_after)}, chunk)
    rows = rows.withColumns({"__past": F.coalesce(F.lag(row).over(w), "__past"), "__next": F.coalesce(F.lead(row).over(w), "__next")})

    def diff(v: str) -> Column:
        lo, hi = (F.coalesce(F.col(n)[v], F.col(v)) for n in ("__past", "__next"))
        return F.try_divide(hi - lo, F.coalesce(F.col("__next")[ts], F.col(ts)) - F.coalesce(F.col("__past")[ts], F.col(ts)))

    return segments.without(rows.withColumns({f"d_{v}": diff(v) for v in values}), "__past", "__next")


def integrate_rate(df: DataFrame, keys: list[str], ts: str, rate: str, longest: float = 3600, tie: tuple[str, ...] = (), out: str = "amount") -> DataFrame:
    """Amount of a rate per hour until the next row, at most `longest` seconds; a sum of rates is no amount, a sum of these is."""
    rows = segments.neighbour(df, keys, ts, tie, {"__next": F.col(ts)}, ahead=True)
    span = seconds(F.col("__next")) - seconds(F.col(ts))
    return rows.withColumn(out, F.col(rate) * F.least(F.coalesce(span, F.lit(0.0)), F.lit(float(longest))) / 3600).drop("__next")


def normalization(df: DataFrame, values: list[str]) -> DataFrame:
    """One row a value: mean and population deviation, from one pass."""
    row = df.agg(*[f(v).alias(f"{n}_{i}") for i, v in enumerate(values) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"m_{i}").alias("mean"), F.col(f"s_{i}").alias("deviation")) for i, v in enumerate(values)])))
