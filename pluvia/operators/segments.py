"""Segmented scans: a long series is no single window.

Rows are dealt by (key, chunk of time). What crosses the borders of chunks (a sum, the last known value, the first time, a number of rows) is aggregated by chunk in
parts, scanned by key over one row a chunk, and meets the rows again in the dealing that the window inside a chunk needs: rows move once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of a chunk (or units of a time that is a number), and rows of a block.
CHUNK, BLOCK = 86400, 1 << 16
_FIRST = -(1 << 62)

Scans = dict[str, tuple[Column, Callable[[str, WindowSpec], Column]]]


def key_of(keys: list[str]) -> Column:
    """Key columns as one value that is never null itself, so that joins and windows on it share one dealing of rows, and null is a key like any other."""
    return F.struct(*keys) if keys else F.lit(0)


def chunk_of(df: DataFrame, ts: str, chunk: float) -> Column:
    """Number of the chunk that a time is in; rows without a time have one of their own, before all others. Times of other kinds (strings) are one chunk."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (chunk * 1_000_000))
    elif isinstance(kind, T.NumericType):
        at = F.floor(F.col(ts).cast("double") / chunk)
    else:
        at = F.lit(0)
    return F.coalesce(F.greatest(at.cast("long"), F.lit(_FIRST + 1)), F.lit(_FIRST))


def before(c: str, w: WindowSpec) -> Column:
    """Sum over the earlier chunks."""
    return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def last_before(c: str, w: WindowSpec) -> Column:
    """Last value that isn't null of the earlier chunks."""
    return F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def first_after(c: str, w: WindowSpec) -> Column:
    """First value that isn't null of the later chunks."""
    return F.first(c, True).over(w.rowsBetween(1, Window.unboundedFollowing))


def chunked(df: DataFrame, keys: list[str], ts: str, tie: tuple[str, ...], scans: Scans, chunk: float = CHUNK, dealt: bool = False) -> tuple[DataFrame, WindowSpec]:
    """df with the scanned columns, and the window of a chunk in the order of (time, tie). scans: new column -> (aggregate of a chunk, scan of its column over the chunks of a key).

    The rows have __k and __chunk too; without() takes them away. dealt: df has them already, so its rows don't move again.
    """
    rows = df if dealt else df.withColumn("__k", key_of(keys)).withColumn("__chunk", chunk_of(df, ts, chunk))
    part = rows.groupBy("__k", "__chunk").agg(*[a.alias(n) for n, (a, _) in scans.items()])
    over = Window.partitionBy("__k").orderBy("__chunk")
    part = part.select("__k", "__chunk", *[scan(n, over).alias(n) for n, (_, scan) in scans.items()])
    return rows.join(part, ["__k", "__chunk"]), Window.partitionBy("__k", "__chunk").orderBy(ts, *tie)


def without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop("__k", "__chunk", *names)


def order_of(ts: str, tie: tuple[str, ...]) -> Column:
    return F.struct(F.col(ts), *map(F.col, tie))


def numbered(df: DataFrame, keys: list[str], ts: str, tie: tuple[str, ...], out: str, chunk: float = CHUNK, keep: bool = False) -> DataFrame:
    """out: the row's place in its series, from 1. keep: with __k and __chunk."""
    rows, w = chunked(df, keys, ts, tie, {"__ahead": (F.count(F.lit(1)), before)}, chunk)
    rows = rows.withColumn(out, F.col("__ahead") + F.row_number().over(w)).drop("__ahead")
    return rows if keep else without(rows)


def neighbour(df: DataFrame, keys: list[str], ts: str, tie: tuple[str, ...], values: dict[str, Column], chunk: float = CHUNK, ahead: bool = False) -> DataFrame:
    """values: new column -> what it holds of the row before (ahead: of the row after); null where there is none."""
    row = F.struct(*[c.alias(n) for n, c in values.items()])
    edge = F.min_by(row, order_of(ts, tie)) if ahead else F.max_by(row, order_of(ts, tie))
    rows, w = chunked(df, keys, ts, tie, {"__edge": (edge, first_after if ahead else last_before)}, chunk)
    near = F.lead(row).over(w) if ahead else F.lag(row).over(w)
    rows = rows.withColumn("__near", F.coalesce(near, F.col("__edge")))
    return without(rows.withColumns({n: F.col("__near")[n] for n in values}), "__near", "__edge")


def rolled(df: DataFrame, keys: list[str], ts: str, tie: tuple[str, ...], rows_ahead: int, values: Callable[[WindowSpec], dict[str, Column]], chunk: float = CHUNK, block: int = BLOCK) -> DataFrame:
    """values(window) over a row and the ones that follow, rows_ahead in all. A series is cut into blocks of rows, and a block takes the first rows of the next one along."""
    halo, size = rows_ahead - 1, max(block, rows_ahead - 1)
    place = F.col("__n") - 1
    rows = numbered(df, keys, ts, tie, "__n", chunk).withColumn("__k", key_of(keys)).withColumn("__own", F.floor(place / size))
    own, lent = F.array("__own"), F.array(F.col("__own"), F.col("__own") - 1)
    rows = rows.withColumn("__block", F.explode(F.when((F.col("__own") > 0) & (place % size < halo), lent).otherwise(own)))
    w = Window.partitionBy("__k", "__block").orderBy("__n").rowsBetween(0, halo)
    return without(rows.withColumns(values(w)).where("__own = __block"), "__n", "__own", "__block")
