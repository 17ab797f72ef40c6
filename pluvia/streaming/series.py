"""Structured Streaming forms of the series operators. Event times need a TIMESTAMP column; `late` bounds the state that is kept."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from pluvia.operators.timeseries import aggregate

#: Airport minutes arrive up to so late.
LATE = "36 hours"
#: Groups that series are dealt to for their state; rows of a batch in it, and rows whose deviations are taken at once.
BUCKETS, _ROWS = 1024, 1 << 16
_WAITING = pa.schema([("key", pa.string()), ("at", pa.int64()), ("value", pa.float64())])
_PAST = _WAITING.append(pa.field("until", pa.int64()))  # of a series without waiting rows: when its past goes


def deduped(stream: DataFrame, keys: list[str], ts: str, late: str = LATE) -> DataFrame:
    """A poll repeats what it sent before: each (key, time) once."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, ts])


def resampled(stream: DataFrame, keys: list[str], ts: str, step: str, rules: dict[str, tuple[str, str]], late: str = LATE) -> DataFrame:
    """Tumbling windows with the rules of the batch operator; a window is emitted when no row for it may come any more (append mode)."""
    got = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, step).alias("w")).agg(*[aggregate(r, c).alias(n) for n, (r, c) in rules.items()])
    return got.select(*keys, F.col("w.start").alias("bin"), *rules)


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str = "2 hours", late: str = LATE) -> DataFrame:
    """Stretches without a gap: keys, start, end (of the last row), n."""
    got = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("end"))
    return got.select(*keys, F.col("w.start").alias("start"), "end", "n")


class RollingDeviation(StatefulProcessor):
    """State of a bucket of series, as Arrow batches: the rows that wait for the watermark, and of each series the last ones that it has passed. A timer stands at the first waiting row,
    or where the first series is to go. A call of the state takes as long as thousands of rows in it, so calls are made by bucket, not by series."""

    def __init__(self, rows: int, keep_ms: int) -> None:
        self.rows, self.keep_ms = rows, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "batch binary")
        self.past = handle.getListState("past", "batch binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64").to_numpy()
            names = pa.array(frame["key"], pa.string(), from_pandas=True)
            _append(self.waiting, pa.table([names, at, frame["value"].astype(float).to_numpy()], _WAITING))
            first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            self._wake(_passed(first), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting, past = _read(self.waiting, _WAITING), _read(self.past, _PAST)
        due = pc.less_equal(waiting["at"], mark * 1000)
        done, rest = waiting.filter(due), waiting.filter(pc.invert(due))
        new = done.append_column(_PAST.field("until"), pa.array(np.full(len(done), mark + self.keep_ms)))
        # rows of the past, then those that are done, by series, time and value
        both = pa.concat_tables([past, new])
        names = pa.chunked_array(both["key"].chunks + rest["key"].chunks, pa.string()).combine_chunks().dictionary_encode("encode")
        series, stay = np.split(names.indices.to_numpy(), [len(both)])
        at, value, until = (both[c].to_numpy() for c in ("at", "value", "until"))
        order = np.lexsort((value, at, series))
        series, at, value, until = series[order], at[order], value[order], until[order]
        if len(done):
            said = np.array(names.dictionary.to_pylist(), object)
            for rows, sigma in self._deviations(series, value, order >= len(past)):
                yield pd.DataFrame({"key": said[series[rows]], "at": pd.to_datetime(at[rows], unit="us"), "value": value[rows], "sigma": sigma})
        if len(both):
            starts = np.flatnonzero(np.diff(series, prepend=-1))
            sizes = np.diff(starts, append=len(series))
            until = np.maximum.reduceat(until, starts)
            stays = np.isin(series[starts], stay)
            kept = stays | (until > mark)
            if len(done) or not kept.all():
                behind = np.repeat(starts + sizes, sizes) - np.arange(len(series))  # 1: the last row of its series
                last = np.flatnonzero((behind < self.rows) & np.repeat(kept, sizes))
                _put(self.past, pa.table([both["key"].take(order[last]), at[last], value[last], np.repeat(until, sizes)[last]], _PAST))
            goes = until[kept & ~stays]
        if len(done):
            _put(self.waiting, rest)
        wakes = [_passed(pc.min(rest["at"]).as_py())] if len(rest) else []
        if len(both) and len(goes) and self.rows > 1:
            wakes.append(int(goes.min()))
        if wakes:
            self._wake(min(wakes), mark)

    def _deviations(self, series: np.ndarray, value: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of wanted rows, and their deviations, some rows at a time."""
        ahead = self.rows - 1
        series, value = np.concatenate([np.full(ahead, -1), series]), np.concatenate([np.full(ahead, np.nan), value])
        for i in range(0, len(wanted), _ROWS):
            rows = i + np.flatnonzero(wanted[i : i + _ROWS])
            frames = np.lib.stride_tricks.sliding_window_view(value[i : i + _ROWS + ahead], self.rows)[rows - i]
            known = np.lib.stride_tricks.sliding_window_view(series[i : i + _ROWS + ahead], self.rows)[rows - i] == series[rows + ahead, None]
            known &= ~np.isnan(frames)
            n = known.sum(axis=1)
            mean = np.where(known, frames, 0.0).sum(axis=1) / np.maximum(n, 1)
            spread = (np.where(known, frames - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(n, 1)
            yield rows, np.where(n > 0, np.sqrt(spread), np.nan)

    def _wake(self, at_ms: int, mark: int) -> None:
        """A timer that is still to go off before is enough: it sets the next one. Those up to the watermark, the one that just went off too, are on the list until they are deleted."""
        if not any(mark < t <= at_ms for t in self.handle.listTimers()):
            self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


def _passed(at: int) -> int:
    """The first millisecond at which a watermark has passed a time in microseconds."""
    return -(-at // 1000)


def _read(state: ListState, schema: pa.Schema) -> pa.Table:
    held = [pa.ipc.open_stream(bytes(b)).read_all() for (b,) in state.get()] if state.exists() else []
    return pa.concat_tables(held) if held else schema.empty_table()


def _append(state: ListState, table: pa.Table) -> None:
    for i in range(0, len(table), _ROWS):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as to:
            to.write_table(table.slice(i, _ROWS))
        state.appendValue((out.getvalue().to_pybytes(),))


def _put(state: ListState, table: pa.Table) -> None:
    state.clear()
    _append(state, table)


def rolling_deviation(stream: DataFrame, key: str, ts: str, value: str, rows: int = 8, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """key, ts, value, sigma: population deviation of a row and the ones before it, `rows` in all, in the order of (time, value); null and NaN count as missing.

    A row waits until the watermark has passed it, so rows that come late (within `late`) and rows of equal times take their places; what is
    later still is left out. State is a series' waiting rows and the last rows - 1 values before them; it goes when the watermark has passed a series' last row by
    another `late`, and a series that goes on after that starts anew. Rows still waiting when the query stops are emitted when it goes on.
    Series are dealt to `buckets` by their hash; a task holds one bucket at a time, so have as many that a bucket's waiting rows and last values (about 30 bytes each) fit it.
    The number is part of the checkpoint. A key travels as a string, so its type has to be one that casts to it and back.
    The batch operator looks ahead instead: its sigma of a row is this one's rows - 1 rows later. Needs the state store of RocksDB (see rocksdb()).
    """
    kind = dict(stream.dtypes)[key]
    keep = int(pd.Timedelta(late).total_seconds() * 1000)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    rows_of = stream.withWatermark(ts, late).where(F.col(ts).isNotNull()).select(bucket, F.col(key).cast("string").alias("key"), F.col(ts).alias("at"), F.col(value).cast("double").alias("value"))
    got = rows_of.groupBy("bucket").transformWithStateInPandas(RollingDeviation(rows, keep), "key string, at timestamp, value double, sigma double", "append", "EventTime")
    return got.select(F.col("key").cast(kind).alias(key), F.col("at").alias(ts), F.col("value").alias(value), "sigma")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that rolling_deviation() needs, for queries started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
