"""A Python data source for NetCDF files of links, station groups and radar. The classic format is read here; files that are HDF5 inside need netCDF4 where they are opened."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from pluvia.sources.classic import Classic
from pluvia.sources.paths import listed, opened

#: Cells of a record batch.
_CELLS = 1 << 18
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


class Slice(InputPartition):
    """A range of time steps of a variable, or of a group's."""

    def __init__(self, path: str, group: str | None, first: int, last: int):
        super().__init__((path, group, first, last))
        self.path, self.group, self.first, self.last = path, group, first, last


def slices(n: int, size: int, first: int = 0) -> list[tuple[int, int]]:
    """Ranges of at most `size` steps."""
    return [(a, min(n, a + size)) for a in range(first, n, size)]


def instants(values: np.ndarray, units: str | None) -> np.ndarray:
    """Microseconds since 1970 of numbers in units such as "minutes since 2015-06-01 00:00:00"; without units, of seconds since 1970."""
    found = re.match(r"\s*(sec|s|min|m|hour|h|day|d)\w*\s+since\s+([0-9-]+)(?:[T ]([0-9:.]+))?", units or "seconds since 1970-01-01", re.IGNORECASE)
    if not found:
        raise ValueError(f"unknown units of time: {units}")
    start = datetime.fromisoformat(f"{found[2]} {(found[3] or '00:00:00').split('.')[0]}").replace(tzinfo=timezone.utc)
    each = _UNITS[found[1][0].lower()] * 1_000_000
    numbers = np.ma.filled(np.ma.asarray(values), 0)
    scaled = numbers.astype(np.int64) * each if numbers.dtype.kind in "iu" else np.round(numbers.astype(float) * each).astype(np.int64)
    return int(start.timestamp()) * 1_000_000 + scaled


def cells(times: np.ndarray, data: list[np.ndarray], names: list[str], group: str | None = None, sentinel: float | None = None, places: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches with a row a cell: keys (group, or the places along the dimensions after the first), ts, values. Masked cells, NaN and the sentinel are null.
    times: microseconds; places: these of the second dimension alone."""
    flat = [np.ma.filled(np.ma.asarray(d).astype(float), np.nan).reshape(len(times), *(d.shape[1:] or (1,))) for d in data]
    inner = flat[0].shape[1:]
    if places is not None:
        places = [p for p in places if 0 <= p < inner[0]]
        flat = [d[:, places] for d in flat]
    grid = np.meshgrid(*[np.array(places) if i == 0 and places is not None else np.arange(n) for i, n in enumerate(inner)], indexing="ij")
    n = grid[0].size
    step = max(1, _CELLS // max(1, n))
    for at in range(0, len(times) if n else 0, step):
        some = times[at : at + step]
        keys = [pa.array([group] * (len(some) * n), pa.string())] if group is not None else [pa.array(np.tile(g.ravel(), len(some)).astype(np.int32)) for g in grid]
        values = [d[at : at + step].ravel() for d in flat]
        hidden = [np.isnan(v) | (v == sentinel if sentinel is not None else False) for v in values]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(np.repeat(some, n), pa.timestamp("us", "UTC")), *[pa.array(v, pa.float64(), mask=h) for v, h in zip(values, hidden)]], names)


def attributes(file) -> Iterator[tuple[str, str, str]]:
    """(object, key, value) of a file's own attributes (object: empty), and of its variables' and groups'."""
    for name, thing in [("", file), *file.variables.items(), *file.groups.items()]:
        for key in thing.ncattrs():
            yield name, key, str(thing.getncattr(key))


def readable(groups: dict, variables: list[str]) -> list[str]:
    """Names of the groups that have a time and all variables; others are skipped."""
    return [name for name, g in groups.items() if all(v in getattr(g, "variables", {}) for v in ("time", *variables))]


class NetCDF(DataSource):
    """options: path (a file, or a folder of them); variables (comma-separated); dimension (second dimension's name), or y_x ("true": rasters, y and x);
    groups ("true": each group a station, bad ones skipped); first, last (time steps) and at (place of the second dimension): a part alone;
    sentinel (a number that means null); steps (time steps of a partition); attributes ("true": object, key, value instead).

    With spark.sql.python.filterPushdown.enabled and the option pushdown ("true"; load() sets it), bounds of ts choose the time steps that are read (a partition that holds none isn't made), and equalities of the second dimension its places."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_long"

    def schema(self) -> str:
        if self.options.get("attributes") == "true":
            return "object string, key string, value string"
        dim = self.options.get("dimension", "sublink")
        key = "station_id string" if self.options.get("groups") == "true" else "y int, x int" if self.options.get("y_x") == "true" else f"{dim} int"
        return f"{key}, ts timestamp, " + ", ".join(f"{v} double" for v in self.options["variables"].split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else NetCDFReader)(self.options, schema)


class NetCDFReader(DataSourceReader):
    def __init__(self, options, schema: StructType | None = None):
        self.options = dict(options)
        self.variables = self.options.get("variables", "").split(",")
        self.names = schema.names if schema is not None else []
        self.least, self.most = -(1 << 63), (1 << 63) - 1  # microseconds, both included
        self.places = {int(self.options["at"])} if "at" in self.options else None

    def files(self) -> list[str]:
        return listed(self.options["path"])

    def open(self, path: str):
        stream = opened(path)
        if stream.read(3) == b"CDF":
            stream.seek(0)
            return Classic(stream)
        stream.close()
        try:
            import netCDF4
        except ImportError as e:
            raise ImportError("reading NetCDF files that are HDF5 inside needs the package netCDF4 on every executor") from e
        return netCDF4.Dataset(path)

    def partitions(self):
        o = self.options
        if o.get("attributes") == "true":
            return [Slice(path, None, 0, 0) for path in self.files()]
        size, first = int(o.get("steps", 50_000)), int(o.get("first", 0))
        out = []
        for path in self.files():
            with self.open(path) as f:
                for g in readable(f.groups, self.variables) if o.get("groups") == "true" else [None]:
                    time = (f.groups[g] if g else f).variables["time"]
                    for a, b in slices(min(len(time), int(o.get("last", 1 << 62))), size, first):
                        at = instants(time[a:b], getattr(time, "units", None))
                        if at.max() >= self.least and at.min() <= self.most:
                            out.append(Slice(path, g, a, b))
        return out

    def read(self, part: Slice | None):
        if part is None:  # no partition is left
            return
        o = self.options
        with self.open(part.path) as f:
            if o.get("attributes") == "true":
                yield from attributes(f)
                return
            group = f.groups[part.group] if part.group else f
            time = group.variables["time"]
            times = instants(time[part.first : part.last], getattr(time, "units", None))
            asked = np.flatnonzero((times >= self.least) & (times <= self.most))
            if not len(asked):
                return
            a, b = int(asked[0]), int(asked[-1]) + 1  # times between them that aren't asked for are left to Spark
            data = [group.variables[v][part.first + a : part.first + b] for v in self.variables]
            names = self.names or ["key", "ts", *self.variables]
            yield from cells(times[a:b], data, names, part.group, float(o["sentinel"]) if "sentinel" in o else None, None if self.places is None else sorted(self.places))


class PushingReader(NetCDFReader):
    """A reader that Spark gives filters; Spark refuses one where spark.sql.python.filterPushdown.enabled is false."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """What the filters say of times and places; Spark still checks all of them."""
        place = self.names[0] if self.options.get("groups") != "true" and self.options.get("attributes") != "true" and self.names else None
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In) and len(f.attribute) == 1 else None
            if name == "ts" and not isinstance(f, In):
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                micros = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.least = max(self.least, micros)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.most = min(self.most, micros)
            elif name is not None and name == place and isinstance(f, EqualTo | In):
                asked = {int(v) for v in ((f.value,) if isinstance(f, EqualTo) else f.value)}
                self.places = asked if self.places is None else self.places & asked
            yield f


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Rows of a file or a folder of them (see NetCDF for options), with filters pushed down where the session lets data sources have them."""
    spark.dataSource.register(NetCDF)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("netcdf_long").options(path=path, pushdown=pushed, **options).load()
