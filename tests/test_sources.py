"""Landed files in, files out, chunk plans, streams."""

import io
import json
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.sources import archive, classic, generate, netcdf, planning, polling, readers, sinks
from pluvia.streaming import series


def test_airport_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station,valid(UTC),tmpf,sknt,ptype,precip\nJFK,2024-01-01 00:00,32,10,R+,0.1\nJFK,2024-01-01 00:00,99,10,NP,0\nJFK,2024-01-01 00:01,M,,nan,T\n")
    got = readers.asos_metric(readers.asos_csv(spark, str(tmp_path / "a.csv"))).orderBy("datetime").collect()
    assert [(r.station_id, r.temp_c, r.precip_category, r.precip_mm) for r in got] == [("JFK", 0.0, "rain", 2.54), ("JFK", None, "missing", None)]
    assert abs(got[0].wind_speed_ms - 5.1444) < 1e-9 and got[1].precip_type is None and got[0].wind_gust_ms is None


def test_station_json(spark, tmp_path):
    payload = {"observations": [{"stationID": "S", "obsTimeUtc": "2024-01-01T05:00:00Z", "obsTimeLocal": "2024-01-01 00:00:00", "epoch": 1, "metric": {"precipRate": 1.5, "tempAvg": 2.0}}]}
    (tmp_path / "p.json").write_text(json.dumps(payload))
    raw = readers.observations_json(spark, str(tmp_path / "p.json"))
    got = readers.station_times(readers.simple_names(raw))
    assert got.columns[:2] == ["precip_rate", "precip_total"] and len(got.columns) == 37
    r = got.first()
    assert r.precip_rate == 1.5 and r.time_utc == datetime(2024, 1, 1, 5) and r.time_local == datetime(2024, 1, 1)
    assert set(readers.original_names(readers.simple_names(raw)).columns) == set(raw.columns)
    assert readers.simple_names(raw, keep_original=True).columns[-1] == "qc_status_orig"
    assert readers.hourly_between(raw, "2024-01-01 00:00:00", "2024-01-01 01:00:00").count() == 1


def test_wide_gauges(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Time_UTC,Pvol_mm,Pvol_QC,Mid\n2015-06-01 00:15:00,NA,1,0.2\n")
    got = {r.gauge: (r.ts, r.rain_mm, r.qc) for r in readers.wide_gauges(spark, str(tmp_path / "g.csv"), 900).collect()}
    assert got == {"Pvol": (datetime(2015, 6, 1), None, "1"), "Mid": (datetime(2015, 6, 1), 0.2, None)}


def test_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿Name,Unnamed: 0,Frequency\na,0,23000\n", encoding="utf-8")
    df = readers.metadata_csv(spark, str(tmp_path / "m.csv"))
    assert df.columns == ["Name", "Frequency"]
    got = readers.link_metadata(df.withColumn("l", F.lit(1500)), "Frequency", "l", True, True).first()
    assert (got.frequency_ghz, got.length_km) == (23.0, 1.5)
    assert readers.files(spark, str(tmp_path), "*.csv").count() == 1


def test_chunks(spark):
    assert [(str(r["first"]), str(r["last"])) for r in planning.day_chunks(spark, "2024-01-01", "2024-02-02").collect()] == [("2024-01-01", "2024-02-01")]
    assert planning.day_chunks(spark, "2024-01-01", "2024-01-20").first()["last_stamp"] == "20240120"
    assert [r.month for r in planning.month_chunks(spark, ["JFK"], "2024-01-15", "2024-03-01").orderBy("month").collect()] == ["2024-01", "2024-02"]
    v = planning.valid_range(datetime(2024, 5, 1), datetime(2024, 9, 1), datetime(2024, 4, 1))
    assert (v.start, v.end, v.long) == (datetime(2024, 3, 25), datetime(2024, 4, 1), False)
    assert planning.parameters(spark).groupBy("system").count().orderBy("system").collect()[0]["count"] == 15


def test_netcdf_slices_and_schema():
    assert netcdf.slices(10, 4) == [(0, 4), (4, 8), (8, 10)] and netcdf.slices(10, 4, 7) == [(7, 10)]
    assert netcdf.NetCDF({"attributes": "true", "path": "x"}).schema() == "object string, key string, value string"
    assert netcdf.NetCDF({"variables": "data", "y_x": "true", "path": "x"}).schema() == "y int, x int, ts timestamp, data double"
    assert netcdf.NetCDF({"variables": "rsl,tsl", "path": "x"}).schema() == "sublink int, ts timestamp, rsl double, tsl double"


class Thing:
    """What netCDF4 has of a file, a group or a variable, over an array."""

    def __init__(self, data=None, variables=None, groups=None, **attrs):
        self.data, self.variables, self.groups, self.attrs = data, variables or {}, groups or {}, attrs
        self.__dict__.update(attrs)

    def __getitem__(self, at):
        return self.data[at]

    def __len__(self):
        return len(self.data)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def ncattrs(self):
        return list(self.attrs)

    def getncattr(self, key):
        return self.attrs[key]


def test_netcdf_reads(monkeypatch):
    utc = lambda *x: datetime(*x, tzinfo=netcdf.timezone.utc)
    time = Thing(np.array([0, 1, 2]), units="minutes since 2015-06-01 00:00:00")
    rsl = Thing(np.ma.masked_equal(np.array([[1.0, 2.0], [3.0, 1e10], [-1.0, np.nan]]), -1.0), units="dBm")
    group = lambda *names: Thing(variables={n: Thing(np.array([0.5, 0.6, 0.7]) if n != "time" else np.array([0, 3600, 7200])) for n in names})
    file = Thing(variables={"time": time, "rsl": rsl}, groups={"S1": group("time", "rain"), "bad": group("rain")}, contact="nobody")
    monkeypatch.setattr(netcdf.NetCDFReader, "open", lambda self, path: file)
    monkeypatch.setattr(netcdf.NetCDFReader, "files", lambda self: ["x"])

    def read(**options):
        reader = netcdf.NetCDFReader({"path": "x", "variables": "rsl", **options})
        got = [r for p in reader.partitions() for r in reader.read(p)]
        return [tuple(x.values()) for b in got for x in b.to_pylist()] if got and not isinstance(got[0], tuple) else got

    t = [utc(2015, 6, 1, 0, m) for m in range(3)]
    assert read(sentinel="1e10", steps="2") == [(0, t[0], 1.0), (1, t[0], 2.0), (0, t[1], 3.0), (1, t[1], None), (0, t[2], None), (1, t[2], None)]
    assert read(first="1", last="2", at="0") == [(0, t[1], 3.0)]
    assert read(groups="true", variables="rain") == [("S1", utc(1970, 1, 1, h), v) for h, v in enumerate((0.5, 0.6, 0.7))]
    assert read(attributes="true") == [("", "contact", "nobody"), ("time", "units", "minutes since 2015-06-01 00:00:00"), ("rsl", "units", "dBm")]
    raster = [x for b in netcdf.cells(netcdf.instants(np.array([0]), "hours since 2020-01-01"), [np.arange(6).reshape(1, 2, 3)], ["y", "x", "ts", "v"]) for x in b.to_pylist()]
    assert tuple(raster[4].values()) == (1, 1, utc(2020, 1, 1), 4.0) and len(raster) == 6


def link_file(n=50, places=3, fill=-999):
    time = np.arange(n, dtype=np.int32) * 10
    rsl = (np.arange(n * places).reshape(n, places) - 40).astype(np.int16)
    rsl[5, 1] = fill
    return classic.encoded(
        {"time": None, "sublink": places, "text": 5},
        {"time": (("time",), time, {"units": "minutes since 2015-06-01 00:00:00"}), "rsl": (("time", "sublink"), rsl, {"_FillValue": np.int16(fill), "scale_factor": 0.5, "add_offset": 1.0}),
         "tsl": (("time", "sublink"), rsl.astype(np.float32) * 2, {}), "frequency": (("sublink",), np.array([10.5, 20.25, 30.0]), {"units": "GHz"}), "name": (("text",), np.frombuffer(b"links", "S1"), {})},
        {"title": "été", "version": [1.0, 2.5]},
    )


def test_classic_format():
    f = classic.Classic(io.BytesIO(link_file()))
    assert (f.getncattr("title"), f.getncattr("version"), list(f.variables)) == ("été", [1.0, 2.5], ["time", "rsl", "tsl", "frequency", "name"])
    rsl, tsl = f.variables["rsl"], f.variables["tsl"]
    assert rsl.shape == (50, 3) and rsl.dimensions == ("time", "sublink") and f.variables["time"].units.startswith("minutes")
    assert rsl[4:6].tolist() == [[-13.0, -12.5, -12.0], [-11.5, None, -10.5]] and tsl[4:5].tolist() == [[-56.0, -54.0, -52.0]]
    assert f.variables["frequency"][:].tolist() == [10.5, 20.25, 30.0] and f.variables["time"][48:99].tolist() == [480, 490] and f.variables["name"][:].tobytes() == b"links"
    one = classic.Classic(io.BytesIO(classic.encoded({"t": None}, {"v": (("t",), np.arange(7, dtype=np.int16), {})})))
    assert one.record_size == 2 and one.variables["v"][2:5].tolist() == [2, 3, 4]  # a single record variable isn't padded
    none = classic.Classic(io.BytesIO(classic.encoded({}, {})))
    assert none.variables == {} and none.ncattrs() == []
    with pytest.raises(ValueError):
        classic.Classic(io.BytesIO(b"CDF\x09"))


def test_netcdf_files_through_spark(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(link_file())
    read = lambda **o: netcdf.load(spark, str(tmp_path), variables="rsl,tsl", **o)
    rows = {(r.sublink, r.ts): (r.rsl, r.tsl) for r in read().collect()}
    assert len(rows) == 150 and sum(v[0] is None for v in rows.values()) == 1 and rows[2, datetime(2015, 6, 1, 0, 40)] == (-12.0, -52.0)
    assert {(r.object, r.key) for r in read(attributes="true").collect()} >= {("", "title"), ("rsl", "scale_factor"), ("time", "units")}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = read(steps="10").where("ts >= timestamp '2015-06-01 03:00:00' and ts < timestamp '2015-06-01 03:30:00' and sublink = 1")
        assert sorted((r.sublink, r.ts.minute, r.rsl) for r in part.collect()) == [(1, m, -19.5 + 1 + 1.5 * (18 + m // 10)) for m in (0, 10, 20)]
        assert read(steps="10").where("sublink in (0, 2, 9)").count() == 100 and read().where("ts > timestamp '2016-01-01'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    reader = netcdf.PushingReader({"path": str(tmp_path), "variables": "rsl,tsl", "steps": "10"}, read().schema)
    assert len(reader.partitions()) == 5
    list(reader.pushFilters([netcdf.GreaterThanOrEqual(("ts",), datetime(2015, 6, 1, 3)), netcdf.LessThan(("ts",), datetime(2015, 6, 1, 3, 20)), netcdf.EqualTo(("sublink",), 1)]))
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(10, 20), (20, 30)]  # the upper bound is read too, Spark leaves it out
    assert [b.num_rows for p in parts for b in reader.read(p)] == [2, 1]


def test_archives(spark, tmp_path):
    for name, n in (("a", 3), ("b", 20_000)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("x/one.csv", "\ufeffid,v\n" + "".join(f"{i},{i / 2}\n" for i in range(n)))
            z.writestr("x/two.csv", "id,v")
            z.writestr("note.txt", "line\r\n\nlast")
            z.mkdir("empty")
    got = archive.csv(spark, str(tmp_path), "id INT, v DOUBLE")
    assert got.rdd.getNumPartitions() == 4  # a member each
    assert sorted((r.archive[-5:], r.id, r.v) for r in got.collect()) == sorted([("a.zip", i, i / 2) for i in range(3)] + [("b.zip", i, i / 2) for i in range(20_000)])
    assert sorted((r.member, r.size) for r in archive.members(spark, str(tmp_path / "a.zip")).collect())[0] == ("note.txt", 11)
    assert sorted((r.line, r.text) for r in archive.lines(spark, str(tmp_path / "a.zip"), "*.txt").collect()) == [(0, "line"), (1, ""), (2, "last")]
    assert archive.lines(spark, str(tmp_path), "nothing").count() == 0


def test_current_conditions_lose_nothing(spark, tmp_path):
    history = {"observations": [{"stationID": "S", "epoch": 1, "metric": {"tempAvg": 2}}]}
    current = {"observations": [{"stationID": "S", "epoch": 2, "humidity": 71.0, "neighborhood": "Pier", "metric": {"temp": 3.5, "windSpeed": 4}}]}
    (tmp_path / "a.json").write_text(json.dumps(history))
    (tmp_path / "b.json").write_text(json.dumps(current))
    (tmp_path / "c.json").write_text(json.dumps({"summaries": [{"stationID": "S", "epoch": 3}, {"stationID": "S", "epoch": 4}]}))
    (tmp_path / "d.json").write_text(json.dumps({"error": "none"}))
    got = {r.epoch: r for r in readers.observations_json(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[2]["humidity"], got[2]["neighborhood"], got[2]["metric.temp"], got[2]["metric.windSpeed"], got[2]["metric.tempAvg"]) == (71.0, "Pier", 3.5, 4, None)
    assert got[1]["metric.tempAvg"] == 2.0 and got[1]["humidity"] is None
    assert readers.has_observations(readers.payloads(spark, str(tmp_path))).where("found").count() == 3
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.json").write_text(json.dumps({"error": "none"}))
    assert readers.observations_json(spark, str(tmp_path / "e")).count() == 0


def test_first_rows_stay_whatever_the_files_sizes(spark, tmp_path):
    head = "station,valid(UTC),tmpf,ptype,precip\n"
    (tmp_path / "a.csv").write_text(head + "JFK,2024-01-01 00:00,32,NP,0.1\n")
    (tmp_path / "b.csv").write_text(head + "".join(f"JFK,2024-01-01 {h:02}:{m:02},50,NP,0.2\n" for h in range(24) for m in range(60)))
    got = readers.asos_metric(readers.asos_csv(spark, str(tmp_path))).where("datetime = '2024-01-01'").collect()
    assert [r.temp_c for r in got] == [0.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 1.0), ("b", 1, 2.0), ("a", 1, 3.0)], "st string, t int, precip_rate double")
    p = sinks.by_station(df, str(tmp_path / "s"), "st", "t")
    assert spark.read.option("header", True).csv(p).count() == 3
    assert [r.t for r in spark.read.option("header", True).csv(sinks.combined(df, str(tmp_path / "c"), "st", "t")).collect()] == ["1", "2", "1"]
    assert sinks.export(df, str(tmp_path / "e"), "st", "t") == {}
    out = sinks.export(df, str(tmp_path / "e"), "st", "t", raw=df, everything=True)
    assert spark.read.json(out["raw"]).count() == 3
    assert spark.read.option("header", True).csv(out["precipitation"]).columns == ["st", "t", "precip_rate"]


def test_sinks_keep_instants(spark, tmp_path):
    rows = spark.range(1000).select("id", F.timestamp_micros(F.col("id") * 1_234_567_891).alias("at"), F.timestamp_micros(F.col("id") * 7_777_777).cast("timestamp_ntz").alias("local"), (F.col("id") % 3).cast("int").alias("st"))
    want = sorted(map(tuple, rows.collect()))
    for kind, path in (("csv", sinks.by_station(rows, str(tmp_path / "s"), "st", "at")), ("csv", sinks.combined(rows, str(tmp_path / "c"), "at")), ("json", str(tmp_path / "j"))):
        if kind == "json":
            sinks.json(rows, path)
        assert sorted(map(tuple, sinks.written(spark, path, rows.schema, kind).select(*rows.columns).collect())) == want
    out = sinks.export(rows, str(tmp_path / "e"), "st", "at", everything=True)
    assert sorted(map(tuple, sinks.written(spark, out["clean"], rows.schema).collect())) == want


def test_generators(spark):
    assert [round(r.t, 3) for r in generate.linspace(spark, 0, 2, 5).collect()] == [0, 0.5, 1, 1.5, 2]
    assert generate.noisy_projectile(spark, 20).count() == 20
    assert generate.signal_levels(spark, 3, 10).where("rsl IS NOT NULL").count() > 20


def stream(spark, tmp_path, batches):
    schema = "k string, t timestamp, v double"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, datetime(2024, 1, 1, h, m), v) for k, h, m, v in rows], schema).coalesce(1).write.json(str(tmp_path / "in" / f"{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def ran(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    src = stream(spark, tmp_path, [[("a", 0, 1, 1.0), ("a", 0, 1, 1.0), ("a", 0, 3, 2.0)], [("a", 0, 7, 4.0), ("a", 3, 0, 5.0)], [("a", 20, 0, 0.0)]])
    assert ran(series.deduped(src, ["k"], "t", "10 minutes"), "deduped").count() == 5
    got = ran(series.resampled(src, ["k"], "t", "5 minutes", {"s": ("sum", "v")}, "10 minutes"), "resampled").where("bin < '2024-01-01 01:00:00'").orderBy("bin").collect()
    assert [r.s for r in got] == [4.0, 4.0]
    got = ran(series.sessions(src, ["k"], "t", "2 hours", "10 minutes"), "sessions").orderBy("start").collect()
    assert [(r.n, r.end.minute) for r in got] == [(4, 7), (1, 0)]
    with series.rocksdb(spark):
        got = ran(series.rolling_deviation(src, "k", "t", "v", 2, "10 minutes"), "rolling").orderBy("t", "sigma").collect()
    # the watermark ends at 19:50, so the last row waits; ties stay
    assert [(r.v, r.sigma) for r in got] == [(1.0, 0.0), (1.0, 0.0), (2.0, 0.5), (4.0, 1.0), (5.0, 0.5)]


def test_rolling_takes_late_rows_at_their_place(spark, tmp_path):
    src = stream(spark, tmp_path, [[("a", 1, 0, 1.0), ("a", 1, 20, 5.0)], [("a", 1, 10, 3.0), ("b", 1, 20, 7.0)], [("b", 9, 0, 0.0)], [("b", 9, 1, 0.0)]])
    with series.rocksdb(spark):
        got = ran(series.rolling_deviation(src, "k", "t", "v", 2, "1 hour"), "rolling_late").orderBy("k", "t").collect()
    assert [(r.k, r.v, r.sigma) for r in got] == [("a", 1.0, 0.0), ("a", 3.0, 1.0), ("a", 5.0, 1.0), ("b", 7.0, 0.0)]


def test_rolling_keeps_microseconds_and_forgets_old_series(spark, tmp_path):
    """Rows within one millisecond keep their order; a series that goes on long after its state has gone starts anew."""
    src = stream(spark, tmp_path, [[("a", 1, 0, 1.0)], [("b", 5, 0, 0.0)], [("b", 9, 0, 0.0)], [("b", 10, 0, 0.0)], [("a", 15, 0, 9.0)], [("b", 23, 0, 0.0)]])
    micros = src.withColumn("t", F.when(F.col("k") == "a", F.col("t") + F.make_dt_interval(secs=F.lit(0.000007))).otherwise(F.col("t")))
    twice = micros.unionByName(micros.where("k = 'a'").select("k", (F.col("t") - F.make_dt_interval(secs=F.lit(0.000005))).alias("t"), (F.col("v") + 1).alias("v")))
    with series.rocksdb(spark):
        got = ran(series.rolling_deviation(twice.select("k", "t", "v"), "k", "t", "v", 2, "1 hour"), "rolling_micros").where("k = 'a'").orderBy("t").collect()
    assert [(r.t.hour, r.t.microsecond, r.v, r.sigma) for r in got] == [(1, 2, 2.0, 0.0), (1, 7, 1.0, 0.5), (15, 2, 10.0, 0.0), (15, 7, 9.0, 0.5)]


def test_polls_are_resumed_from_their_offsets(spark, tmp_path):
    """Each file is read once, over three runs of a query with one checkpoint; lines without payloads and files that aren't any are left alone."""
    landed, out = tmp_path / "landed", str(tmp_path / "out")
    landed.mkdir()

    def run():
        q = polling.polled(spark, str(landed), "station string, v double").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.station, r.v) for r in spark.read.schema("station string, v double").parquet(out).collect())

    (landed / "2024-01-01.json").write_text('{"observations": [{"station": "a", "v": 1}, {"station": "b", "v": 2}]}\n{"error": "none"}\n\n')
    (landed / "_SUCCESS").write_text("")
    assert run() == [("a", 1.0), ("b", 2.0)]
    assert run() == [("a", 1.0), ("b", 2.0)]
    (landed / "2024-01-02.json").write_text("\n".join(json.dumps({"observations": [{"station": "a", "v": i}]}) for i in range(3000)))
    assert len(run()) == 3002
    source = polling.PayloadStream(str(landed))
    old = polling.TASK_BYTES
    polling.TASK_BYTES = 10
    try:
        assert len(source.partitions({"file": ""}, source.latestOffset())) == 2 and source.partitions(source.latestOffset(), source.latestOffset()) == []
    finally:
        polling.TASK_BYTES = old
