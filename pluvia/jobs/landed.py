"""Queries over landed files: they write files of the driver's tables to a shared folder, and read them by the readers."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from pluvia.functions import expressions as x
from pluvia.jobs.catalog import events, ntz, query, r, table
from pluvia.operators import stations as st
from pluvia.operators.timeseries import slice_days
from pluvia.sources import archive, classic, netcdf, paths, planning, readers, sinks
from pluvia.sources.scratch import shared_folder as landing


_CODES = "CASE event_id % 6 WHEN 0 THEN 'NP' WHEN 1 THEN 'R+' WHEN 2 THEN 'S' WHEN 3 THEN 'P?' WHEN 4 THEN 'M' ELSE 'nan' END"
_TEXT = "CASE WHEN event_id % 10 = 3 THEN 'M' WHEN event_id % 10 = 4 THEN 'T' ELSE CAST(CAST(value AS INT) AS VARCHAR(20)) END"


def _airport(spark, d):
    """Two files of minutes: the later one repeats a third of the first one's (station, time) with other values."""
    path = landing(spark)
    e = events(spark, d).select(
        F.concat(F.lit("K"), F.col("user_id") % 40).alias("station"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("valid(UTC)"), "event_id", F.expr(_TEXT).alias("tmpf"), F.expr(_TEXT).alias("sknt"), F.expr(_CODES).alias("ptype"), F.expr(_TEXT).alias("precip")
    )
    later = e.where("event_id % 3 = 0").withColumns({"tmpf": F.lit("1"), "precip": F.lit("9")})
    for name, rows in (("a", e), ("b", later)):
        rows.drop("event_id").write.option("header", True).csv(f"{path}/{name}")
    return readers.asos_metric(readers.asos_csv(spark, f"{path}/*"))


_AIRPORT = f"""
c AS (SELECT 'K' || (user_id % 40) AS station_id, ts, event_id, {_TEXT.replace('CAST(value AS INT)', 'CAST(trunc(value) AS INT)')} AS n, {_CODES} AS ptype FROM events),
p AS (SELECT *, CASE WHEN n IN ('M', 'T') THEN NULL ELSE n::DOUBLE END AS v FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY station_id, ts ORDER BY event_id) AS nth FROM p),
m AS (SELECT station_id, ts, (v - 32) * 5 / 9 AS temp_c, v * 0.51444 AS wind_speed_ms, CASE WHEN ptype = 'nan' THEN NULL ELSE ptype END AS precip_type,
  CASE ptype WHEN 'NP' THEN 'dry' WHEN 'R+' THEN 'rain' WHEN 'S' THEN 'snow' WHEN 'P?' THEN 'precip' ELSE 'missing' END AS precip_category, v * 25.4 AS precip_mm FROM k WHERE nth = 1)"""


@query(f"WITH {_AIRPORT} SELECT station_id, ts AS datetime, round(temp_c, 4) AS temp_c, round(wind_speed_ms, 4) AS wind_speed_ms, precip_type, precip_category, round(precip_mm, 4) AS precip_mm FROM m")
def airport_csv_metric(spark, d):
    """Keep-first over files: of rows with equal (station, time), that of the first file; within it both are equal but for ties in event_id, which the table hasn't."""
    return _airport(spark, d).select("station_id", ntz("datetime").alias("datetime"), r("temp_c").alias("temp_c"), r("wind_speed_ms").alias("wind_speed_ms"), "precip_type", "precip_category", r("precip_mm").alias("precip_mm"))


@query(f"WITH {_AIRPORT} SELECT station_id, round(coalesce(sum(precip_mm), 0), 3) AS total, count(*) FILTER (precip_mm > 0) AS rainy, round(avg(temp_c), 4) AS mean_temp_c, round(avg(wind_speed_ms), 4) AS mean_wind_speed_ms FROM m GROUP BY 1")
def airport_totals(spark, d):
    got = st.summary(_airport(spark, d), "station_id", "precip_mm", "temp_c", "wind_speed_ms")
    return got.select("station_id", r("total", 3).alias("total"), "rainy", r("mean_temp_c").alias("mean_temp_c"), r("mean_wind_speed_ms").alias("mean_wind_speed_ms"))


@query(f"WITH {_AIRPORT} SELECT station_id, ts AS datetime, precip_type FROM m WHERE precip_type IN ('R+', 'S')")
def type_filter(spark, d):
    return st.of_types(_airport(spark, d), ["R+", "S"]).select("station_id", ntz("datetime").alias("datetime"), "precip_type")


@query(f"WITH {_AIRPORT} SELECT station_id, precip_category, count(*) AS n FROM m GROUP BY ALL")
def derived_category_counts(spark, d):
    bare = _airport(spark, d).drop("precip_category")
    return st.type_counts(st.with_category(bare), "station_id", "precip_category")


def _payloads(spark, d, key="observations"):
    """A payload a station and day, as a service sends it, of kinds that differ by station: some have fields that others haven't."""
    path = landing(spark)
    obs = F.struct(
        F.concat(F.lit("S"), F.col("user_id")).alias("stationID"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("obsTimeUtc"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("obsTimeLocal"), F.col("event_id").alias("epoch"),
        F.when(F.col("user_id") % 3 == 0, F.col("event_id") % 360).alias("winddir"), F.struct(F.col("value").alias("precipRate"), F.when(F.col("user_id") % 2 == 0, F.col("value") * 2).alias("windSpeed")).alias("metric"),
    )
    day = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("event_id", obs.alias("o")))).alias("all"))
    day.select(F.transform("all", lambda y: y["o"]).alias(key)).write.json(path)
    return path


@query("""SELECT 'S' || user_id AS station_id, event_id AS timestamp_unix, strftime(ts, '%Y-%m-%d %H:%M:%S')::TIMESTAMP AS time_utc, round(value, 6) AS precip_rate,
 CASE WHEN user_id % 3 = 0 THEN event_id % 360 END AS winddir, CASE WHEN user_id % 2 = 0 THEN round(value * 2, 6) END AS wind_speed, NULL::DOUBLE AS temp_avg FROM events""")
def station_json(spark, d):
    got = readers.station_times(readers.simple_names(readers.observations_json(spark, _payloads(spark, d), lines=True)))
    return got.select("station_id", "timestamp_unix", ntz("time_utc").alias("time_utc"), r("precip_rate", 6).alias("precip_rate"), "winddir", r("`metric.windSpeed`", 6).alias("wind_speed"), "temp_avg")


@query("SELECT 'S' || user_id AS station_id, event_id AS epoch, round(value, 6) AS rate FROM events")
def station_names_and_back(spark, d):
    raw = readers.observations_json(spark, _payloads(spark, d), lines=True)
    back = readers.original_names(readers.simple_names(raw))
    return back.select(F.col("stationID").alias("station_id"), "epoch", r("`metric.precipRate`", 6).alias("rate"))


@query("""SELECT 'S' || user_id AS station_id, event_id AS timestamp_unix FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events) WHERE n <= 2""")
def daily_first_n(spark, d):
    payloads = readers.payloads(spark, _payloads(spark, d, "summaries"), lines=True)
    return readers.simple_names(readers.observations(payloads.select("summaries"), first=2)).select("station_id", "timestamp_unix")


@query("SELECT 'S' || user_id AS station_id, event_id AS epoch FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-08 00:00:00'")
def hourly_between(spark, d):
    got = readers.hourly_between(readers.observations_json(spark, _payloads(spark, d), lines=True), "2024-01-05 06:00:00", "2024-01-08 00:00:00")
    return got.select(F.col("stationID").alias("station_id"), "epoch")


@query("SELECT count(DISTINCT (user_id, CAST(ts AS DATE))) AS n, count(DISTINCT (user_id, CAST(ts AS DATE))) AS found FROM events")
def payloads_with_observations(spark, d):
    return readers.has_observations(readers.payloads(spark, _payloads(spark, d), lines=True)).agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("found"))


@query("""WITH p AS (SELECT event_id, user_id, ts, 'hourly' AS product FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-03 12:00:00' AND TIMESTAMP '2024-01-10 12:00:00'
 UNION ALL SELECT event_id, user_id, ts, 'daily' FROM events WHERE event_type = 'view')
SELECT product, count(*) AS n, count(DISTINCT user_id) AS stations FROM p GROUP BY ROLLUP (product)""")
def product_bundle_totals(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts", "event_type")
    both = readers.product_bundle({"hourly": e.where("event_type = 'click'"), "daily": e.where("event_type = 'view'").drop("event_type")}, "2024-01-10 12:00:00")
    return st.bundle_totals(both, "product", "user_id")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS t, user_id % 4 AS g, sum(value) AS v FROM events GROUP BY ALL), t AS (SELECT DISTINCT t FROM h), g AS (SELECT unnest([0, 1, 2, 3]) AS g)
SELECT 'G' || g.g AS gauge, t.t - INTERVAL '15 minutes' AS ts, round(v, 4) AS rain_mm, CASE WHEN g.g = 0 THEN 'ok' END AS qc FROM t CROSS JOIN g LEFT JOIN h ON h.t = t.t AND h.g = g.g""")
def wide_gauges(spark, d):
    path = landing(spark)
    hours = events(spark, d).withColumn("g", F.col("user_id") % 4).groupBy(F.date_trunc("hour", "ts").alias("t")).pivot("g", [0, 1, 2, 3])
    wide = hours.agg(r(F.sum("value"), 6)).select(F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("Time_UTC"), F.col("0").alias("G0_mm"), F.lit("ok").alias("G0_QC"), *[F.col(str(i)).alias(f"G{i}") for i in (1, 2, 3)])
    wide.write.option("header", True).option("nullValue", "NA").csv(path)
    return readers.wide_gauges(spark, path, 900).select("gauge", ntz("ts").alias("ts"), r("rain_mm").alias("rain_mm"), "qc")


@query("SELECT s_suppkey AS link, round(s_suppkey % 30 + 10.5, 4) AS frequency_ghz, round((s_suppkey % 90 + 1) / 10.0::DOUBLE, 4) AS length_km FROM supplier")
def link_metadata_csv(spark, d):
    path = landing(spark)
    s = F.col("s_suppkey")
    table(spark, d, "supplier").select(s.alias("﻿name"), F.lit(0).alias("Unnamed: 0"), ((s % 30 + 10.5) * 1000).alias("MHz"), ((s % 90 + 1) * 100).alias("metres")).write.option("header", True).csv(path)
    got = readers.link_metadata(readers.metadata_csv(spark, path, "link"), "MHz", "metres", True, True)
    return got.select(F.col("link").cast("long").alias("link"), r("frequency_ghz").alias("frequency_ghz"), r("length_km").alias("length_km"))


@query("SELECT p_size::INT AS complexity, round(p_retailprice, 3) AS loss, p_name AS equation FROM part")
def equation_table(spark, d):
    path = landing(spark)
    table(spark, d, "part").select(F.col("p_size").cast("int").alias("Complexity"), F.col("p_retailprice").cast("double").alias("Loss"), F.col("p_name").alias("Equation")).write.option("header", True).csv(path)
    return readers.equation_table(spark, path).withColumn("loss", r("loss", 3))


@query("SELECT 'user=' || (user_id % 5) AS folder, 1::BIGINT AS files FROM events GROUP BY ALL")
def found_files(spark, d):
    path = landing(spark)
    events(spark, d).withColumn("user", F.col("user_id") % 5).select("user", "event_id").repartition(1, "user").write.partitionBy("user").csv(path)
    listed = readers.files(spark, path, "*.csv")
    return listed.where("length > 0").groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def _series(spark, d):
    return events(spark, d).select("event_id", (F.col("user_id") % 7).alias("station"), "ts", r("value", 6).alias("precip_rate"), F.col("event_type").alias("kind"))


_SERIES = "event_id long, ts timestamp_ntz, precip_rate double, kind string, station int"


@query("SELECT event_id, (user_id % 7)::INT AS station, ts, round(value, 4) AS precip_rate FROM events")
def written_by_station(spark, d):
    path = sinks.by_station(_series(spark, d), landing(spark), "station", "ts")
    return sinks.written(spark, path, _SERIES).select("event_id", "station", "ts", r("precip_rate").alias("precip_rate"))


@query("SELECT event_id, (user_id % 7)::INT AS station, ts, round(value, 4) AS precip_rate FROM events")
def written_combined(spark, d):
    rows = _series(spark, d)
    return sinks.written(spark, sinks.combined(rows, landing(spark), "ts", "event_id"), rows.schema).select("event_id", F.col("station").cast("int").alias("station"), "ts", r("precip_rate").alias("precip_rate"))


@query("SELECT event_id, (user_id % 7)::INT AS station, ts, round(value, 4) AS precip_rate FROM events")
def written_json(spark, d):
    path = landing(spark)
    sinks.json(_series(spark, d), path)
    return sinks.written(spark, path, _SERIES, "json").select("event_id", "station", "ts", r("precip_rate").alias("precip_rate"))


@query("""WITH x AS (SELECT 'clean' AS product, (user_id % 7)::INT AS station, count(*) AS n, min(ts) AS first, max(ts) AS last, sum(epoch_us(ts) % 1000000)::BIGINT AS micros FROM events GROUP BY ALL) SELECT * FROM x
UNION ALL SELECT 'precipitation', station, n, first, last, micros FROM x UNION ALL SELECT 'raw', station, n, first, last, micros FROM x UNION ALL SELECT 'profile', NULL, 5, NULL, NULL, NULL""")
def exported(spark, d):
    """The sum of all rows' microseconds tells whether each instant is whole."""
    rows = _series(spark, d)
    paths = sinks.export(rows, landing(spark), "station", "ts", raw=rows, everything=True)
    there = {"clean": sinks.written(spark, paths["clean"], rows.schema), "raw": sinks.written(spark, paths["raw"], rows.schema, "json")}
    there["precipitation"] = sinks.written(spark, paths["precipitation"], "station long, ts timestamp_ntz, precip_rate double")
    parts = [rows.select(F.lit(k).alias("product"), F.col("station").cast("int").alias("station"), "ts") for k, rows in there.items()]
    profile = spark.read.option("header", True).csv(paths["profile"])
    parts.append(profile.select(F.lit("profile").alias("product"), F.lit(None).cast("int").alias("station"), F.lit(None).cast("timestamp_ntz").alias("ts")))
    micros = F.sum(F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000000))).alias("micros")
    return readers.union_all(*parts).groupBy("product", "station").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), micros)


_RANGES = "g AS (SELECT 'U' || user_id AS station, date_trunc('day', min(ts)) - INTERVAL '1 day' * (user_id % 70) AS s, date_trunc('day', max(ts)) AS e FROM events GROUP BY user_id)"


def _ranges(spark, d):
    got = events(spark, d).groupBy("user_id").agg(F.date_trunc("day", F.min("ts")).alias("s"), F.date_trunc("day", F.max("ts")).alias("end"))
    return got.select(F.concat(F.lit("U"), "user_id").alias("station"), (F.col("s") - F.make_dt_interval((F.col("user_id") % 70).cast("int"))).alias("start"), "end")


@query(f"""WITH {_RANGES}, m AS (SELECT station, unnest(generate_series(date_trunc('month', s), e, INTERVAL '1 month')) AS f, e FROM g)
SELECT station, strftime(f, '%Y-%m') AS month, f::DATE::VARCHAR AS first, least(last_day(f::DATE), e::DATE)::VARCHAR AS last FROM m WHERE f::DATE < e::DATE""")
def month_chunk_plan(spark, d):
    return planning.month_plan(_ranges(spark, d)).select("station", "month", F.col("first").cast("string"), F.col("last").cast("string"))


@query(f"""WITH {_RANGES}, c AS (SELECT station, s::DATE AS s, e::DATE AS e, CASE WHEN date_diff('day', s::DATE, e::DATE) <= 31 THEN [s::DATE::TIMESTAMP] ELSE generate_series(s, greatest(s, e), INTERVAL '32 days') END AS l FROM g),
u AS (SELECT station, s, e, unnest(l)::DATE AS f FROM c)
SELECT station, strftime(f, '%Y%m%d') AS first_stamp, strftime(least(f + 31, e), '%Y%m%d') AS last_stamp FROM u WHERE date_diff('day', s, e) <= 31 OR f < e""")
def day_chunk_plan(spark, d):
    return planning.day_plan(_ranges(spark, d)).select("station", "first_stamp", "last_stamp")


@query(f"""WITH {_RANGES}, c AS (SELECT station, s, least(e, TIMESTAMP '2024-01-20') AS e FROM g), v AS (SELECT station, CASE WHEN s >= e THEN e - INTERVAL '7 days' ELSE s END AS s, e FROM c)
SELECT station, s AS start, e AS "end", date_diff('day', s, e) > 31 AS long FROM v""")
def valid_ranges(spark, d):
    return planning.valid_ranges(_ranges(spark, d), "2024-01-20").select("station", ntz("start").alias("start"), ntz("end").alias("end"), "long")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN make_timestamp(epoch_us(ts) // 1000000 * 1000000) ELSE date_trunc('second', ts) END AS at,
 'wu_U' || user_id || '_' || strftime(ts, '%Y%m%d') || '_' || strftime(ts + INTERVAL '6 days', '%Y%m%d') || '.csv' AS file, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.no.such'), '0') AS missing FROM events""")
def parsed_times_and_names(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).when(F.col("event_id") % 4 == 2, F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("string")).otherwise("soon")
    day = F.to_date("ts")
    name = x.file_name(F.lit("wu"), F.concat(F.lit("U"), "user_id"), day, F.date_add(day, 6))
    return events(spark, d).select("event_id", ntz(x.parse_time(text)).alias("at"), name.alias("file"), x.nested(F.col("props"), "k", "none").alias("k"), x.nested(F.col("props"), "no.such", 0).alias("missing"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04'")
def rapid_day_from_json(spark, d):
    path = landing(spark)
    sinks.json(events(spark, d).select("event_id", "ts"), path)
    return slice_days(sinks.written(spark, path, "event_id long, ts timestamp_ntz", "json"), "ts", "2024-01-02", "2024-01-03")


def _link_files(spark, d):
    """A NetCDF file a day of events: hourly largest value of 20 links, a fill value where an hour has none. Tasks write them."""
    path = landing(spark)
    hours = events(spark, d).groupBy(F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("h"), (F.col("user_id") % 20).cast("int").alias("link")).agg(F.max("value").alias("v"))

    def write(key, rows):
        import numpy as np
        import pyarrow as pa

        day = key[0].as_py()
        level = np.full((24, 20), -999.0)
        level[rows.column("h").to_numpy(), rows.column("link").to_numpy()] = rows.column("v").to_numpy()
        raw = classic.encoded({"time": None, "sublink": 20}, {"time": (("time",), np.arange(24, dtype=np.int32), {"units": f"hours since {day} 00:00:00"}), "rsl": (("time", "sublink"), level, {"_FillValue": -999.0, "units": "dBm"})}, {"day": day})
        paths.put(f"{path}/{day}.nc", raw)
        return pa.table({"n": pa.array([len(raw)], pa.int64())})

    hours.groupBy("day").applyInArrow(write, "n long").collect()  # a row a day
    return path


@contextmanager
def _pushdown(spark):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    yield
    spark.conf.set(name, before)


_HOURS = "h AS (SELECT date_trunc('hour', ts) AS t, (user_id % 20)::INT AS sublink, max(value) AS v FROM events GROUP BY ALL)"


@query(f"""WITH {_HOURS}, days AS (SELECT DISTINCT date_trunc('day', t) AS day FROM h), g AS (SELECT day + INTERVAL '1 hour' * i AS t, s::INT AS sublink FROM days, range(24) r(i), range(20) q(s))
SELECT g.sublink, g.t AS ts, round(v, 4) AS rsl FROM g LEFT JOIN h ON h.t = g.t AND h.sublink = g.sublink""")
def netcdf_links(spark, d):
    got = netcdf.load(spark, _link_files(spark, d), variables="rsl", steps="6")
    return got.select("sublink", ntz("ts").alias("ts"), r("rsl").alias("rsl"))


@query(f"WITH {_HOURS} SELECT sublink, t AS ts, round(v, 4) AS rsl FROM h WHERE sublink = 7 AND t >= TIMESTAMP '2024-01-03 05:00:00' AND t < TIMESTAMP '2024-01-06'")
def netcdf_links_pushed_down(spark, d):
    with _pushdown(spark):  # cached, so planned, while filters are pushed
        got = netcdf.load(spark, _link_files(spark, d), variables="rsl", steps="6")
        return got.where("sublink = 7 AND ts >= TIMESTAMP '2024-01-03 05:00:00' AND ts < TIMESTAMP '2024-01-06' AND rsl IS NOT NULL").select("sublink", ntz("ts").alias("ts"), r("rsl").alias("rsl")).cache()


@query("SELECT DISTINCT 'rsl' AS object, 'units' AS key, 'dBm' AS value, count(DISTINCT CAST(ts AS DATE)) AS files FROM events")
def netcdf_attributes(spark, d):
    got = netcdf.load(spark, _link_files(spark, d), attributes="true")
    return got.where("object = 'rsl' AND key = 'units'").groupBy("object", "key", "value").agg(F.count(F.lit(1)).alias("files"))


def _archives(spark, d):
    """A zip file a fifth of the stations, with a CSV file a day in it. Tasks write them."""
    path = landing(spark)
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    archive.packed(events(spark, d).select(
        F.concat(F.lit(f"{path}/stations-"), F.coalesce((F.col("user_id") % 5).cast("string"), F.lit("None")), F.lit(".zip")).alias("archive"), F.concat(F.lit("series/"), F.coalesce(F.substring(at, 1, 10), F.lit("None")), F.lit(".csv")).alias("member"),
        F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("None")) for c in (F.col("event_id"), F.col("user_id"), at, F.col("value"))]).alias("text"),
    ), "event_id,user_id,ts,value", {"README.txt": "no data"})
    return path


@query("SELECT event_id, user_id, ts, round(value, 4) AS value, 'series/' || strftime(ts, '%Y-%m-%d') || '.csv' AS member FROM events")
def archived_series(spark, d):
    got = archive.csv(spark, _archives(spark, d), "event_id LONG, user_id LONG, ts TIMESTAMP_NTZ, value DOUBLE", "series/*.csv")
    return got.select("event_id", "user_id", "ts", r("value").alias("value"), "member")


@query("""SELECT 'stations-' || (user_id % 5) || '.zip' AS archive, count(DISTINCT CAST(ts AS DATE)) + 1 AS members FROM events GROUP BY ALL""")
def archive_listing(spark, d):
    got = archive.members(spark, _archives(spark, d))
    return got.groupBy(F.element_at(F.split("archive", "/"), -1).alias("archive")).agg(F.count(F.lit(1)).alias("members"))
