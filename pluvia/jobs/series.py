"""Queries over series: resampling, totals, fills, gaps, runs."""

from pyspark.sql import functions as F

from pluvia.jobs.catalog import E, events, ntz, query, r
from pluvia.operators import timeseries as ts

TIE = ("event_id",)
RULES = {"total": ("sum", "v"), "mean": ("mean", "v"), "largest": ("max", "v"), "kind": ("mode", "event_type")}


def _binned(step: str) -> str:
    return f"""
b AS (SELECT user_id, time_bucket(INTERVAL '{step}', ts) AS bin, v, event_type FROM e),
a AS (SELECT user_id, bin, coalesce(sum(v), 0) AS total, avg(v) AS mean, max(v) AS largest FROM b GROUP BY ALL),
k AS (SELECT user_id, bin, event_type, row_number() OVER (PARTITION BY user_id, bin ORDER BY count(*) DESC, event_type) AS nth FROM b WHERE event_type IS NOT NULL GROUP BY user_id, bin, event_type),
p AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), INTERVAL '{step}')) AS bin FROM a GROUP BY user_id),
s AS (SELECT p.user_id, p.bin, coalesce(a.total, 0) AS total, a.mean, a.largest, k.event_type AS kind FROM p LEFT JOIN a USING (user_id, bin) LEFT JOIN k ON k.user_id = p.user_id AND k.bin = p.bin AND k.nth = 1)"""


@query(f"""WITH {E}, {_binned('1 hour')}
SELECT user_id, bin, round(total, 4) AS total, round(mean, 6) AS mean, round(largest, 4) AS largest, kind,
  round(sum(total) OVER (PARTITION BY user_id ORDER BY bin ROWS UNBOUNDED PRECEDING), 4) AS accumulated FROM s""")
def resample_hourly_running_total(spark, d):
    got = ts.resample(events(spark, d), ["user_id"], "ts", 3600, RULES, spine=False)
    got = ts.running_total(got, ["user_id"], "bin", "total", "accumulated", chunk=7 * 86400)
    got = ts.spined(got, ["user_id"], 3600, {"total": 0.0}, ("accumulated",))
    return got.select("user_id", ntz("bin").alias("bin"), r("total").alias("total"), r("mean", 6).alias("mean"), r("largest").alias("largest"), "kind", r("accumulated").alias("accumulated"))


@query(f"""WITH {E}, {_binned('30 minutes')}
SELECT user_id, bin, round(total, 4) AS total, round(mean, 6) AS mean, round(largest, 4) AS largest, kind FROM s""")
def resample_30min_rules(spark, d):
    got = ts.resample(events(spark, d), ["user_id"], "ts", 1800, RULES)
    return got.select("user_id", ntz("bin").alias("bin"), r("total").alias("total"), r("mean", 6).alias("mean"), r("largest").alias("largest"), "kind")


@query("""
WITH o AS (SELECT user_id, date_trunc('day', min(ts)) AS origin FROM events GROUP BY 1),
b AS (SELECT e.user_id, time_bucket(INTERVAL '7 hours', e.ts, o.origin) AS bin, value FROM events e JOIN o USING (user_id))
SELECT user_id, bin, round(min(value), 4) AS least, round(avg(value), 6) AS mean, count(*) AS n FROM b GROUP BY ALL""")
def resample_7h_from_first_midnight(spark, d):
    got = ts.resample(events(spark, d), ["user_id"], "ts", 7 * 3600, {"least": ("min", "value"), "mean": ("mean", "value"), "n": ("count", "value")}, spine=False)
    return got.select("user_id", ntz("bin").alias("bin"), r("least").alias("least"), r("mean", 6).alias("mean"), "n")


@query(f"""WITH {E}, {_binned('1 hour')}
SELECT b.user_id, round(b.total, 2) AS before, round(b.total, 2) AS after FROM (SELECT user_id, coalesce(sum(v), 0) AS total FROM e GROUP BY 1) b""")
def resample_conservation(spark, d):
    e = events(spark, d)
    before = e.groupBy("user_id").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("before"))
    after = ts.resample(e, ["user_id"], "ts", 3600, {"total": ("sum", "v")}).groupBy("user_id").agg(F.sum("total").alias("after"))
    return before.join(after, "user_id").select("user_id", r("before", 2).alias("before"), r("after", 2).alias("after"))


def _total(expr: str, out: str = "s") -> str:
    return f"WITH {E}, t AS (SELECT *, sum({expr}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT event_id, user_id, round({out}, 4) AS total FROM t"


def _running(spark, d, nulls):
    e = events(spark, d).withColumn("x", F.col("v") - 40 if nulls == "clip" else F.col("v"))
    return ts.running_total(e, ["user_id"], "ts", "x", nulls=nulls, tie=TIE).select("event_id", "user_id", r("total").alias("total"))


@query(_total("coalesce(v, 0)"))
def running_total(spark, d):
    return _running(spark, d, "zero")


@query(_total("coalesce(v, 0)", "CASE WHEN v IS NOT NULL THEN s END"))
def running_total_null_stays(spark, d):
    return _running(spark, d, "skip")


@query(_total("greatest(coalesce(v - 40, 0), 0)"))
def running_total_clipped(spark, d):
    return _running(spark, d, "clip")


@query(f"""WITH {E}
SELECT event_id, round(coalesce(last_value(v IGNORE NULLS) OVER b, first_value(v IGNORE NULLS) OVER a), 4) AS filled FROM e
WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fill_forward_backward(spark, d):
    return ts.fill(events(spark, d), ["user_id"], "ts", "v", "forward", tie=TIE).select("event_id", r("filled").alias("filled"))


@query(f"""WITH {E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e),
p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn, last_value(v IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER a AS qn, first_value(v IGNORE NULLS) OVER a AS qv FROM n
  WINDOW b AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN pn IS NULL THEN NULL WHEN qn IS NULL OR qn = pn THEN pv ELSE pv + (qv - pv) / (qn - pn) * (n - pn) END, 4) AS filled FROM p""")
def fill_linear(spark, d):
    return ts.fill(events(spark, d), ["user_id"], "ts", "v", "linear", tie=TIE).select("event_id", r("filled").alias("filled"))


@query(f"WITH {E} SELECT event_id, round(coalesce(v, 0), 4) AS filled FROM e")
def fill_zero(spark, d):
    return ts.fill(events(spark, d), ["user_id"], "ts", "v", "zero").select("event_id", r("filled").alias("filled"))


@query("""WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_ts FROM events)
SELECT event_id, user_id, previous_ts, ts, round(epoch(ts) - epoch(previous_ts), 3) AS gap_s FROM l WHERE epoch(ts) - epoch(previous_ts) > 7200""")
def gap_detect(spark, d):
    return ts.gaps(events(spark, d), ["user_id"], "ts", 7200, TIE).select("event_id", "user_id", "previous_ts", "ts", r("gap_s", 3).alias("gap_s"))


def _runs(change: str) -> str:
    return f"""WITH k AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind FROM events),
l AS (SELECT *, lag(kind) OVER w AS p, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, (sum(CASE WHEN n = 1 OR {change} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM l)
SELECT user_id, run, any_value(kind) AS kind, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM c GROUP BY user_id, run"""


def _run_length(spark, d, each_null):
    e = events(spark, d).withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    return ts.runs(e, ["user_id"], "ts", "kind", TIE, each_null)


@query(_runs("kind IS DISTINCT FROM p OR kind IS NULL"))
def run_length_each_null(spark, d):
    return _run_length(spark, d, True)


@query(_runs("kind IS DISTINCT FROM p"))
def run_length_equal_nulls(spark, d):
    return _run_length(spark, d, False)


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, round(max_by(value, (ts, event_id)), 4) AS value FROM events GROUP BY user_id")
def latest_per_station(spark, d):
    return ts.latest(events(spark, d), ["user_id"], "ts", "event_id").select("user_id", "event_id", "ts", r("value").alias("value"))


@query("""SELECT user_id, event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def dedupe_first(spark, d):
    return ts.dedupe_first(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")


@query("""WITH l AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS s FROM events)
SELECT user_id, round(quantile_cont(s, 0.5), 3) AS resolution_s FROM l GROUP BY user_id""")
def time_resolution(spark, d):
    return ts.resolution(events(spark, d), ["user_id"], "ts", "event_id").select("user_id", r("resolution_s", 3).alias("resolution_s"))


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= floor(0.7::DOUBLE * count(*) OVER (PARTITION BY user_id)) AS train FROM events""")
def temporal_split(spark, d):
    return ts.temporal_split(events(spark, d), ["user_id"], "ts", 0.7, TIE).select("event_id", "user_id", "train")


@query("""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 32 AS block FROM events)
SELECT user_id, block, min(ts) AS start, round(list_sum(list(value ORDER BY ts, event_id)), 4) AS total, arg_min(value, (ts, event_id)) AS head FROM n GROUP BY user_id, block HAVING count(*) = 32""")
def training_blocks(spark, d):
    got = ts.blocks(events(spark, d), ["user_id"], "ts", ["value"], 32, TIE)
    total = F.aggregate("value", F.lit(0.0), lambda a, x: a + x)
    return got.select("user_id", "block", "start", r(total).alias("total"), F.element_at("value", 1).alias("head"))


@query("""WITH t AS (SELECT *, epoch_us(ts) / 3.6e9 AS h FROM events),
w AS (SELECT event_id, coalesce(lead(value) OVER o, value) - coalesce(lag(value) OVER o, value) AS dv, coalesce(lead(h) OVER o, h) - coalesce(lag(h) OVER o, h) AS dh FROM t WINDOW o AS (PARTITION BY user_id ORDER BY h, event_id))
SELECT event_id, round(CASE WHEN dh <> 0 THEN dv / dh END, 3) AS d_value FROM w""")
def central_derivative(spark, d):
    e = events(spark, d).withColumn("h", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    return ts.derivative(e, ["user_id"], "h", ["value"], TIE).select("event_id", r("d_value", 3).alias("d_value"))


@query("""SELECT event_id, ts, round(value, 4) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'""")
def slice_whole_days(spark, d):
    return ts.slice_days(events(spark, d), "ts", "2024-01-05", "2024-01-10").select("event_id", "ts", r("value").alias("value"))


@query("""SELECT event_id, ts, round(value, 4) AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'""")
def between_instants(spark, d):
    return ts.between_instants(events(spark, d), "ts", "2024-01-05 00:00:00", "2024-01-10 00:00:00").select("event_id", "ts", r("value").alias("value"))


@query("""WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(sin(radians(value * 3.6))) AS y, avg(cos(radians(value * 3.6))) AS x FROM events GROUP BY ALL),
a AS (SELECT *, degrees(atan2(y, x)) AS d FROM m WHERE abs(x) + abs(y) > 1e-6) SELECT user_id, day::VARCHAR AS day, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 3) AS direction FROM a""")
def mean_direction(spark, d):
    e = events(spark, d).withColumn("deg", F.col("value") * 3.6)
    x, y = F.avg(F.cos(F.radians("deg"))), F.avg(F.sin(F.radians("deg")))
    got = e.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(ts.mean_direction(F.col("deg")).alias("direction"), (F.abs(x) + F.abs(y)).alias("size"))
    return got.where("size > 1e-6").select("user_id", "day", r("direction", 3).alias("direction"))


@query("""WITH l AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS s FROM events)
SELECT user_id, round(sum(value * least(coalesce(s, 0), 3600) / 3600), 3) AS amount FROM l GROUP BY user_id""")
def time_weighted_total(spark, d):
    return ts.integrate_rate(events(spark, d), ["user_id"], "ts", "value", tie=TIE).groupBy("user_id").agg(r(F.sum("amount"), 3).alias("amount"))


@query("""SELECT 'value' AS value, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events
UNION ALL SELECT 'user_id', round(avg(user_id), 6), round(stddev_pop(user_id), 6) FROM events""")
def normalization_stats(spark, d):
    return ts.normalization(events(spark, d), ["value", "user_id"]).select("value", r("mean", 6).alias("mean"), r("deviation", 6).alias("deviation"))
