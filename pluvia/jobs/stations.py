"""Queries over stations: counts, rankings, days, profiles, distributions."""

from pyspark.sql import functions as F

from pluvia.jobs.catalog import E, events, query, r, table
from pluvia.operators import stations as st
from pluvia.operators import timeseries as ts

_COUNTS = "c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL AND event_type NOT IN ('', 'nan', 'None') GROUP BY ALL)"


@query(f"WITH {_COUNTS} SELECT * FROM c")
def type_counts(spark, d):
    return st.type_counts(events(spark, d), "user_id", "event_type")


@query(f"WITH {_COUNTS} SELECT user_id, event_type, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY user_id), 1) AS share FROM c")
def type_shares(spark, d):
    return st.type_shares(st.type_counts(events(spark, d), "user_id", "event_type"), "user_id", "event_type")


@query("""SELECT user_id % 3 AS station, event_type, count(*) AS n FROM events GROUP BY ALL""".replace("SELECT", "WITH c AS (SELECT", 1) + """)
SELECT event_type, coalesce(avg(n) FILTER (station = 0), 0) AS "0", coalesce(avg(n) FILTER (station = 1), 0) AS "1", coalesce(avg(n) FILTER (station = 2), 0) AS "2" FROM c GROUP BY event_type""")
def type_pivot(spark, d):
    e = events(spark, d).withColumn("station", F.col("user_id") % 3)
    return st.type_table(st.type_counts(e, "station", "event_type"), "station", "event_type", [0, 1, 2])


@query(f"WITH {E} SELECT user_id, round(coalesce(sum(v), 0), 3) AS total, count(*) FILTER (v > 0) AS rainy, round(avg(value), 4) AS mean_value FROM e GROUP BY user_id")
def station_summary(spark, d):
    return st.summary(events(spark, d), "user_id", "v", "value").select("user_id", r("total", 3).alias("total"), "rainy", r("mean_value").alias("mean_value"))


_RANK = f"""WITH {E}, y AS (SELECT user_id, CAST(ts AS DATE) AS day, coalesce(sum(v), 0) AS s, count(*) FILTER (v > 0) AS k, max(v) AS m, sum(v) FILTER (v > 0) AS w FROM e GROUP BY ALL),
k AS (SELECT user_id, sum(s) AS total, sum(k)::BIGINT AS wet_rows, max(m) AS largest, coalesce(sum(w) / nullif(sum(k), 0), 0) AS wet_mean, count(*) FILTER (s > 0) AS wet_days FROM y GROUP BY 1)"""


def _ranked(spark, d):
    return st.rank_stats(events(spark, d), "user_id", "ts", "v")


def _rounded(df):
    return df.select("user_id", r("total", 3).alias("total"), "wet_rows", r("largest").alias("largest"), F.col("wet_mean").cast("float").alias("wet_mean"), "wet_days")


_PICK = "SELECT user_id, round(total, 3) AS total, wet_rows, round(largest, 4) AS largest, wet_mean::FLOAT AS wet_mean, wet_days FROM k"


@query(f"{_RANK} {_PICK}")
def station_rank_stats(spark, d):
    return _rounded(_ranked(spark, d))


@query(f"{_RANK} {_PICK} ORDER BY k.total DESC, user_id LIMIT 5")
def station_top5(spark, d):
    return _rounded(st.top(_ranked(spark, d), "total", "user_id", 5))


@query(f"{_RANK} {_PICK} ORDER BY k.total, user_id LIMIT 5")
def station_bottom5(spark, d):
    return _rounded(st.top(_ranked(spark, d), "total", "user_id", 5, largest=False))


@query(_RANK + """ SELECT round(avg(total), 3) AS mean, round(quantile_cont(total, 0.5), 3) AS median, round(min(total), 3) AS least, round(max(total), 3) AS largest, round(stddev_samp(total), 3) AS deviation,
  arg_min(user_id, (total, user_id)) AS least_at, arg_min(user_id, (-total, user_id)) AS largest_at FROM k""")
def across_stations(spark, d):
    got = st.across(_ranked(spark, d), "user_id", "total")
    return got.select(*[r(c, 3).alias(c) for c in ("mean", "median", "least", "largest", "deviation")], "least_at", "largest_at")


_DAYS = f"WITH {E}, y AS (SELECT user_id, CAST(ts AS DATE) AS day, coalesce(sum(v), 0) AS total FROM e GROUP BY ALL)"


@query(_DAYS + " SELECT user_id, day::VARCHAR AS day, round(total, 4) AS total FROM y")
def daily_total(spark, d):
    return st.daily(events(spark, d), ["user_id"], "ts", "v").select("user_id", F.col("day").cast("string"), r("total").alias("total"))


@query(_DAYS + " SELECT user_id, arg_min(day, (-total, day))::VARCHAR AS day, round(max(total), 4) AS total FROM y GROUP BY user_id")
def wettest_day(spark, d):
    return st.wettest_day(st.daily(events(spark, d), ["user_id"], "ts", "v"), ["user_id"]).select("user_id", F.col("day").cast("string"), r("total").alias("total"))


@query(f"WITH {E}, y AS (SELECT CAST(ts AS DATE) AS day, coalesce(sum(v), 0) AS total FROM e GROUP BY ALL) SELECT day::VARCHAR AS day, round(total, 3) AS total FROM y ORDER BY y.total DESC, y.day LIMIT 5")
def top5_days(spark, d):
    return st.top(st.daily(events(spark, d), [], "ts", "v"), "total", "day", 5).select(F.col("day").cast("string"), r("total", 3).alias("total"))


@query(_RANK + """, t AS (SELECT user_id FROM k ORDER BY total DESC, user_id LIMIT 10)
SELECT e.user_id, e.event_id, round(CASE WHEN v IS NOT NULL THEN sum(coalesce(v, 0)) OVER (PARTITION BY e.user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END, 3) AS total FROM e JOIN t USING (user_id)""")
def top10_cumulative(spark, d):
    e = events(spark, d)
    chosen = F.broadcast(st.top(st.rank_stats(e, "user_id", "ts", "v"), "total", "user_id", 10).select("user_id"))  # ten rows
    return ts.running_total(e.join(chosen, "user_id", "left_semi"), ["user_id"], "ts", "v", nulls="skip", tie=("event_id",)).select("user_id", "event_id", r("total", 3).alias("total"))


@query("""WITH l AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 > 7200 AS g FROM events),
a AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(value) AS n, count(*) FILTER (g) AS gaps FROM l GROUP BY 1),
b AS (SELECT *, ((epoch_us(last) - epoch_us(first)) // 86400000000)::BIGINT AS days FROM a)
SELECT user_id, first, last, n, gaps, days, round(CASE WHEN days <> 0 THEN n * 100.0::DOUBLE / (days * 24) END, 3) AS completeness FROM b""")
def completeness(spark, d):
    return st.completeness(events(spark, d), "user_id", "ts", "value").withColumn("completeness", r("completeness", 3))


@query("""WITH c AS (SELECT count(*) AS n, count(c_custkey) AS a, count(c_name) AS b, count(c_nationkey) AS c, count(c_acctbal) AS e, count(c_mktsegment) AS f FROM customer),
u AS (SELECT n, unnest([{'k': 'c_custkey', 't': 'bigint', 'v': a}, {'k': 'c_name', 't': 'string', 'v': b}, {'k': 'c_nationkey', 't': 'int', 'v': c}, {'k': 'c_acctbal', 't': 'double', 'v': e}, {'k': 'c_mktsegment', 't': 'string', 'v': f}]) AS x FROM c)
SELECT x.k AS "column", 'Unknown' AS description, 'Unknown' AS units, x.t AS data_type, x.v > 0 AS has_data, x.v AS non_null_count, n - x.v AS null_count FROM u""")
def profile_columns(spark, d):
    return st.profile(table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("int"), "c_acctbal", "c_mktsegment"))


@query(f"""WITH {E} SELECT user_id, count(v) AS n, count(*) FILTER (v > 50) AS wet, round(100.0::DOUBLE * count(*) FILTER (v > 50) / nullif(count(v), 0), 3) AS wet_percent,
 round(min(v - 50), 4) AS least, round(max(v - 50), 4) AS largest, round(coalesce(sum(v - 50), 0), 3) AS total, round(coalesce(avg(v - 50) FILTER (v > 50), 0), 4) AS wet_mean FROM e GROUP BY user_id""")
def rain_stats(spark, d):
    got = st.rain_stats(events(spark, d).withColumn("x", F.col("v") - 50), ["user_id"], "x")
    return got.select("user_id", "n", "wet", r("wet_percent", 3).alias("wet_percent"), r("least").alias("least"), r("largest").alias("largest"), r("total", 3).alias("total"), r("wet_mean").alias("wet_mean"))


@query("""SELECT round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS deviation, round(avg((value > 0.1)::INT), 6) AS wet_part, round(avg((value = 0)::INT), 6) AS dry_part,
 round(min(value), 4) AS location, round(avg(value) - min(value), 4) AS scale FROM events""")
def rain_distribution(spark, d):
    got = st.rain_distribution(events(spark, d), "value")
    return got.select(r("mean").alias("mean"), r("deviation").alias("deviation"), r("wet_part", 6).alias("wet_part"), r("dry_part", 6).alias("dry_part"), r("location").alias("location"), r("scale").alias("scale"))


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS total FROM lineitem),
b AS (SELECT least(30, floor((l_extendedprice - lo) / (hi - lo) * 30) + 1)::INT AS bin, lo, hi, total FROM lineitem, s)
SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 30), 3) AS start, count(*) AS n, round(count(*) / (total * ((hi - lo) / 30)), 9) AS density FROM b GROUP BY bin, lo, hi, total""")
def histogram_fixed(spark, d):
    return st.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30).select("bin", r("start", 3).alias("start"), "n", r("density", 9).alias("density"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark, d):
    return st.value_counts(table(spark, d, "lineitem"), "l_returnflag")


@query("SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT event_type) AS n_event_type, count(*) AS points, min(ts) AS first, max(ts) AS last, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 86400, 4) AS days FROM events")
def dataset_coverage(spark, d):
    return st.coverage(events(spark, d), ["user_id", "event_type"], "ts").withColumn("days", r("days"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 10)")
def first_10_stations(spark, d):
    return st.first_stations(events(spark, d), "user_id", 10).select("event_id", "user_id")


@query("""WITH k AS (SELECT coalesce(max(n), 0) <= 1 AS u FROM (SELECT count(*) AS n FROM events GROUP BY event_id)), g AS (SELECT bool_and(value BETWEEN 0 AND 100) AS v FROM events),
c AS (SELECT * FROM (VALUES ('has event_id', true), ('type of event_id', true), ('has ts', true), ('type of ts', true), ('has altitude', false), ('type of altitude', false), ('column order', true)) t("check", passed)
 UNION ALL SELECT 'unique key', u FROM k UNION ALL SELECT 'range of value', v FROM g)
SELECT * FROM c UNION ALL SELECT 'all', bool_and(passed) FROM c""")
def format_compliance(spark, d):
    from pyspark.sql import types as T

    return st.compliance(table(spark, d, "events"), {"event_id": T.LongType, "ts": T.TimestampNTZType, "altitude": T.DoubleType}, ["event_id"], {"value": (0, 100)})
