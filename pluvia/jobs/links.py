"""Queries over signal levels: outliers, attenuation, baselines, rain."""

from pyspark.sql import functions as F

from pluvia.functions import expressions as x
from pluvia.jobs.catalog import E, events, ntz, query, r
from pluvia.operators import links, sketches

TIE = ("event_id",)
W = "PARTITION BY user_id ORDER BY ts, event_id"


@query("""WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN s.s <> 0 AND abs(value - s.m) / s.s > 2 THEN NULL ELSE value END, 4) AS clean FROM events JOIN s USING (user_id)""")
def zscore_mask(spark, d):
    return links.mask_outliers(events(spark, d), ["user_id"], "value", 2.0).select("event_id", r("clean").alias("clean"))


def _attenuation(stat: str) -> str:
    return f"""WITH {E}, s AS (SELECT user_id, {stat} AS b FROM e GROUP BY 1)
SELECT event_id, round(b, 4) AS baseline, round(CASE WHEN b - v < 0 THEN 0 ELSE b - v END, 4) AS attenuation FROM e JOIN s USING (user_id)"""


def _att(spark, d, method):
    return links.attenuation(events(spark, d), ["user_id"], "v", method).select("event_id", r("baseline").alias("baseline"), r("attenuation").alias("attenuation"))


@query(_attenuation("max(v)"))
def attenuation_dynamic(spark, d):
    return _att(spark, d, "dynamic")


@query(_attenuation("quantile_cont(v, 0.95)"))
def attenuation_quantile(spark, d):
    return _att(spark, d, "quantile")


@query(_attenuation("avg(v)"))
def attenuation_mean(spark, d):
    return _att(spark, d, "mean")


@query(f"""WITH {E}, s AS (SELECT user_id, max(v) AS b FROM e GROUP BY 1)
SELECT event_id, round(coalesce((CASE WHEN b - v < 0 THEN 0 ELSE b - v END) / (0.091::DOUBLE * (5 + user_id % 10) + 1e-10::DOUBLE), 0), 4) AS rain FROM e JOIN s USING (user_id)""")
def rain_plain_power_law(spark, d):
    got = links.attenuation(events(spark, d), ["user_id"], "v", "dynamic")
    return got.select("event_id", r(x.rain_from_attenuation(F.col("attenuation"), 5 + F.col("user_id") % 10)).alias("rain"))


@query(f"""SELECT event_id, round(s, 4) AS sigma, round(s, 6) > 30 AS wet FROM (SELECT event_id, stddev_pop(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s FROM events)""")
def rolling_std_wet(spark, d):
    got = links.wet_dry(events(spark, d), ["user_id"], "ts", "value", 8, 30.0, TIE)
    return got.select("event_id", r("sigma").alias("sigma"), (r("sigma", 6) > 30).alias("wet"))


@query(f"SELECT event_id, round(min(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 4) AS baseline FROM events")
def dynamic_baseline(spark, d):
    return links.dynamic_baseline(events(spark, d), ["user_id"], "ts", "value", 4, TIE).select("event_id", r("baseline").alias("baseline"))


_CONSTANT = f"""WITH s AS (SELECT *, stddev_pop(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) > 30 AS wet FROM events),
b AS (SELECT *, last_value(CASE WHEN NOT wet THEN value END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS baseline FROM s)"""


def _constant(spark, d):
    return links.constant_baseline(links.wet_dry(events(spark, d), ["user_id"], "ts", "value", 8, 30.0, TIE), ["user_id"], "ts", "value", tie=TIE)


@query(_CONSTANT + " SELECT event_id, round(baseline, 4) AS baseline FROM b")
def constant_baseline(spark, d):
    return _constant(spark, d).select("event_id", r("baseline").alias("baseline"))


@query(_CONSTANT + " SELECT event_id, round(CASE WHEN value - baseline - 1.6 < 0 THEN 0 ELSE value - baseline - 1.6 END, 4) AS normalized FROM b")
def normalized_attenuation(spark, d):
    return links.above_baseline(_constant(spark, d), "value", wet_antenna=1.6).select("event_id", r("normalized").alias("normalized"))


@query(_CONSTANT + """, n AS (SELECT *, CASE WHEN value - baseline - 1.6 < 0 THEN 0 ELSE value - baseline - 1.6 END AS a FROM b),
p AS (SELECT *, pow(greatest(a, 0) / (0.12::DOUBLE * (5 + user_id % 10)), 1 / 1.05::DOUBLE) AS q FROM n)
SELECT event_id, round(CASE WHEN NOT wet OR a IS NULL OR q < 0.3 THEN 0 ELSE coalesce(q, 0) END, 3) AS rain FROM p""")
def rain_two_step(spark, d):
    e = events(spark, d).withColumns({"km": (5 + F.col("user_id") % 10).cast("double"), "a": F.lit(0.12), "b": F.lit(1.05)})
    return links.two_step_rain(e, ["user_id"], "ts", "value", "km", "a", "b", 8, 30.0, 1.6, 0.3, TIE).select("event_id", r("rain", 3).alias("rain"))


@query(f"""WITH m AS (SELECT *, min(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS baseline FROM events),
p AS (SELECT event_id, pow(greatest(value - baseline, 0) / (0.12::DOUBLE * (5 + user_id % 10)), 1 / 1.05::DOUBLE) AS q FROM m)
SELECT event_id, round(CASE WHEN q < 0.3 THEN 0 ELSE coalesce(q, 0) END, 3) AS rain FROM p""")
def rain_one_step(spark, d):
    e = events(spark, d).withColumns({"km": (5 + F.col("user_id") % 10).cast("double"), "a": F.lit(0.12), "b": F.lit(1.05)})
    return links.one_step_rain(e, ["user_id"], "ts", "value", "km", "a", "b", 4, 0.3, TIE).select("event_id", r("rain", 3).alias("rain"))


@query("SELECT user_id, time_bucket(INTERVAL '15 minutes', ts) AS bin, round(max(value), 4) AS att_max, round(min(value), 4) AS att_min FROM events GROUP BY ALL")
def min_max_15min(spark, d):
    return links.min_max(events(spark, d), ["user_id"], "ts", "value", 900).select("user_id", ntz("bin").alias("bin"), r("att_max").alias("att_max"), r("att_min").alias("att_min"))


@query("SELECT round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median FROM events")
def level_stats(spark, d):
    return links.global_stats(events(spark, d), "value").select(*[r(c).alias(c) for c in ("min", "max", "mean", "median")])


@query("""WITH p AS (SELECT unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS part), k AS (SELECT user_id % 5 AS station, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY 1)
SELECT station, part, n, true AS near FROM k CROSS JOIN p""")
def quantiles_of_merged_days(spark, d):
    """Sketches by day, those of all days but the first two merged: near says that a quantile's rank among all values is within the sketch's error."""
    e = events(spark, d).select((F.col("user_id") % 5).alias("station"), "ts", "value")
    days = sketches.by_day(e, ["station"], "ts", "value").where("day >= DATE '2024-01-03'")
    asked = sketches.quantiles(sketches.merged(days, ["station"]), ["station"], [0.05, 0.5, 0.95])
    there = sketches.rank(e.where("ts >= TIMESTAMP_NTZ '2024-01-03'"), ["station"], "value", asked)
    near = (F.col("below") <= F.col("part") + sketches.ERROR) & (F.col("upto") >= F.col("part") - sketches.ERROR)
    return there.select("station", "part", "n", near.alias("near"))
