"""Queries over streams: events as a stream of files, until what is there is taken; results are written and read back.

A stream that ends at time m (its last row) has emitted what the watermark m - late has passed; twins say the same.
"""

from pyspark.sql import functions as F

from pluvia.jobs.catalog import ntz, query, r, table
from pluvia.jobs.landed import landing
from pluvia.sources.polling import polled
from pluvia.streaming import series

LATE = "1 hour"
_MARK = "m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '1 hour' AS mark FROM events)"


def _streamed(spark, d, shape):
    path = landing(spark)
    kinds = table(spark, d, "events").schema
    rows = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = shape(rows)
    run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("SELECT DISTINCT user_id, ts FROM events")
def streamed_dedupe(spark, d):
    twice = lambda rows: rows.unionByName(rows)  # noqa: E731  a poll repeats what it sent
    return _streamed(spark, d, lambda rows: series.deduped(twice(rows), ["user_id"], "ts", LATE)).select("user_id", ntz("ts").alias("ts"))


@query(f"""WITH {_MARK}, b AS (SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS bin, coalesce(sum(value), 0) AS total, max(value) AS largest, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, bin, round(total, 4) AS total, round(largest, 4) AS largest, n FROM b, m WHERE bin + INTERVAL '1 hour' <= mark""")
def streamed_hours(spark, d):
    rules = {"total": ("sum", "value"), "largest": ("max", "value"), "n": ("count", "event_id")}
    got = _streamed(spark, d, lambda rows: series.resampled(rows, ["user_id"], "ts", "1 hour", rules, LATE))
    return got.select("user_id", ntz("bin").alias("bin"), r("total").alias("total"), r("largest").alias("largest"), "n")


@query(f"""WITH {_MARK}, l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '2 hours' AS new FROM events),
s AS (SELECT *, sum(coalesce(new, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s, m GROUP BY user_id, run, mark HAVING max(ts) + INTERVAL '2 hours' <= mark""")
def streamed_sessions(spark, d):
    got = _streamed(spark, d, lambda rows: series.sessions(rows, ["user_id"], "ts", "2 hours", LATE))
    return got.select("user_id", ntz("start").alias("start"), ntz("end").alias("end"), "n")


@query(f"""WITH {_MARK}, s AS (SELECT user_id, ts, value, stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, value ROWS 7 PRECEDING) AS sigma, ts <= mark AS past FROM events, m)
SELECT user_id, ts, round(value, 4) AS value, round(sigma, 4) AS sigma FROM s WHERE past""")
def streamed_rolling_deviation(spark, d):
    with series.rocksdb(spark):
        got = _streamed(spark, d, lambda rows: series.rolling_deviation(rows, "user_id", "ts", "value", 8, LATE))
    return got.select("user_id", ntz("ts").alias("ts"), r("value").alias("value"), r("sigma").alias("sigma"))


@query("SELECT DISTINCT user_id, ts, round(value, 4) AS value FROM events")
def polled_and_resumed(spark, d):
    """Payloads of two polls, the second of which repeats much of the first. The query stops after the first one, and another goes on from what was committed."""
    path = landing(spark)
    time = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    obs = table(spark, d, "events").select("event_id", F.struct("user_id", time.alias("ts"), "value").alias("o"))
    for poll, rows in (("poll-1", obs.where("event_id % 3 < 2")), ("poll-2", obs.where("event_id % 3 > 0"))):
        rows.groupBy(F.floor(F.col("event_id") / 100)).agg(F.collect_list("o").alias("observations")).select("observations").write.json(f"{path}/landed/{poll}")
        stream = series.deduped(polled(spark, f"{path}/landed", "user_id bigint, ts timestamp, value double"), ["user_id"], "ts", "60 days")
        run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select("user_id", ntz("ts").alias("ts"), r("value").alias("value"))
