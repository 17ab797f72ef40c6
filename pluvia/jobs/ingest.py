"""Queries that conform: codes, units, payloads, unions, labels."""

from pyspark.sql import functions as F

from pluvia.functions import expressions as x
from pluvia.jobs.catalog import events, query, r, table
from pluvia.operators import timeseries as ts
from pluvia.operators.joins import union_all
from pluvia.operators.stations import to_long
from pluvia.sources.readers import flatten

_CODE = "CASE user_id % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'NP' WHEN 3 THEN 'R+' WHEN 4 THEN 'S-' WHEN 5 THEN 'P?' WHEN 6 THEN '?2' WHEN 7 THEN 'np' WHEN 8 THEN 'RX' WHEN 9 THEN 'PL' WHEN 10 THEN 'Z' ELSE ' M ' END"


@query(f"""WITH c AS (SELECT event_id, {_CODE} AS code FROM events), t AS (SELECT *, upper(trim(code)) AS u FROM c)
SELECT event_id, CASE WHEN u IS NULL OR code IN ('', 'nan', 'None') THEN 'missing' WHEN u = 'NP' THEN 'dry' WHEN u LIKE 'R%' THEN 'rain' WHEN u LIKE 'S%' THEN 'snow' WHEN u LIKE 'P%' THEN 'precip' ELSE 'missing' END AS category FROM t""")
def precip_category(spark, d):
    return events(spark, d).withColumn("code", F.expr(_CODE)).select("event_id", x.precip_category(F.col("code")).alias("category"))


@query("SELECT event_id, round((value - 32) * 5 / 9, 4) AS temp_c, round(value * 0.51444, 4) AS wind_ms, round(value * 25.4, 4) AS precip_mm, round(value / 1000, 6) AS ghz FROM events")
def unit_conversion(spark, d):
    v = F.col("value")
    return events(spark, d).select("event_id", r(x.fahrenheit_to_celsius(v)).alias("temp_c"), r(x.knots_to_ms(v)).alias("wind_ms"), r(x.inches_to_mm(v)).alias("precip_mm"), r(x.mhz_to_ghz(v), 6).alias("ghz"))


_RAW = "CASE user_id % 6 WHEN 0 THEN 'M' WHEN 1 THEN '1.0d' WHEN 2 THEN 'NaN' WHEN 3 THEN ' 3 ' WHEN 4 THEN 'T' ELSE CAST(CAST(value AS INT) AS VARCHAR(20)) END"


@query(f"SELECT event_id, CASE WHEN regexp_matches(s, '^\\s*[+-]?[0-9]+\\s*$') THEN CAST(trim(s) AS DOUBLE) END AS number FROM (SELECT event_id, {_RAW.replace('CAST(value AS INT)', 'CAST(trunc(value) AS INT)')} AS s FROM events)")
def tolerant_parse(spark, d):
    return events(spark, d).withColumn("s", F.expr(_RAW)).select("event_id", x.parse_number(F.col("s")).alias("number"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_flatten(spark, d):
    flat = flatten(events(spark, d).select("event_id", F.from_json("props", "k BIGINT").alias("p")))
    return flat.select("event_id", F.col("`p.k`").alias("k")).where("k IS NOT NULL")


@query("""SELECT user_id, ts, event_id, product FROM (SELECT user_id, ts, event_id, 'click' AS product FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, ts, event_id, NULL FROM events WHERE event_type IS DISTINCT FROM 'click')""")
def union_chunks(spark, d):
    e = events(spark, d)
    return union_all(e.where("event_type = 'click'").select("user_id", "ts", "event_id", F.lit("click").alias("product")), e.where("NOT event_type <=> 'click'").select("user_id", "ts", "event_id"))


@query("""WITH m AS (SELECT user_id, min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END) AS best FROM events WHERE event_type IN ('purchase', 'signup', 'view') GROUP BY 1)
SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN m USING (user_id) WHERE CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END = best""")
def first_product(spark, d):
    from pluvia.operators.stations import first_product

    return first_product(events(spark, d).select("user_id", "event_id", "event_type"), "user_id", ["purchase", "signup", "view"], "event_type")


@query("""SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN left(p_name, 12) || '...' ELSE p_name END AS label, p_size % 256 AS raw, CASE WHEN (p_size * 7) % 256 <> 255 THEN round((p_size * 7) % 256 * 0.4 - 30, 3) END AS dbz,
 CASE WHEN p_size % 2 = 0 THEN 'mm/h' ELSE 'in/h' END AS unit FROM part""")
def labels_and_unpacking(spark, d):
    size = F.col("p_size").cast("int")
    return table(spark, d, "part").select(
        "p_partkey", x.short_label(F.col("p_name")).alias("label"), (size % 256).alias("raw"), r(x.unpack_radar((size * 7) % 256), 3).alias("dbz"), x.unit_label("rate", F.when(size % 2 == 0, "m").otherwise("e")).alias("unit")
    )


@query("SELECT event_id, CASE WHEN value > 90 THEN NULL ELSE round(value, 4) END AS rsl FROM events")
def sentinel_to_null(spark, d):
    from pluvia.functions.schemas import conform
    from pyspark.sql import types as T

    raw = events(spark, d).select("event_id", F.when(F.col("value") > 90, 1e10).otherwise(F.col("value")).alias("rsl"))
    kinds = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("rsl", T.DoubleType())])
    return conform(raw, kinds, sentinel=1e10).select("event_id", r("rsl").alias("rsl"))


@query("SELECT l_suppkey, l_shipdate AS ts, measure, round(amount, 4) AS amount FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity AS quantity, l_tax AS tax FROM lineitem) UNPIVOT (amount FOR measure IN (quantity, tax))")
def wide_to_long(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return to_long(rows, ["l_suppkey", "ts"], ["quantity", "tax"]).select("l_suppkey", "ts", "measure", r("amount").alias("amount"))


@query("SELECT event_id, ts - INTERVAL '15 minutes' AS starts, CAST(ts AS DATE)::VARCHAR AS day, strftime(ts, '%Y%m%d') AS stamp, ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000)::BIGINT AS days FROM events")
def interval_start_and_dates(spark, d):
    from pluvia.operators.joins import to_interval_start

    e = events(spark, d)
    since = ts.seconds(F.col("ts")) - ts.seconds(F.lit("2024-01-01").cast("timestamp_ntz"))
    return e.select("event_id", to_interval_start(F.col("ts"), 900).cast("timestamp_ntz").alias("starts"), F.to_date("ts").cast("string").alias("day"), F.date_format("ts", "yyyyMMdd").alias("stamp"), x.whole_days(since).alias("days"))
