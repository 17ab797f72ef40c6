"""Queries of data set loaders, selections, alignment, and of rows with null keys, null times and NaN."""

from pyspark.sql import functions as F

from pluvia.functions import expressions as x
from pluvia.jobs.catalog import events, ntz, query, r, table
from pluvia.operators import discover, evaluate, joins, links
from pluvia.operators import stations as st
from pluvia.operators import timeseries as ts

#: events with a tenth of user_id and of ts null, and some values null or NaN.
H = """h AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE user_id % 20 END AS k, CASE WHEN event_id % 10 = 7 THEN NULL ELSE ts END AS t,
 CASE event_id % 9 WHEN 2 THEN NULL WHEN 5 THEN NULL ELSE value END AS v, event_id % 9 = 5 AS nan FROM events)"""


def _holes(spark, d):
    n = F.col("event_id")
    return events(spark, d).select(
        "event_id", F.when(n % 10 != 3, F.col("user_id") % 20).alias("k"), F.when(n % 10 != 7, F.col("ts")).alias("t"),
        F.when(n % 9 == 5, float("nan")).when(n % 9 != 2, F.col("value")).alias("v"),
    )


_SO_FAR = "OVER (PARTITION BY k ORDER BY t NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING)"


def _nulls(expr: str) -> str:
    return f"WITH {H} SELECT event_id, k, round({expr}, 3) AS total FROM h"


def _total(spark, d, how):
    got = ts.running_total(_holes(spark, d).withColumn("v", F.col("v") - 40 if how == "clip" else F.col("v")), ["k"], "t", "v", nulls=how, tie=("event_id",))
    return got.select("event_id", "k", r("total", 3).alias("total"))


@query(_nulls(f"sum(coalesce(v, 0)) {_SO_FAR}"))
def running_total_of_rows_with_holes(spark, d):
    return _total(spark, d, "zero")


@query(_nulls(f"CASE WHEN v IS NOT NULL THEN sum(coalesce(v, 0)) {_SO_FAR} END"))
def running_total_skips_nan(spark, d):
    return _total(spark, d, "skip")


@query(_nulls(f"sum(greatest(coalesce(v - 40, 0), 0)) {_SO_FAR}"))
def running_total_clipped_with_holes(spark, d):
    return _total(spark, d, "clip")


@query(f"""WITH {H}, s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM h GROUP BY k)
SELECT event_id, round(CASE WHEN s.s <> 0 AND abs(v - s.m) / s.s > 1.5 THEN NULL ELSE v END, 4) AS clean FROM h JOIN s ON h.k IS NOT DISTINCT FROM s.k""")
def zscore_mask_with_holes(spark, d):
    return links.mask_outliers(_holes(spark, d), ["k"], "v", 1.5).select("event_id", r("clean").alias("clean"))


@query(f"""WITH {H}, s AS (SELECT k, max(v) AS b FROM h GROUP BY k)
SELECT event_id, round(CASE WHEN b - v < 0 THEN 0 ELSE b - v END, 4) AS attenuation FROM h JOIN s ON h.k IS NOT DISTINCT FROM s.k""")
def attenuation_with_null_keys(spark, d):
    rows = _holes(spark, d).withColumn("v", x.clean_number(F.col("v")))
    return links.attenuation(rows, ["k"], "v").select("event_id", r("attenuation").alias("attenuation"))


@query(f"""WITH {H}, o AS (SELECT k, date_trunc('day', min(t)) AS origin FROM h GROUP BY k)
SELECT event_id, time_bucket(INTERVAL '7 hours', t, origin) AS bin FROM h JOIN o ON h.k IS NOT DISTINCT FROM o.k""")
def bins_with_holes(spark, d):
    return ts.bins(_holes(spark, d), ["k"], "t", 7 * 3600).select("event_id", ntz("bin").alias("bin"))


@query(f"""WITH {H}, l AS (SELECT * FROM h WHERE event_id % 2 = 0), q AS (SELECT * FROM h WHERE event_id % 2 = 1 AND t IS NOT NULL)
SELECT l.event_id, arg_max(q.event_id, (q.t, q.event_id)) AS matched FROM l LEFT JOIN q ON l.k IS NOT DISTINCT FROM q.k AND q.t <= l.t GROUP BY l.event_id""")
def as_of_with_holes(spark, d):
    h = _holes(spark, d).select("event_id", "k", "t")
    left, right = h.where("event_id % 2 = 0"), h.where("event_id % 2 = 1").withColumnRenamed("event_id", "other")
    return joins.as_of(left, right, ["k"], "t", ["other"]).select("event_id", F.col("matched_other").alias("matched"))


@query("""SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE value END, 4) AS filled FROM events""")
def fill_zero_of_nan_and_infinities(spark, d):
    n = F.col("event_id") % 5
    rows = events(spark, d).withColumn("v", F.when(n == 0, float("nan")).when(n == 1, None).when(n == 2, float("inf")).when(n == 3, float("-inf")).otherwise(F.col("value")))
    f = F.col("filled")
    return ts.fill(rows, [], "ts", "v", "zero").select("event_id", r(F.when(n.isin(2, 3), f / ts.LARGEST).otherwise(f)).alias("filled"))


_PLACES = "m AS (SELECT s_suppkey AS link, 40 + (s_suppkey % 37) / 50.0::DOUBLE AS a, 40 + (s_suppkey % 41) / 50.0::DOUBLE AS b, -74 + (s_suppkey % 29) / 40.0::DOUBLE AS c, -74 + (s_suppkey % 31) / 40.0::DOUBLE AS e FROM supplier), c AS (SELECT *, (a + b) / 2 AS lat, (c + e) / 2 AS lon FROM m)"


def _links(spark, d):
    s = F.col("s_suppkey")
    meta = table(spark, d, "supplier").select(
        s.alias("link"), (40 + (s % 37) / 50).alias("site_0_lat"), (-74 + (s % 29) / 40).alias("site_0_lon"), (40 + (s % 41) / 50).alias("site_1_lat"), (-74 + (s % 31) / 40).alias("site_1_lon")
    )
    facts = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("link"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_quantity").cast("double").alias("rsl"))
    return facts, meta


_FACTS = "f AS (SELECT l_suppkey AS link, l_shipdate::TIMESTAMP AS ts, l_quantity::DOUBLE AS rsl FROM lineitem)"


@query(f"""WITH {_PLACES}, {_FACTS} SELECT f.link, ts, round(rsl, 3) AS rsl, round(lat, 6) AS lat, round(lon, 6) AS lon FROM f LEFT JOIN c USING (link) WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'""")
def link_dataset(spark, d):
    facts, meta = _links(spark, d)
    return links.dataset(facts, meta, "link", "ts", ["rsl"], "1996-01-01 00:00:00", "1996-06-30 00:00:00").select("link", "ts", r("rsl", 3).alias("rsl"), r("lat", 6).alias("lat"), r("lon", 6).alias("lon"))


@query(f"""WITH {_PLACES}, {_FACTS}, g AS (SELECT 40 + (c_custkey % 11) / 14.0::DOUBLE AS gla, -74 + (c_custkey % 7) / 11.0::DOUBLE AS glo FROM customer),
n AS (SELECT DISTINCT link FROM c, g WHERE lon BETWEEN -73.9 AND -73.4 AND lat BETWEEN 40.1 AND 40.6
  AND 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(gla - lat) / 2), 2) + cos(radians(lat)) * cos(radians(gla)) * pow(sin(radians(glo - lon) / 2), 2)))) <= 6)
SELECT f.link, time_bucket(INTERVAL '15 minutes', ts) AS bin, round(max(rsl), 3) AS rsl_max, round(min(rsl), 3) AS rsl_min, round(any_value(lat), 6) AS lat FROM f JOIN n USING (link) JOIN c USING (link)
WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-06-30' GROUP BY f.link, bin""")
def link_dataset_in_box_near_gauges(spark, d):
    facts, meta = _links(spark, d)
    k = F.col("c_custkey")
    gauges = table(spark, d, "customer").select((40 + (k % 11) / 14).alias("gauge_lat"), (-74 + (k % 7) / 11).alias("gauge_lon"))
    got = links.dataset(facts, meta, "link", "ts", ["rsl"], "1996-01-01 00:00:00", "1998-06-30 00:00:00", 900, (-73.9, 40.1), (-73.4, 40.6), gauges, gauge_km=6.0)
    return got.select("link", ntz("bin").alias("bin"), r("rsl_max", 3).alias("rsl_max"), r("rsl_min", 3).alias("rsl_min"), r("lat", 6).alias("lat"))


@query(f"WITH {_PLACES} SELECT link FROM c WHERE lon BETWEEN -73.8 AND -73.5 AND lat BETWEEN 40.2 AND 40.5")
def bounding_box(spark, d):
    _, meta = _links(spark, d)
    lat, lon = ((F.col(f"site_0_{c}") + F.col(f"site_1_{c}")) / 2 for c in ("lat", "lon"))
    return meta.where(joins.in_box(lon, lat, (-73.8, 40.2), (-73.5, 40.5))).select("link")


def _bell(which: str, side: str) -> str:
    bells, slope, offset = x.ATTENUATION[which, side]
    return " + ".join([f"({a}::DOUBLE) * exp(-pow((f - ({b}::DOUBLE)) / ({c}::DOUBLE), 2))" for a, b, c in bells] + [f"({slope}::DOUBLE) * f", f"({offset}::DOUBLE)"])


@query(f"""WITH l AS (SELECT s_suppkey AS link, s_suppkey % 2 = 0 AS h, log10(s_suppkey % 80 + 1.5::DOUBLE) AS f FROM supplier),
c AS (SELECT link, pow(10, CASE WHEN h THEN {_bell('a', 'h')} ELSE {_bell('a', 'v')} END) AS a, CASE WHEN h THEN {_bell('b', 'h')} ELSE {_bell('b', 'v')} END AS b FROM l)
SELECT link, round(a, 6) AS a, round(b, 6) AS b, round(pow(5 / (a * 2.5::DOUBLE), 1 / b), 4) AS rain FROM c""")
def coefficients_by_frequency(spark, d):
    s = F.col("s_suppkey")
    a, b = x.power_law_coefficients(s % 80 + 1.5, F.when(s % 2 == 0, "horizontal").otherwise("V"))
    got = table(spark, d, "supplier").select(s.alias("link"), a.alias("a"), b.alias("b"))
    return got.select("link", r("a", 6).alias("a"), r("b", 6).alias("b"), r(x.rain_power_law(F.lit(5.0), F.lit(2.5), F.col("a"), F.col("b"), 0.0)).alias("rain"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - l_discount * 100, 4) AS attenuation FROM lineitem")
def path_loss(spark, d):
    return links.path_loss(table(spark, d, "lineitem").withColumn("rsl", F.col("l_discount") * 100), "l_quantity").select("l_orderkey", "l_linenumber", r("attenuation").alias("attenuation"))


@query("""WITH a AS (SELECT user_id, ts, min(value) AS estimate FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, ts, max(value) + 1 AS truth FROM events GROUP BY ALL),
j AS (SELECT a.*, truth, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM a JOIN b USING (user_id, ts)) SELECT user_id, ts, round(estimate, 4) AS estimate, round(truth, 4) AS truth FROM j WHERE n > 2""")
def aligned_series(spark, d):
    e = events(spark, d)
    a = e.where("event_id % 2 = 0").groupBy("user_id", "ts").agg(F.min("value").alias("estimate"))
    b = e.groupBy("user_id", "ts").agg((F.max("value") + 1).alias("truth"))
    return joins.align(a, b, ["user_id"], "ts", trim=2).select("user_id", "ts", r("estimate").alias("estimate"), r("truth").alias("truth"))


@query("SELECT event_id, ts FROM events WHERE ts = (SELECT max(ts) FROM events WHERE event_id <= 100)")
def exact_instant(spark, d):
    e = events(spark, d)
    return ts.at_instant(e, "ts", str(e.where("event_id <= 100").agg(F.max("ts")).first()[0])).select("event_id", "ts")


@query("SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL ORDER BY 1")
def distinct_types(spark, d):
    return st.distinct_values(events(spark, d), "event_type")


@query("SELECT user_id % 3 AS model, event_id % 50 AS epoch, round(avg(value), 4) AS loss, round(avg(value * value), 3) AS square, count(*) AS steps FROM events GROUP BY ALL")
def epoch_averages(spark, d):
    h = events(spark, d).select((F.col("user_id") % 3).alias("model"), (F.col("event_id") % 50).alias("epoch"), F.col("value").alias("loss"), (F.col("value") * F.col("value")).alias("square"))
    return evaluate.epoch_means(h, ["model"], "epoch", ["loss", "square"]).withColumns({"loss": r("loss"), "square": r("square", 3)})


@query("SELECT user_id, round(avg(abs(value - 50) + pow(value / 10, 2)), 4) AS loss FROM events GROUP BY 1")
def custom_loss(spark, d):
    return evaluate.expression_loss(events(spark, d), ["user_id"], "abs(value - 50) + power(value / 10, 2)").withColumn("loss", r("loss"))


@query("SELECT event_id, round(2 * value + 1, 4) AS first, round(pow(value, 2) - cos(value), 4) AS second FROM events")
def predicted_by_equations(spark, d):
    return evaluate.predict(events(spark, d), {"first": "2 * value + 1", "second": "power(value, 2) - cos(value)"}).select("event_id", r("first").alias("first"), r("second").alias("second"))


@query("""WITH p AS (SELECT max(value) AS peak FROM events) SELECT CASE WHEN value >= 0 THEN least(10, floor(value * 10 / peak)::INT + 1) END AS class, count(*) AS n, round(min(peak) / 10 * 3, 4) AS fourth FROM events, p GROUP BY ALL""")
def boundary_classes(spark, d):
    e = events(spark, d)
    rows = e.crossJoin(F.broadcast(e.agg(F.max("value").alias("peak"))))  # one row
    return rows.groupBy(x.boundary_class(F.col("value"), F.col("peak")).alias("class")).agg(F.count(F.lit(1)).alias("n"), r(F.min(x.boundaries(F.col("peak"))[3])).alias("fourth"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p, round(tanh(value / 50), 6) AS t, round_even(event_id % 8 / 4.0, 0)::INT AS d FROM events")
def activations(spark, d):
    v = F.col("value")
    return events(spark, d).select("event_id", r(x.sigmoid((v - 50) / 10), 6).alias("p"), r(F.tanh(v / 50), 6).alias("t"), x.detected((F.col("event_id") % 8) / 4).alias("d"))


@query("SELECT event_id, round(10.0 * (value - user_id), 4) AS dx, round(value * (28 - event_id % 7) - user_id, 4) AS dy, round(value * user_id - 8 / 3::DOUBLE * (event_id % 7), 4) AS dz FROM events")
def lorenz_right_hand_side(spark, d):
    dx, dy, dz = x.lorenz(F.col("user_id"), F.col("value"), F.col("event_id") % 7)
    dy = x.lorenz(F.col("value"), F.col("user_id"), F.col("event_id") % 7)[1]
    return events(spark, d).select("event_id", r(dx).alias("dx"), r(dy).alias("dy"), r(dz).alias("dz"))


@query("""SELECT event_id, round(sin(value), 6) AS sin, round(exp(-value / 10), 6) AS exp, round(pow(value, 3), 3) AS cube, round(CASE WHEN value > 0 THEN ln(value) END, 6) AS log, round(CASE WHEN value <> 0 THEN 1 / value END, 6) AS inv,
 round(greatest(value, user_id), 4) AS max, round(CASE WHEN user_id <> 0 THEN value / user_id END, 6) AS div, round(atan(value), 6) AS atan, round(CASE WHEN abs(value / 100) <= 1 THEN asin(value / 100) END, 6) AS asin FROM events""")
def symbolic_operators(spark, d):
    v, u = F.col("value"), F.col("user_id").cast("double")
    o, b = x.UNARY, x.BINARY
    return events(spark, d).select(
        "event_id", r(o["sin"](v), 6).alias("sin"), r(o["exp"](-v / 10), 6).alias("exp"), r(o["cube"](v), 3).alias("cube"), r(o["log"](v), 6).alias("log"), r(o["inv"](v), 6).alias("inv"),
        r(b["max"](v, u)).alias("max"), r(b["/"](v, u), 6).alias("div"), r(o["atan"](v), 6).alias("atan"), r(o["asin"](v / 100), 6).alias("asin"),
    )


@query("SELECT event_id, round(value * (user_id / 10.0::DOUBLE), 4) AS product, round(sin(value), 6) AS s1, round(cos(2 * value), 6) AS c2, round(sqrt(value + 1), 6) AS own, 13 AS terms FROM events WHERE value >= 0")
def feature_library(spark, d):
    e = events(spark, d).where("value >= 0").withColumns({"x": F.col("value"), "y": F.col("user_id") / 10})
    f = discover.features(["x", "y"], 1, True, 2, {"root": F.sqrt(F.col("x") + 1), "x y": F.col("x") * F.col("y")})
    return e.select("event_id", r(f["x y"]).alias("product"), r(f["sin(1 x)"], 6).alias("s1"), r(f["cos(2 x)"], 6).alias("c2"), r(f["root"], 6).alias("own"), F.lit(len(f)).alias("terms"))


@query("SELECT c_custkey, round(round(c_acctbal, 3) + round(c_acctbal * 2, 3), 2) AS head, 5 AS every FROM customer")
def array_features(spark, d):
    b = F.col("c_acctbal")
    long = F.array(r(b, 3), r(b * 2, 3), r(b * 3, 3))
    head = x.first_n(long, 2)
    return table(spark, d, "customer").select("c_custkey", r(F.aggregate(head, F.lit(0.0), lambda a, y: a + y), 2).alias("head"), F.size(x.features(head, long, F.array().cast("array<double>"))).alias("every"))


@query("SELECT event_id, ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT < floor(0.8 * 4294967296) AS train FROM events")
def random_split(spark, d):
    return ts.hash_split(events(spark, d), "event_id", 0.8, 7).select("event_id", "train")


@query("""WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events), n AS (SELECT user_id, ts, event_id, (value - m) / s AS z, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS block FROM events, s),
b AS (SELECT user_id, block, min(ts) AS start, sum(z) AS total FROM n GROUP BY user_id, block HAVING count(*) = 8)
SELECT user_id, block, start, round(total, 4) AS total, row_number() OVER (PARTITION BY user_id ORDER BY block) <= floor(0.7::DOUBLE * count(*) OVER (PARTITION BY user_id)) AS train FROM b""")
def training_dataset(spark, d):
    got = ts.training_dataset(events(spark, d).select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", ["value"], 8, 0.7, ("event_id",))
    return got.select("user_id", "block", "start", r(F.aggregate("value", F.lit(0.0), lambda a, y: a + y)).alias("total"), "train")


@query("SELECT user_id % 5 AS station, round(avg(value) FILTER (event_type = 'click'), 4) AS click, round(avg(value) FILTER (event_type = 'view'), 4) AS view FROM events GROUP BY 1")
def long_to_wide(spark, d):
    rows = events(spark, d).withColumn("station", F.col("user_id") % 5)
    return st.to_wide(rows, ["station"], "event_type", "value", ["click", "view"]).withColumns({"click": r("click"), "view": r("view")})


@query("SELECT event_id, round(value, 4) AS value FROM events")
def guarded_columns(spark, d):
    return st.present(st.named_like(events(spark, d), "VAL", "event_id"), ["event_id", "value", "no_such"]).withColumn("value", r("value"))


@query("SELECT user_id, count(*) FILTER (value > 60) AS wet, count(*) FILTER (value > 0) AS rain FROM events WHERE user_id IN (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS n FROM (SELECT DISTINCT user_id FROM events)) WHERE n IN (0, 2, 5)) GROUP BY 1")
def wet_rows_of_chosen_stations(spark, d):
    rows = st.nth_stations(events(spark, d), "user_id", [0, 2, 5])
    return rows.groupBy("user_id").agg(F.count_if(st.wet(F.col("value"), 60)).alias("wet"), F.count_if(F.col("value") > 0).alias("rain"))


@query("SELECT event_id, round(value, 4) AS value FROM events WHERE value > 0")
def rows_with_rain(spark, d):
    return st.with_rain(events(spark, d), "value").select("event_id", r("value").alias("value"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'nan', '') THEN NULL ELSE event_type END AS kind FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'nan' ELSE event_type END AS event_type FROM events)")
def text_null(spark, d):
    return events(spark, d).select("event_id", x.null_text(F.when(F.col("event_type") == "click", "nan").otherwise(F.col("event_type"))).alias("kind"))
