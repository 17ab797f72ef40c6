"""Queries that join: dimensions, what is missing, as-of, distances, maps."""

from pyspark.sql import functions as F

from pluvia.functions import expressions as x
from pluvia.jobs.catalog import events, query, r, table
from pluvia.operators import geostatistics, joins, spatial


@query("SELECT s_suppkey, coalesce(n_name, 'Unknown') AS n_name, round(s_acctbal, 2) AS s_acctbal FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON s_nationkey = n_nationkey")
def dim_lookup_default(spark, d):
    dim = table(spark, d, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.lookup(table(spark, d, "supplier"), dim, ["s_nationkey"], {"n_name": "Unknown"}).select("s_suppkey", "n_name", r("s_acctbal", 2).alias("s_acctbal"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_selected(spark, d):
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.selected(table(spark, d, "orders"), wanted, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_missing(spark, d):
    return joins.missing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""WITH a AS (SELECT * FROM events WHERE event_type = 'click'), b AS (SELECT * FROM events WHERE event_type = 'view'),
m AS (SELECT a.event_id, a.user_id, max((b.ts, b.value)) AS t FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts <= a.ts AND epoch_us(a.ts) - epoch_us(b.ts) <= 86400000000 GROUP BY ALL)
SELECT event_id, user_id, t[1] AS matched_ts, round(t[2], 4) AS matched_value FROM m""")
def as_of_align(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", "value")
    return joins.as_of(left, right, ["user_id"], "ts", ["value"], 86400).select("event_id", "user_id", "matched_ts", r("matched_value").alias("matched_value"))


def _points(spark, d, tag):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias(f"id{tag}"), F.col("embedding")[0].cast("double").alias(f"x{tag}"), F.col("embedding")[1].cast("double").alias(f"y{tag}"))


def _checkpoints(spark):
    """A folder for checkpoints, where the session has none."""
    from pluvia.jobs.landed import landing

    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(landing(spark))


_PAIRS = """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
q AS (SELECT a.vec_id AS ida, b.vec_id AS idb, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id AND abs(a.x - b.x) <= 0.02 AND abs(a.y - b.y) <= 0.02)"""


def _near(spark, d):
    return joins.within(_points(spark, d, "a"), _points(spark, d, "b"), [("xa", "xb"), ("ya", "yb")], 0.02).where("ida <> idb")


@query(_PAIRS + " SELECT ida, idb, round(d, 6) AS distance FROM q WHERE d <= 0.02")
def distance_join(spark, d):
    return _near(spark, d).select("ida", "idb", r("distance", 6).alias("distance"))


@query(_PAIRS + " SELECT ida, arg_min(idb, (d, idb)) AS idb, round(min(d), 6) AS distance FROM q WHERE d <= 0.02 GROUP BY ida")
def nearest_within(spark, d):
    _checkpoints(spark)
    return joins.nearest_within(_points(spark, d, "a"), "ida", ("xa", "ya"), 0.02).select("ida", F.col("other").alias("idb"), r("distance", 6).alias("distance"))


_KM = """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 200 AS lat, embedding[2]::DOUBLE * 400 AS lon FROM embeddings),
q AS (SELECT a.vec_id AS ida, b.vec_id AS idb, 2 * 6371.0088::DOUBLE * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS d FROM p a, p b WHERE a.vec_id <> b.vec_id)"""


@query(_KM + " SELECT ida, idb, round(d, 3) AS distance_km FROM q WHERE d <= 500")
def distance_join_km(spark, d):
    def points(tag):
        return _points(spark, d, tag).select(f"id{tag}", (F.col(f"x{tag}") * 200).alias(f"lat{tag}"), (F.col(f"y{tag}") * 400).alias(f"lon{tag}"))

    got = joins.within_km(points("a"), points("b"), ("lata", "lona"), ("latb", "lonb"), 500).where("ida <> idb")
    return got.select("ida", "idb", r(x.haversine_km(F.col("lata"), F.col("lona"), F.col("latb"), F.col("lonb")), 3).alias("distance_km"))


_MAP = """WITH p AS (SELECT vec_id AS point, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings),
g AS (SELECT -0.3::DOUBLE + i * 0.05::DOUBLE AS gx, -0.3::DOUBLE + j * 0.05::DOUBLE AS gy FROM range(13) a(i), range(13) b(j)),
w AS (SELECT point, label, gx, gy, 1 / nullif(pow(x - gx, 2) + pow(y - gy, 2), 0) AS w FROM p, g WHERE sqrt(pow(x - gx, 2) + pow(y - gy, 2)) <= 0.1),
t AS (SELECT unnest([0, 1, 2]) AS step),
m AS (SELECT step, gx, gy, sum(w * (label + step * (point % 7))) / sum(w) AS rain, count(*) AS n FROM w, t GROUP BY ALL)"""


def _map(spark, d):
    e = table(spark, d, "embeddings")
    points = e.select(F.col("vec_id").alias("point"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    values = e.select(F.col("vec_id").alias("point"), "label", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step")).select("point", "step", (F.col("label") + F.col("step") * (F.col("point") % 7)).cast("double").alias("rain"))
    cells = spatial.grid(spark, (-0.3, 0.3, 0.05), (-0.3, 0.3, 0.05))
    return spatial.interpolate(values, spatial.weights(points, cells, 0.1), ["step"], "rain")


@query(_MAP + " SELECT step, round(gx, 4) AS gx, round(gy, 4) AS gy, round(rain, 4) AS rain, n FROM m")
def idw_grid(spark, d):
    return _map(spark, d).select("step", r("gx").alias("gx"), r("gy").alias("gy"), r("rain").alias("rain"), "n")


@query(_MAP + " SELECT step, round(stddev_pop(rain), 4) AS deviation FROM m GROUP BY step ORDER BY stddev_pop(rain) DESC, step LIMIT 1")
def most_variable_step(spark, d):
    return spatial.most_variable(_map(spark, d), "step", "rain").select("step", r("deviation").alias("deviation"))


@query("""SELECT user_id % 10 AS link, event_id % 6 AS step, round(avg(value), 3) AS rain, 2::BIGINT AS points FROM events WHERE value > 0 GROUP BY ALL""")
def virtual_points_keep_link_rain(spark, d):
    """Whatever points take from other links nearby, the mean of their rain ** b gives the link's rain again."""
    _checkpoints(spark)
    e = events(spark, d).where("value > 0")
    rain = e.groupBy((F.col("user_id") % 10).alias("link"), (F.col("event_id") % 6).alias("step")).agg(F.avg("value").alias("rain"))
    k = F.col("link")
    ends = rain.select("link").distinct().select("link", (k % 4).cast("double").alias("x0"), (k % 3).cast("double").alias("y0"), (k % 4 + 1.5).alias("x1"), (k % 5).cast("double").alias("y1"))
    points, _ = spatial.refine(rain, spatial.virtual_points(ends, 2), ["step"], 1.1, 3.0, rounds=3)
    return points.groupBy("link", "step").agg(r(F.pow(F.avg(F.pow("rain", F.lit(1.1))), F.lit(1 / 1.1)), 3).alias("rain"), F.count(F.lit(1)).alias("points"))


_VARIO = """WITH p AS (SELECT vec_id AS point, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label + vec_id % 7 AS v FROM embeddings),
q AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS h, pow(a.v - b.v, 2) AS s FROM p a JOIN p b ON a.point < b.point)
SELECT least(floor(h / 0.1 * 5), 4)::INT AS class, round(avg(h), 5) AS lag, round(avg(s) / 2, 4) AS gamma, count(*) AS n FROM q WHERE h <= 0.1 GROUP BY ALL"""


def _gauges(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("point"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("label") + F.col("vec_id") % 7).cast("double").alias("rain"))


@query(_VARIO)
def variogram(spark, d):
    got = geostatistics.variogram(_gauges(spark, d), "rain", 0.1, 5)
    return got.select("class", r("lag", 5).alias("lag"), r("gamma").alias("gamma"), "n")


@query("""WITH p AS (SELECT min(vec_id) AS point, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings GROUP BY 2, 3), e AS (SELECT vec_id AS point, (label + vec_id % 7)::DOUBLE AS v FROM embeddings),
c AS (SELECT -0.3::DOUBLE + i * 0.05::DOUBLE AS gx, -0.3::DOUBLE + j * 0.05::DOUBLE AS gy FROM range(13) a(i), range(13) b(j)),
n AS (SELECT gx, gy, point, x, y, sqrt(pow(x - gx, 2) + pow(y - gy, 2)) AS d, row_number() OVER (PARTITION BY gx, gy ORDER BY sqrt(pow(x - gx, 2) + pow(y - gy, 2)), point) AS k FROM p, c WHERE sqrt(pow(x - gx, 2) + pow(y - gy, 2)) <= 0.2 QUALIFY k <= 3),
t AS (SELECT o.gx, o.gy, o.d AS d1, u.d AS d2, w.d AS d3, sqrt(pow(o.x - u.x, 2) + pow(o.y - u.y, 2)) AS a, sqrt(pow(o.x - w.x, 2) + pow(o.y - w.y, 2)) AS b, sqrt(pow(u.x - w.x, 2) + pow(u.y - w.y, 2)) AS c, ev.v AS v1, eu.v AS v2, ew.v AS v3
  FROM n o JOIN n u ON u.gx = o.gx AND u.gy = o.gy AND u.k = 2 JOIN n w ON w.gx = o.gx AND w.gy = o.gy AND w.k = 3 JOIN e ev ON ev.point = o.point JOIN e eu ON eu.point = u.point JOIN e ew ON ew.point = w.point WHERE o.k = 1),
i AS (SELECT *, -c / (2 * a * b) AS i11, -b / (2 * a * c) AS i22, -a / (2 * b * c) AS i33, 1 / (2 * a) AS i12, 1 / (2 * b) AS i13, 1 / (2 * c) AS i23 FROM t),
m AS (SELECT *, ((i11 + i12 + i13) * d1 + (i12 + i22 + i23) * d2 + (i13 + i23 + i33) * d3 - 1) / (i11 + i22 + i33 + 2 * (i12 + i13 + i23)) AS mu FROM i),
z AS (SELECT *, i11 * (d1 - mu) + i12 * (d2 - mu) + i13 * (d3 - mu) AS w1, i12 * (d1 - mu) + i22 * (d2 - mu) + i23 * (d3 - mu) AS w2, i13 * (d1 - mu) + i23 * (d2 - mu) + i33 * (d3 - mu) AS w3 FROM m)
SELECT round(gx, 4) AS gx, round(gy, 4) AS gy, round(w1 * v1 + w2 * v2 + w3 * v3, 3) AS rain, round(greatest(0, w1 * d1 + w2 * d2 + w3 * d3 + mu), 4) AS variance, 3::BIGINT AS n FROM z""")
def kriged_grid(spark, d):
    """Three neighbours and a linear variogram, whose system SQL can solve; cells with fewer neighbours are left out on both sides."""
    points, cells = _gauges(spark, d), spatial.grid(spark, (-0.3, 0.3, 0.05), (-0.3, 0.3, 0.05))
    w = geostatistics.kriging_weights(points, cells, 0.2, {"kind": "linear", "nugget": 0.0, "sill": 1.0, "reach": 1.0}, 3)
    got = geostatistics.kriged(points.select("point", "rain"), w, [], "rain").where("n = 3")
    return got.select(r("gx").alias("gx"), r("gy").alias("gy"), r("rain", 3).alias("rain"), r("variance").alias("variance"), "n")


@query("""WITH e AS (SELECT vec_id AS point, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings), t AS (SELECT unnest([0, 1]) AS step),
c AS (SELECT -0.3::DOUBLE + i * 0.05::DOUBLE AS gx, -0.3::DOUBLE + j * 0.05::DOUBLE AS gy, i, j FROM range(13) a(i), range(13) b(j)), b AS (SELECT step, gx, gy, (i + j * (step + 1))::DOUBLE AS m FROM c, t),
w AS (SELECT point, gx, gy, 1 / nullif(pow(x - gx, 2) + pow(y - gy, 2), 0) AS w FROM e, c WHERE sqrt(pow(x - gx, 2) + pow(y - gy, 2)) <= 0.1),
p AS (SELECT step, point, sum(w * m) / sum(w) AS m FROM w JOIN b USING (gx, gy) GROUP BY ALL), o AS (SELECT step, point, label + step * (point % 7) - m AS off FROM p JOIN e USING (point)),
s AS (SELECT step, gx, gy, sum(w * off) / sum(w) AS c FROM w JOIN o USING (point) GROUP BY ALL)
SELECT step, round(gx, 4) AS gx, round(gy, 4) AS gy, round(m + coalesce(c, 0), 3) AS rain, round(coalesce(c, 0), 3) AS correction FROM b LEFT JOIN s USING (step, gx, gy)""")
def merged_map(spark, d):
    """Gauges merged into a map that rises along both axes, at two times."""
    e = _gauges(spark, d)
    step = F.explode(F.array(F.lit(0), F.lit(1)))
    gauges = table(spark, d, "embeddings").select(F.col("vec_id").alias("point"), "label", step.alias("step")).select("step", "point", (F.col("label") + F.col("step") * (F.col("point") % 7)).cast("double").alias("rain"))
    at = lambda c: F.round((F.col(c) + 0.3) / 0.05)
    background = spatial.grid(spark, (-0.3, 0.3, 0.05), (-0.3, 0.3, 0.05)).withColumn("step", step).withColumn("rain", (at("gx") + at("gy") * (F.col("step") + 1)).cast("double"))
    got = geostatistics.merged(background, gauges, e.select("point", "x", "y"), ["step"], "rain", 0.1)
    return got.select("step", r("gx").alias("gx"), r("gy").alias("gy"), r("rain", 3).alias("rain"), r("correction", 3).alias("correction"))
