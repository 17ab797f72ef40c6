"""Queries that score: the value of a row stands for the truth, the one before it for an estimate."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pluvia.jobs.catalog import events, query, r, table
from pluvia.operators import discover, evaluate, resampling

_BOTH = "p AS (SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS guess FROM events) WHERE guess IS NOT NULL)"


def _both(spark, d):
    return events(spark, d).withColumn("guess", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("guess IS NOT NULL")


_ERR = "count(*) AS n, round(avg(guess - value), 9)::FLOAT AS bias, avg(abs(guess - value))::FLOAT AS mae, avg(pow(guess - value, 2))::FLOAT AS mse, sqrt(avg(pow(guess - value, 2)))::FLOAT AS rmse"


def _err(df, *keys):
    return df.select(*keys, "n", r("bias", 9).cast("float").alias("bias"), *[F.col(c).cast("float").alias(c) for c in ("mae", "mse", "rmse")])


@query(f"WITH {_BOTH} SELECT user_id, {_ERR} FROM p GROUP BY user_id")
def rmse_bias(spark, d):
    return _err(evaluate.errors(_both(spark, d), ["user_id"], "guess", "value"), "user_id")


@query(f"WITH {_BOTH}, t AS (SELECT max(value) AS top FROM p), i AS (SELECT p.*, least(5, floor(value * 5 / top) + 1)::INT AS interval FROM p, t WHERE value >= 0) SELECT interval, {_ERR} FROM i GROUP BY interval")
def binned_errors(spark, d):
    return _err(evaluate.by_interval(_both(spark, d), "guess", "value"), "interval")


_CELLS = "count(*) FILTER (g AND a) AS tp, count(*) FILTER (g AND NOT a) AS fp, count(*) FILTER (NOT g AND a) AS fn, count(*) FILTER (NOT g AND NOT a) AS tn"


@query(f"""WITH {_BOTH}, c AS (SELECT user_id, {_CELLS} FROM (SELECT user_id, guess > 50 AS g, value > 50 AS a FROM p) GROUP BY 1)
SELECT *, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 5) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 5) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 5) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 5) AS f1 FROM c""")
def confusion(spark, d):
    got = evaluate.confusion(_both(spark, d).select("user_id", (F.col("guess") > 50).alias("g"), (F.col("value") > 50).alias("a")), ["user_id"], "g", "a")
    return got.select("user_id", "tp", "fp", "fn", "tn", *[r(c, 5).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"""WITH {_BOTH} SELECT user_id, CASE WHEN guess > 50 AND value > 50 THEN 'hit' WHEN guess <= 50 AND value > 50 THEN 'miss' WHEN guess > 50 THEN 'false alarm' ELSE 'correct rejection' END AS detection, count(*) AS n FROM p GROUP BY ALL""")
def detection_classes(spark, d):
    return _both(spark, d).groupBy("user_id", evaluate.detection(F.col("guess") > 50, F.col("value") > 50).alias("detection")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BOTH}, l AS (SELECT CAST(ts AS DATE) AS day, avg((1 - 0.9::DOUBLE * exp(-0.05::DOUBLE * value)) * pow(guess - value, 2)) AS l FROM p GROUP BY 1) SELECT round(sum(l), 2) AS loss FROM l""")
def weighted_loss(spark, d):
    return evaluate.weighted_loss(_both(spark, d).withColumn("day", F.to_date("ts")), "day", "guess", "value", 0.05, 0.9).select(r("loss", 2).alias("loss"))


@query("""SELECT round(avg(-((value > 50)::INT * greatest(CASE WHEN value > 0 THEN ln(value / 100) ELSE -100 END, -100) + (1 - (value > 50)::INT) * greatest(CASE WHEN value < 100 THEN ln(1 - value / 100) ELSE -100 END, -100))), 5) AS loss FROM events WHERE value BETWEEN 0 AND 100""")
def cross_entropy(spark, d):
    e = events(spark, d).where("value BETWEEN 0 AND 100")
    return e.agg(r(evaluate.cross_entropy(F.col("value") / 100, (F.col("value") > 50).cast("int")), 5).alias("loss"))


@query("""WITH l AS (SELECT l_linenumber, l_orderkey, l_extendedprice / (l_linenumber * l_linenumber) AS loss FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY loss, l_orderkey) AS n FROM l),
f AS (SELECT *, min(loss) OVER (ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM b WHERE n = 1)
SELECT l_linenumber, l_orderkey, round(loss, 3) AS loss FROM f WHERE s IS NULL OR loss < s""")
def pareto_front(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", "l_orderkey", (F.col("l_extendedprice") / (F.col("l_linenumber") * F.col("l_linenumber"))).alias("loss"))
    return evaluate.pareto(rows, "l_linenumber", "loss", ["l_orderkey"]).select("l_linenumber", "l_orderkey", r("loss", 3).alias("loss"))


@query("""WITH h AS (SELECT user_id % 5 AS model, event_id AS epoch, value AS loss FROM events), l AS (SELECT model, arg_max(loss, epoch) AS loss FROM h GROUP BY 1)
SELECT arg_min(model, (loss, model)) AS best, round(min(loss), 4) AS score, round(100 * (max(loss) FILTER (model = 0) - min(loss)) / max(loss) FILTER (model = 0), 3) AS improvement_percent FROM l""")
def sweep_summary(spark, d):
    history = events(spark, d).select((F.col("user_id") % 5).alias("model"), F.col("event_id").alias("epoch"), F.col("value").alias("loss"))
    got = evaluate.best(evaluate.last_losses(history, ["model"], "epoch", ["loss"]), "model", "loss", 0)
    return got.select("best", r("score").alias("score"), r("improvement_percent", 3).alias("improvement_percent"))


@query("""WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 3.6e9 AS h, value / 100 AS x FROM events),
w AS (SELECT x, coalesce(lead(x) OVER o, x) - coalesce(lag(x) OVER o, x) AS dv, coalesce(lead(h) OVER o, h) - coalesce(lag(h) OVER o, h) AS dh FROM t WINDOW o AS (PARTITION BY user_id ORDER BY h, event_id)),
d AS (SELECT x, CASE WHEN dh <> 0 THEN greatest(-10, least(10, dv / dh)) END AS y FROM w)
SELECT round(avg(1.0::DOUBLE), 6) AS g_0_0, round(avg(x), 6) AS g_0_1, round(avg(x * x), 6) AS g_0_2, round(avg(x * x), 6) AS g_1_1, round(avg(x * (x * x)), 6) AS g_1_2, round(avg((x * x) * (x * x)), 6) AS g_2_2,
 round(avg(y), 6) AS b_0_0, round(avg(x * y), 6) AS b_1_0, round(avg((x * x) * y), 6) AS b_2_0 FROM d WHERE y IS NOT NULL""")
def sindy_normal_equations(spark, d):
    from pluvia.operators.timeseries import derivative

    e = events(spark, d).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("h"), (F.col("value") / 100).alias("x"))
    e = derivative(e, ["user_id"], "h", ["x"], ("event_id",)).where("d_x IS NOT NULL").withColumn("d_x", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("d_x"))))
    got = discover.normal_equations(e, ["x"], ["d_x"], degree=2)
    return got.select(*[r(c, 6).alias(c) for c in got.columns])


@query("""WITH p AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 8.64e10 / 15 AS t, value / 10 AS h FROM events)
SELECT user_id, round(avg(pow(h - (1 + 10 * t - 4.9 * t * t), 2)), 5) AS data, round(avg(pow(h - (10 - 9.8 * t), 2)), 5) AS ode, round(pow(arg_min(h, t) - 1, 2), 6) AS start FROM p GROUP BY user_id""")
def physics_losses(spark, d):
    from pluvia.functions.expressions import projectile

    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 8.64e10 / 15
    p = events(spark, d).select("user_id", t.alias("t"), (F.col("value") / 10).alias("h")).withColumn("truth", projectile(F.col("t"), 1.0, 10.0, 9.8))
    return evaluate.physics_losses(p, ["user_id"], "t", "h", "h", "truth", 1.0, 10.0, 9.8).select("user_id", r("data", 5).alias("data"), r("ode", 5).alias("ode"), r("start", 6).alias("start"))


_LOSS = "SELECT {c}::INT AS complexity, greatest(0, var_pop(y) - pow(covar_pop({x}, y), 2) / var_pop({x})) AS loss FROM e"


@query("""WITH e AS (SELECT value / 100 AS x, value * value / 5000 + user_id / 100.0::DOUBLE AS y FROM events), a AS (SELECT 1 AS complexity, var_pop(y) AS loss FROM e
UNION ALL """ + " UNION ALL ".join(_LOSS.format(c=c, x=x) for c, x in ((3, "x"), (4, "x * x"), (4, "sin(x)"), (5, "x * x"), (5, "x + x"))) + ") SELECT complexity, round(loss, 6) AS loss FROM a")
def symbolic_search(spark, d):
    e = events(spark, d).select((F.col("value") / 100).alias("x"), (F.col("value") * F.col("value") / 5000 + F.col("user_id") / 100).alias("y"))
    return discover.symbolic_search(e, "y", ["x"], ["square", "sin"], ["*", "+"]).select("complexity", r("loss", 6).alias("loss"))


_GRAM = """t AS (SELECT user_id, event_id, epoch_us(ts) / 3.6e9 AS h, value / 100 AS x FROM events),
w AS (SELECT x, coalesce(lead(x) OVER o, x) - coalesce(lag(x) OVER o, x) AS dv, coalesce(lead(h) OVER o, h) - coalesce(lag(h) OVER o, h) AS dh FROM t WINDOW o AS (PARTITION BY user_id ORDER BY h, event_id)),
d AS (SELECT x, CASE WHEN dh <> 0 THEN greatest(-10, least(10, dv / dh)) END AS y FROM w),
g AS (SELECT 1.0::DOUBLE AS a, avg(x) AS b, avg(x * x) AS c, avg(x * x) AS e, avg(x * x * x) AS f, avg(x * x * x * x) AS i, avg(y) AS p, avg(x * y) AS q, avg(x * x * y) AS r FROM d WHERE y IS NOT NULL),
m AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM g)"""


@query(f"""WITH {_GRAM}, s AS (SELECT unnest([
 {{'feature': '1', 'coef': (p * (e * i - f * f) - b * (q * i - f * r) + c * (q * f - e * r)) / det}},
 {{'feature': 'x', 'coef': (a * (q * i - f * r) - p * (b * i - f * c) + c * (b * r - q * c)) / det}},
 {{'feature': 'x x', 'coef': (a * (e * r - q * f) - b * (b * r - q * c) + p * (b * f - e * c)) / det}}]) AS z FROM m)
SELECT 'd_x' AS target, z.feature AS feature, round(z.coef, 4) AS coef FROM s""")
def sindy_equations(spark, d):
    """Coefficients that sparse regression keeps for the change of a series, by term. Where none is below the threshold, as here, Cramer's rule has them too."""
    from pluvia.operators.timeseries import derivative

    e = events(spark, d).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("h"), (F.col("value") / 100).alias("x"))
    e = derivative(e, ["user_id"], "h", ["x"], ("event_id",)).where("d_x IS NOT NULL").withColumn("d_x", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("d_x"))))
    return discover.sparse_regression(e, ["x"], ["d_x"], degree=2, threshold=0.01).withColumn("coef", r("coef"))


@query()
def physics_sweep(spark, d):
    """A small network fitted to heights along a path for three weights of the law of motion; fitting is no SQL."""
    from pluvia.functions.expressions import projectile
    from pluvia.operators import physics

    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 8.64e10 / 15
    seen = events(spark, d).select(t.alias("t"), (projectile(t, 1.0, 10.0, 9.8) + (F.col("value") - 50) / 100).alias("h"))
    return physics.sweep(seen, [0.0, 1.0, 10.0], epochs=200)


_DRAWN = f"""i AS (SELECT unnest(range(20)) AS k), u AS (SELECT *, ('0x' || substr(md5('0:' || event_id || ':' || (k // 4)), (8 * (k % 4) + 1)::INT, 8))::BIGINT AS u FROM e, i),
p AS (SELECT *, k + 1 AS replicate, list_sum(list_transform({resampling.CUTS}, lambda c: (u >= c)::INT))::BIGINT AS w FROM u UNION ALL SELECT *, NULL, NULL, 0, 1 FROM e)"""


@query(f"""WITH e AS (SELECT event_id, user_id % 5 AS model, value - event_id % 100 AS d FROM events), {_DRAWN},
s AS (SELECT model, replicate, sum(w * d) / sum(w) AS bias, sum(w * abs(d)) / sum(w) AS mae, sqrt(sum(w * d * d) / sum(w)) AS rmse FROM p WHERE w > 0 GROUP BY ALL),
l AS (UNPIVOT s ON bias, mae, rmse INTO NAME statistic VALUE v)
SELECT model, statistic, round(max(v) FILTER (replicate = 0), 4) AS value, round(quantile_cont(v, 0.025) FILTER (replicate > 0), 4) AS low, round(quantile_cont(v, 0.975) FILTER (replicate > 0), 4) AS high FROM l GROUP BY ALL""")
def bootstrap_errors(spark, d):
    e = events(spark, d).select("event_id", (F.col("user_id") % 5).alias("model"), "value", (F.col("event_id") % 100).cast("double").alias("truth"))
    got = resampling.error_intervals(e, ["model"], "event_id", "value", "truth", 20)
    return got.select("model", "statistic", *[r(c).alias(c) for c in ("value", "low", "high")])


@query(f"""WITH e AS (SELECT event_id, value > 50 AS a, event_type IN ('click', 'view') AS b FROM events), {_DRAWN},
s AS (SELECT replicate, sum(w) AS n, coalesce(sum(w) FILTER (a AND b), 0) AS tp, coalesce(sum(w) FILTER (a AND NOT b), 0) AS fp, coalesce(sum(w) FILTER (NOT a AND b), 0) AS fn FROM p WHERE w > 0 GROUP BY ALL),
t AS (SELECT replicate, (n - fp - fn) / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM s), l AS (UNPIVOT t ON accuracy, precision, recall, f1 INTO NAME statistic VALUE v)
SELECT statistic, round(max(v) FILTER (replicate = 0), 5) AS value, round(quantile_cont(v, 0.025) FILTER (replicate > 0), 5) AS low, round(quantile_cont(v, 0.975) FILTER (replicate > 0), 5) AS high FROM l GROUP BY ALL""")
def bootstrap_confusion(spark, d):
    e = events(spark, d).select("event_id", (F.col("value") > 50).alias("a"), F.col("event_type").isin("click", "view").alias("b"))
    got = resampling.confusion_intervals(e, [], "event_id", "a", "b", 20)
    return got.select("statistic", *[r(c, 5).alias(c) for c in ("value", "low", "high")])


@query(f"""WITH e AS (SELECT event_id, value / 100 AS x, user_id / 100.0::DOUBLE AS y FROM events), {_DRAWN}
SELECT replicate::INT AS replicate, sum(w)::BIGINT AS n, round(sum(w * x), 3) AS g_0_1, round(sum(w * x * x), 3) AS g_1_1, round(sum(w * y), 3) AS b_0_0, round(sum(w * x * y), 3) AS b_1_0 FROM p GROUP BY replicate""")
def bootstrap_normal_equations(spark, d):
    e = events(spark, d).select("event_id", (F.col("value") / 100).alias("x"), (F.col("user_id") / 100).alias("y"))
    got = resampling.replicated(e, [], "event_id", resampling.moments(["x"], ["y"], 1), 20)
    return got.select("replicate", "n", *[r(c, 3).alias(c) for c in ("g_0_1", "g_1_1", "b_0_0", "b_1_0")])


@query("""WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 3.6e9 - 473352 AS h, value / 100 AS x FROM events),
n AS (SELECT *, (coalesce(lead(h) OVER o, h) - coalesce(lag(h) OVER o, h)) / 2 AS dt FROM t WINDOW o AS (PARTITION BY user_id ORDER BY h, event_id)),
w AS (SELECT *, unnest([floor(h / 24), floor(h / 24) - 1])::BIGINT AS k FROM n), s AS (SELECT *, (h - k * 24) / 24 - 1 AS s FROM w),
g AS (SELECT user_id, k, sum(dt * pow(1 - s * s, 4)) AS g0, sum(dt * pow(1 - s * s, 4) * x) AS g1, sum(dt * pow(1 - s * s, 4) * (x * x)) AS g2, sum(dt * 8 * s * pow(1 - s * s, 3) / 24 * x) AS b, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT user_id, min(h) AS lo, max(h) AS hi FROM t GROUP BY 1), c AS (SELECT g.* FROM g JOIN b USING (user_id) WHERE k * 24 >= lo AND k * 24 + 48 <= hi AND n >= 3)
SELECT round(avg(g0 * g0), 3) AS g_0_0, round(avg(g0 * g1), 3) AS g_0_1, round(avg(g0 * g2), 3) AS g_0_2, round(avg(g1 * g1), 3) AS g_1_1, round(avg(g1 * g2), 3) AS g_1_2, round(avg(g2 * g2), 3) AS g_2_2,
 round(avg(g0 * b), 3) AS b_0_0, round(avg(g1 * b), 3) AS b_1_0, round(avg(g2 * b), 3) AS b_2_0 FROM c""")
def weak_form_equations(spark, d):
    """Normal equations of integrals over windows of two days."""
    e = events(spark, d).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352).alias("h"), (F.col("value") / 100).alias("x"))
    got = discover.weak_normal_equations(discover.weak_windows(e, ["user_id"], "h", ["x"], 48.0, tie=("event_id",), least=3), 3, 1)
    return got.select(*[r(c, 3).alias(c) for c in got.columns])


@query("SELECT count(*) AS n, true AS found, true AS falling, round(var_pop(3.2::DOUBLE / pow(1 + value / 50, 2)), 6) AS spread FROM events")
def evolved_equation(spark, d):
    """An inverse square among all events: found says that the front's last loss is nothing against the target's variance, which is its first."""
    e = events(spark, d).select((1 + F.col("value") / 50).alias("x")).withColumn("y", 3.2 / (F.col("x") * F.col("x")))
    front = discover.evolved(e, "y", ["x"], ["square", "inv"], ["+", "*"], islands=2, size=20, generations=4)
    losses = front.agg(F.max("loss").alias("first"), F.min("loss").alias("last"), F.max_by("loss", "complexity").alias("end"))
    return e.agg(F.count(F.lit(1)).alias("n")).crossJoin(losses).select("n", (F.col("last") < 1e-9).alias("found"), (F.col("end") == F.col("last")).alias("falling"), r("first", 6).alias("spread"))  # one row each
