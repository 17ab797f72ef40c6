"""Known answers of the equation search."""

import numpy as np
from pyspark.sql import functions as F

from pluvia.operators import discover
from pluvia.operators.timeseries import derivative


def test_lorenz_is_found(spark):
    starts = spark.createDataFrame([(1, -8.0, 7.0, 27.0)], "id long, x double, y double, z double")
    path = derivative(discover.lorenz_trajectories(spark, starts, 10.0, 1000), ["id"], "t", ["x", "y", "z"]).where("t <= 7.0")
    got = discover.sparse_regression(path, ["x", "y", "z"], ["d_x", "d_y", "d_z"])
    coefs = {(r.target, r.feature): r.coef for r in got.where("coef <> 0").collect()}
    want = {("d_x", "x"): -10, ("d_x", "y"): 10, ("d_y", "x"): 28, ("d_y", "y"): -1, ("d_y", "x z"): -1, ("d_z", "z"): -8 / 3, ("d_z", "x y"): 1}
    assert set(coefs) == set(want)
    assert all(abs(coefs[k] / v - 1) < 0.05 for k, v in want.items())
    assert discover.equations(got).count() == 3
    again = discover.simulate(got, ["x", "y", "z"], [-8.0, 7.0, 27.0], np.linspace(0, 0.5, 50))
    true = [r for r in path.where("t <= 0.5").orderBy("t").collect()]
    assert abs(again[-1][0] - true[-1].x) < 3


def test_symbolic_search_finds_the_form(spark):
    df = spark.range(400).select(((F.col("id") - 200) / 40).alias("x")).withColumn("y", 3 * F.col("x") * F.col("x") + 1)
    best = discover.symbolic_search(df, "y", ["x"], ["sin", "exp", "square"], ["+", "*"]).orderBy("loss", "complexity").first()
    assert best.loss < 1e-6 and ("square(x)" in best.equation or "(x * x)" in best.equation)


def test_physics_gradients():
    from pluvia.operators.physics import Net

    net, r = Net((5, 4), 1), np.random.default_rng(2)
    t, c, d = r.random(7), r.standard_normal(7), r.standard_normal(7)
    _, _, kept = net.forward(t)
    grads = net.backward(kept, c, d)

    def value():
        y, dy, _ = net.forward(t)
        return float(c @ y + d @ dy)

    for k, (w, b) in enumerate(zip(net.w, net.b)):
        for p, got in ((w, grads[k][0]), (b, grads[k][1])):
            i = tuple(int(r.integers(0, s)) for s in p.shape)
            kept_p = p[i]
            p[i] = kept_p + 1e-6
            up = value()
            p[i] = kept_p - 1e-6
            down = value()
            p[i] = kept_p
            assert abs((up - down) / 2e-6 - got[i]) < 1e-6


def test_the_law_of_motion_helps(spark):
    from pluvia.operators import evaluate, physics
    from pluvia.sources.generate import noisy_projectile

    history = physics.sweep(noisy_projectile(spark, 20, sd=0.75, seed=3), [0.0, 1.5], epochs=1200).cache()
    assert history.count() == 24
    last = {r.lambda_ode: r for r in evaluate.last_losses(history, ["lambda_ode"], "epoch", ["rmse", "ode"]).collect()}
    assert last[1.5].rmse < last[0.0].rmse and last[1.5].ode < last[0.0].ode


def test_weak_form_finds_lorenz_in_noise(spark):
    """Integrals against bumps find the coefficients where derivatives of noisy points don't."""
    r = np.random.default_rng(4)
    starts = spark.createDataFrame([(i, *map(float, r.normal(0, 8, 2)), float(r.uniform(15, 30))) for i in range(6)], "id long, x double, y double, z double")
    clean = discover.lorenz_trajectories(spark, starts, 10.0, 2000)
    names = ["x", "y", "z"]
    noisy = spark.createDataFrame([(row.id, row.t, *(row[n] + r.normal(0, 0.2) for n in names)) for row in clean.orderBy("id", "t").collect()], "id long, t double, x double, y double, z double").cache()
    want = {("d_x", "x"): -10, ("d_x", "y"): 10, ("d_y", "x"): 28, ("d_y", "y"): -1, ("d_y", "x z"): -1, ("d_z", "z"): -8 / 3, ("d_z", "x y"): 1}
    found = {(c.target, c.feature): c.coef for c in discover.weak_regression(noisy, ["id"], "t", names, 0.5, threshold=0.4).where("coef <> 0").collect()}
    assert set(found) == set(want) and all(abs(found[k] / v - 1) < 0.05 for k, v in want.items())
    plain = discover.sparse_regression(derivative(noisy, ["id"], "t", names), names, ["d_x", "d_y", "d_z"], threshold=0.4).where("coef <> 0").collect()
    assert max(abs(dict(((c.target, c.feature), c.coef) for c in plain).get(k, 0) / v - 1) for k, v in want.items()) > 0.05
    assert discover.weak_windows(noisy.limit(0), ["id"], "t", names, 0.5).count() == 0


def test_bootstrap(spark):
    """Weights have the moments of a Poisson variable; intervals cover what they are to cover; rows may be dealt in any way."""
    from pluvia.operators import resampling

    r = np.random.default_rng(1)
    rows = [(i, i % 2, float(x), float(3 + 2 * x + r.normal(0, 1)), float(r.normal(0.5, 1))) for i, x in enumerate(r.normal(0, 1, 1500))]
    df = spark.createDataFrame(rows, "id long, k int, x double, y double, e double").withColumn("zero", F.lit(0.0))
    w = np.array([x.w for x in df.select(resampling.weights(F.col("id"), 40).alias("w")).collect()])
    assert w.shape == (1500, 41) and (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.02 and abs(w[:, 1:].var() - 1) < 0.03
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.1
    got = {(x.k, x.statistic): (x.value, x.low, x.high) for x in resampling.error_intervals(df, ["k"], "id", "e", "zero", 200).collect()}
    for k in (0, 1):
        e = np.array([x[4] for x in rows if x[1] == k])
        value, low, high = got[k, "bias"]
        assert value == np.float64(value) and abs(value - e.mean()) < 1e-9 and low < value < high
        assert abs((high - low) / (2 * 1.96 * e.std() / np.sqrt(len(e))) - 1) < 0.25
    again = {(x.k, x.statistic): x.low for x in resampling.error_intervals(df.repartition(7), ["k"], "id", "e", "zero", 200).collect()}
    assert all(abs(again[k] - v[1]) < 1e-9 for k, v in got.items())
    coefs = {c.feature: c for c in resampling.coefficient_intervals(df, "id", ["x"], ["y"], 1, 100).collect()}
    assert coefs["1"].low < 3 < coefs["1"].high and coefs["x"].low < 2 < coefs["x"].high and coefs["x"].high - coefs["x"].low < 0.2
    assert resampling.error_intervals(df.limit(0), ["k"], "id", "e", "zero", 10).count() == 0


def test_evolution_finds_an_inverse_square(spark):
    df = spark.range(300).select((1 + F.col("id") / 100).alias("x"), (F.col("id") % 7).cast("double").alias("other")).withColumn("y", 2.5 / (F.col("x") * F.col("x")) + 1).cache()
    names, unary, binary = ["x", "other"], ["square", "inv", "exp"], ["+", "*"]
    front = discover.evolved(df, "y", names, unary, binary, islands=3, size=20, generations=6, seed=1).collect()
    assert front[-1].loss < 1e-9 and front[-1].complexity <= 6
    assert all(a.loss > b.loss and a.complexity < b.complexity for a, b in zip(front, front[1:])) and front[0].complexity == 1
    assert [tuple(r) for r in front] == [tuple(r) for r in discover.evolved(df, "y", names, unary, binary, islands=3, size=20, generations=6, seed=1).collect()]
    limited = discover.evolved(df, "y", names, unary, binary, islands=2, size=15, generations=3, nested={"inv": {"square": 0, "inv": 0}, "square": {"inv": 0}}).collect()
    assert not any("inv(square" in r.equation or "square(inv" in r.equation for r in limited)


def test_limits_of_nesting():
    tree = ("sin", ("+", "x", ("cos", ("sin", "x"))))
    assert discover.within_limits(tree, {"sin": {"sin": 1}}) and not discover.within_limits(tree, {"sin": {"sin": 0}}) and not discover.within_limits(tree, {"sin": {"cos": 0}})
    assert discover.within_limits(tree, {"cos": {"cos": 0}}) and discover.nodes(tree) == 6 and discover.written_out(tree) == "sin((x + cos(sin(x))))"
