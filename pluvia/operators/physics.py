"""A small network of height against time, with or without the law of motion in its loss; one task a setting."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTORY = "lambda_ode double, epoch int, total double, data double, ode double, start double, rmse double"


class Net:
    """1 - hidden ... - 1 with tanh; forward() gives the value and its derivative in time, backward() the gradients of both."""

    def __init__(self, hidden: tuple[int, ...], seed: int):
        r = np.random.default_rng(seed)
        sizes = [1, *hidden, 1]
        self.w = [r.standard_normal((a, b)) * np.sqrt(1 / a) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def forward(self, t: np.ndarray):
        a, da = t[:, None], np.ones((len(t), 1))
        kept = []
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            kept.append((a, da))
            z, dz = a @ w + b, da @ w
            if i == len(self.w) - 1:
                return z[:, 0], dz[:, 0], kept
            a = np.tanh(z)
            da = (1 - a * a) * dz
            kept[-1] += (a, dz)

    def backward(self, kept, g: np.ndarray, dg: np.ndarray):
        g, dg = g[:, None], dg[:, None]
        out = []
        for i in reversed(range(len(self.w))):
            if i < len(self.w) - 1:
                _, _, a, dz = kept[i]
                slope = 1 - a * a
                g, dg = (g - 2 * dg * a * dz) * slope, dg * slope
            a, da = kept[i][:2]
            out.append((a.T @ g + da.T @ dg, g.sum(0)))
            g, dg = g @ self.w[i].T, dg @ self.w[i].T
        return out[::-1]


def train(t: np.ndarray, h: np.ndarray, lambda_ode: float, h0: float, v0: float, g: float, t_max: float, hidden=(20, 20), epochs: int = 2500, rate: float = 0.01, data: float = 1.0, start: float = 1.0, points: int = 50, seed: int = 0, weight: np.ndarray | None = None, spread: float = 0.0):
    """weight: how many observations each (t, h) stands for, spread: the mean square within them. The network and its history of (epoch, total, data, ode, start); Adam over data * mse + lambda_ode * mean (h' - v0 + g t)² + start * (h(0) - h0)²."""
    net, at = Net(hidden, seed), np.linspace(0, t_max, points)
    every = np.concatenate([t, at, [0.0]])
    w = np.ones(len(t)) if weight is None else weight
    n, total, moments, history = len(t), w.sum(), [[np.zeros_like(p), np.zeros_like(p)] for w, b in zip(net.w, net.b) for p in (w, b)], []
    for epoch in range(1, epochs + 1):
        y, dy, kept = net.forward(every)
        e, f, s = y[:n] - h, dy[n:-1] - (v0 - g * at), y[-1] - h0
        losses = float(w @ (e * e) / total + spread), float(np.mean(f * f)), float(s * s)
        gy, gd = np.zeros(len(every)), np.zeros(len(every))
        gy[:n], gy[-1] = 2 * data * w * e / total, 2 * start * s * (lambda_ode > 0)
        gd[n:-1] = 2 * lambda_ode * f / points
        grads = [p for pair in net.backward(kept, gy, gd) for p in pair]
        for k, (p, d) in enumerate(zip([p for pair in zip(net.w, net.b) for p in pair], grads)):
            m, v = moments[k]
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        if epoch % 100 == 0 or epoch == epochs:
            history.append((epoch, data * losses[0] + lambda_ode * losses[1] + start * losses[2] * (lambda_ode > 0), *losses))
    return net, history


def sweep(observations: DataFrame, lambdas: list[float], h0: float = 1.0, v0: float = 10.0, g: float = 9.8, t_max: float = 2.0, cells: int = 4096, **how) -> DataFrame:
    """observations (t, h): a history for each weight of the law of motion (0: none), with the RMSE against the exact path on 200 points.

    All observations count: they are summed up by cells of t_max / cells first (mean time, mean height, number, spread), so that a setting, which
    is a task, takes `cells` rows however many there are. Rows without a time or height are left out; times outside [0, t_max] fall into the cells at its ends.
    """

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        n = rows.n.to_numpy(float)
        net, history = train(rows.t.to_numpy(), rows.h.to_numpy(), float(key[0]), h0, v0, g, t_max, weight=n, spread=float(n @ rows.spread.to_numpy() / n.sum()), **how)
        at = np.linspace(0, t_max, 200)
        rmse = float(np.sqrt(np.mean((net.forward(at)[0] - (h0 + v0 * at - 0.5 * g * at * at)) ** 2)))
        return pd.DataFrame([(float(key[0]), *x, rmse) for x in history], columns=[c.split()[0] for c in HISTORY.split(", ")])

    cell = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(F.col("t") * cells / t_max)))
    known = observations.select(F.col("t").cast("double"), F.col("h").cast("double")).where("t IS NOT NULL AND h IS NOT NULL")
    summed = known.groupBy(cell.alias("cell")).agg(F.avg("t").alias("t"), F.avg("h").alias("h"), F.count(F.lit(1)).alias("n"), F.var_pop("h").alias("spread"))
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks needn't have this package
    each = summed.drop("cell").withColumn("lambda_ode", F.explode(F.array(*[F.lit(float(x)) for x in lambdas])))
    return each.groupBy("lambda_ode").applyInPandas(fit, HISTORY)
