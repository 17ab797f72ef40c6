"""Equations from data: sparse regression of derivatives, and a search over enumerated expressions."""

from __future__ import annotations

import random
from collections.abc import Callable
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.expressions import BINARY, UNARY
from pluvia.operators import segments


#: Candidates of a search that one plan takes.
BATCH = 100


def library(names: list[str], degree: int = 2, bias: bool = True) -> list[tuple[str, ...]]:
    """Monomials up to the degree, each as the names that it multiplies; () is 1."""
    return [m for k in range(0 if bias else 1, degree + 1) for m in combinations_with_replacement(names, k)]


def term_name(term: tuple[str, ...]) -> str:
    return " ".join(term) or "1"


def term_value(term: tuple[str, ...]) -> Column:
    """The product, the last factors first, so that equal products are equal numbers."""
    out = F.lit(1.0)
    for i, n in enumerate(term):
        out = F.col(n) if i == 0 else out * F.col(n)
    return out


def features(names: list[str], degree: int = 2, bias: bool = True, fourier: int = 0, custom: dict[str, Column] | None = None) -> dict[str, Column]:
    """A general library by name: monomials, sines and cosines of the first `fourier` multiples of each variable, and one's own columns."""
    out = {term_name(t): term_value(t) for t in library(names, degree, bias)}
    for k in range(1, fourier + 1):
        out |= {f"{f}({k} {n})": g(F.lit(float(k)) * F.col(n)) for n in names for f, g in (("sin", F.sin), ("cos", F.cos))}
    return out | (custom or {})


def normal_equations(df: DataFrame, names: list[str], targets: list[str], degree: int = 2, bias: bool = True) -> DataFrame:
    """One row: g_i_j, the mean of term i times term j, and b_i_k, the mean of term i times target k. One pass, whatever the number of rows."""
    terms = library(names, degree, bias)
    sums = [F.avg(term_value(terms[i]) * term_value(terms[j]) if i else term_value(terms[j])).alias(f"g_{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]
    sums += [F.avg(term_value(t) * F.col(y) if t else F.col(y)).alias(f"b_{i}_{k}") for i, t in enumerate(terms) for k, y in enumerate(targets)]
    return df.agg(*sums)


def thresholded(gram: np.ndarray, right: np.ndarray, threshold: float, rounds: int = 10) -> np.ndarray:
    """Coefficients of normal equations by least squares in rounds: what is below the threshold leaves the library for the next one."""
    live, coef = np.ones(len(right), bool), np.zeros(len(right))
    for _ in range(rounds):
        coef = np.zeros(len(right))
        if live.any():
            coef[live] = np.linalg.lstsq(gram[np.ix_(live, live)], right[live], rcond=None)[0]
        keep = live & (np.abs(coef) >= threshold)
        if (keep == live).all():
            break
        live = keep
    coef[np.abs(coef) < threshold] = 0.0
    return coef


def _solved(row, terms: list[tuple[str, ...]], targets: list[str], threshold: float, rounds: int) -> list[tuple[str, str, float]]:
    n = len(terms)
    gram = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    right = [np.array([row[f"b_{i}_{k}"] for i in range(n)], float) for k in range(len(targets))]
    return [(y, term_name(t), float(c)) for y, b in zip(targets, right) for t, c in zip(terms, thresholded(gram, b, threshold, rounds))]


def sparse_regression(df: DataFrame, names: list[str], targets: list[str], degree: int = 2, threshold: float = 0.1, rounds: int = 10, bias: bool = True) -> DataFrame:
    """target, feature, coef by sequentially thresholded least squares.

    Spark makes the normal equations; the driver solves systems as wide as the library, which doesn't grow with the data.
    """
    out = _solved(normal_equations(df, names, targets, degree, bias).first(), library(names, degree, bias), targets, threshold, rounds)
    return df.sparkSession.createDataFrame(out, "target string, feature string, coef double")


def weak_windows(df: DataFrame, keys: list[str], t: str, names: list[str], width: float, degree: int = 2, power: int = 4, tie: tuple[str, ...] = (), least: int = 10, bias: bool = True) -> DataFrame:
    """Integrals of x' = f(x) against bumps (1 - s ** 2) ** power, instead of derivatives, which noise spoils: keys, window, n, g_i (of library term i) and b_k (of variable k's derivative, by parts).

    Windows of `width` (in units of the numeric time t) begin every half width; those that a series doesn't cover, or with fewer than `least` rows, are left out.
    A row counts as the half ways to its neighbours; it enters two windows, whose sums are formed in parts.
    """
    order, half = segments.order_of(t, tie), width / 2
    rows, w = segments.chunked(df, keys, t, tie, {"__past": (F.max_by(t, order), segments.last_before), "__next": (F.min_by(t, order), segments.first_after)}, 64 * width)
    at = F.col(t)
    span = (F.coalesce(F.lead(t).over(w), "__next", at) - F.coalesce(F.lag(t).over(w), "__past", at)) / 2
    rows = rows.withColumn("__dt", span).withColumn("window", F.explode(F.array(F.floor(at / half), F.floor(at / half) - 1)))
    s = (at - F.col("window") * half) / half - 1
    bump, slope = F.pow(1 - s * s, F.lit(float(power))), -2 * power * s * F.pow(1 - s * s, F.lit(float(power - 1))) / half
    rows = rows.withColumn("__bump", F.col("__dt") * bump).withColumn("__slope", -F.col("__dt") * slope)
    sums = [F.sum(F.col("__bump") * term_value(x)).alias(f"g_{i}") for i, x in enumerate(library(names, degree, bias))] + [F.sum(F.col("__slope") * F.col(x)).alias(f"b_{k}") for k, x in enumerate(names)]
    found = rows.groupBy("__k", "window").agg(F.count(F.lit(1)).alias("n"), *sums)
    bounds = df.withColumn("__k", segments.key_of(keys)).groupBy("__k").agg(F.min(t).alias("__from"), F.max(t).alias("__to"))
    covered = (F.col("window") * half >= F.col("__from")) & (F.col("window") * half + width <= F.col("__to")) & (F.col("n") >= least)
    return found.join(bounds, "__k").where(covered).select(*[F.col("__k")[k].alias(k) for k in keys], *found.columns[1:])


def weak_normal_equations(windows: DataFrame, n_terms: int, n_targets: int) -> DataFrame:
    """One row of means over windows: g_i_j and b_i_k, as normal_equations() has them over rows."""
    g, b = [F.col(f"g_{i}") for i in range(n_terms)], [F.col(f"b_{k}") for k in range(n_targets)]
    sums = [F.avg(g[i] * g[j]).alias(f"g_{i}_{j}") for i in range(n_terms) for j in range(i, n_terms)]
    return windows.agg(*sums, *[F.avg(x * y).alias(f"b_{i}_{k}") for i, x in enumerate(g) for k, y in enumerate(b)])


def weak_regression(df: DataFrame, keys: list[str], t: str, names: list[str], width: float, degree: int = 2, threshold: float = 0.1, rounds: int = 10, tie: tuple[str, ...] = (), bias: bool = True) -> DataFrame:
    """target (d_<name>), feature, coef: sparse regression on weak_windows(), for series with noise."""
    terms = library(names, degree, bias)
    row = weak_normal_equations(weak_windows(df, keys, t, names, width, degree, tie=tie, bias=bias), len(terms), len(names)).first()
    return df.sparkSession.createDataFrame(_solved(row, terms, [f"d_{n}" for n in names], threshold, rounds), "target string, feature string, coef double")


def equations(coefs: DataFrame) -> DataFrame:
    """target, equation as text; terms in the order of their names."""
    live = coefs.where("coef <> 0").groupBy("target").agg(F.array_sort(F.collect_list(F.struct("feature", "coef"))).alias("t"))
    return live.select("target", F.array_join(F.transform("t", lambda t: F.concat(F.format_number(t["coef"], 3), F.lit(" "), t["feature"])), " + ").alias("equation"))


def integrate(rhs: Callable[[np.ndarray], np.ndarray], start: list[float], times: np.ndarray, steps: int = 4) -> np.ndarray:
    """Classical Runge-Kutta of fourth order with `steps` equal steps between two times."""
    out = [np.array(start, float)]
    for a, b in zip(times[:-1], times[1:]):
        x, h = out[-1], (b - a) / steps
        for _ in range(steps):
            k1 = rhs(x)
            k2 = rhs(x + h / 2 * k1)
            k3 = rhs(x + h / 2 * k2)
            k4 = rhs(x + h * k3)
            x = x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        out.append(x)
    return np.array(out)


def lorenz_trajectories(spark: SparkSession, starts: DataFrame, t_end: float = 10.0, n: int = 1000) -> DataFrame:
    """starts: id, x, y, z -> id, t, x, y, z; one trajectory a start, spread over the cluster."""

    def run(batches):
        import pandas as pd

        times = np.linspace(0, t_end, n)
        for b in batches:
            for r in b.itertuples(index=False):
                xyz = integrate(lambda s: np.array([10 * (s[1] - s[0]), s[0] * (28 - s[2]) - s[1], s[0] * s[1] - 8 / 3 * s[2]]), [r.x, r.y, r.z], times)
                yield pd.DataFrame({"id": r.id, "t": times, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return starts.select(F.col("id").cast("long"), *[F.col(c).cast("double") for c in "xyz"]).mapInPandas(run, "id long, t double, x double, y double, z double")


def simulate(coefs: DataFrame, names: list[str], start: list[float], times: np.ndarray) -> np.ndarray:
    """A trajectory of the equations found; targets are d_<name>."""
    table = {(r["target"], r["feature"]): r["coef"] for r in coefs.where("coef <> 0").collect()}  # as wide as the library
    terms = library(names)

    def rhs(s):
        at = dict(zip(names, s))
        values = [float(np.prod([at[n] for n in t])) for t in terms]
        return np.array([sum(table.get((f"d_{n}", term_name(t)), 0.0) * v for t, v in zip(terms, values)) for n in names])

    return integrate(rhs, start, times)


def candidates(names: list[str], unary: list[str], binary: list[str], depth: int = 2) -> dict[str, tuple[int, Column]]:
    """Expression text -> (complexity, Column), enumerated level by level; a bounded list that doesn't depend on the data."""
    level = {n: (1, F.col(n).cast("double")) for n in names}
    every = dict(level)
    for _ in range(depth):
        new = {f"{u}({e})": (c + 1, UNARY[u](x)) for e, (c, x) in level.items() for u in unary}
        for e1, (c1, x1) in every.items():
            for e2, (c2, x2) in level.items():
                new |= {f"({e1} {b} {e2})": (c1 + c2 + 1, BINARY[b](x1, x2)) for b in binary}
        level = {e: v for e, v in new.items() if e not in every}
        every |= level
    return every


def symbolic_search(df: DataFrame, target: str, names: list[str], unary: list[str], binary: list[str], depth: int = 1) -> DataFrame:
    """complexity, loss, equation: for each candidate f the least squares a + b f of the target, in a pass over the data for each BATCH candidates.

    Another search than an evolutionary one: candidates are enumerated, and only offset and scale are fitted.
    """
    made = candidates(names, unary, binary, depth)
    fits = scaled_fits(df, target, {text: x for text, (_, x) in made.items()})
    out = [(1, fits[""][0], f"{fits[''][1]:.6g}")]
    out += [(made[text][0] + 2, loss, f"{a:.6g} + {b:.6g} * {text}") for text, (loss, a, b) in fits.items() if text]
    return df.sparkSession.createDataFrame(out, "complexity int, loss double, equation string")


def scaled_fits(df: DataFrame, target: str, columns: dict[str, Column]) -> dict[str, tuple[float, float, float]]:
    """(loss, a, b) of the least squares a + b f of the target for each column f, in a pass over the data for each BATCH of them; "" is the mean alone. Columns that aren't
    known and finite on every row, or are constant, are left out."""
    found = list(columns.items())
    y = F.col(target).cast("double")
    row = df.agg(F.avg(y).alias("my"), F.avg(y * y).alias("sy"), F.count(y).alias("n")).first().asDict()
    for at in range(0, len(found), BATCH):
        stats = []
        for i, (_, x) in list(enumerate(found))[at : at + BATCH]:
            stats += [F.avg(x).alias(f"m{i}"), F.avg(x * x).alias(f"s{i}"), F.avg(x * y).alias(f"c{i}"), F.count(x).alias(f"n{i}")]
        row |= df.agg(*stats).first().asDict()
    total = row["sy"] - row["my"] ** 2
    out = {"": (float(total), float(row["my"]), 0.0)}
    for i, (text, _) in enumerate(found):
        if row[f"n{i}"] != row["n"] or row[f"s{i}"] is None or not np.isfinite(row[f"s{i}"]):
            continue
        var, cov = row[f"s{i}"] - row[f"m{i}"] ** 2, row[f"c{i}"] - row[f"m{i}"] * row["my"]
        if var > 1e-12:
            b = cov / var
            out[text] = (float(max(0.0, total - b * cov)), float(row["my"] - b * row[f"m{i}"]), float(b))
    return out


# An expression is a tree: a name, or (operator, argument) or (operator, left, right).
Tree = str | tuple


def nodes(tree: Tree) -> int:
    return 1 if isinstance(tree, str) else 1 + sum(map(nodes, tree[1:]))


def written_out(tree: Tree) -> str:
    if isinstance(tree, str):
        return tree
    return f"{tree[0]}({written_out(tree[1])})" if len(tree) == 2 else f"({written_out(tree[1])} {tree[0]} {written_out(tree[2])})"


def as_column(tree: Tree) -> Column:
    if isinstance(tree, str):
        return F.col(tree).cast("double")
    return (UNARY[tree[0]] if len(tree) == 2 else BINARY[tree[0]])(*map(as_column, tree[1:])).cast("double")


def within_limits(tree: Tree, nested: dict[str, dict[str, int]]) -> bool:
    """nested: operator -> how often another one may stand inside it, one inside the other."""

    def deepest(t: Tree, op: str) -> int:
        return 0 if isinstance(t, str) else max(deepest(x, op) for x in t[1:]) + (t[0] == op)

    if isinstance(tree, str):
        return True
    own = all(max(deepest(x, op) for x in tree[1:]) <= most for op, most in nested.get(tree[0], {}).items())
    return own and all(within_limits(x, nested) for x in tree[1:])


def evolved(df: DataFrame, target: str, names: list[str], unary: list[str], binary: list[str], islands: int = 4, size: int = 30, generations: int = 10, largest: int = 9, seed: int = 0, nested: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """complexity, loss, equation: the front that an evolutionary search finds, losses falling with complexity (nodes of the tree, and 2 for offset and scale).

    Populations of trees live on islands; each generation takes parents by tournament, swaps or changes subtrees, and sends an island's best to the next one. A generation's new trees are scored together, in a
    pass over the data for each BATCH of them; the driver holds islands * size trees, whatever the data. The same seed gives the same front.
    """
    r = random.Random(seed)
    nested = nested or {}
    known: dict[str, tuple[float, float, float]] = {}
    trees: dict[str, Tree] = {}

    def grown(depth: int) -> Tree:
        if depth == 0 or r.random() < 0.2:
            return r.choice(names)
        op = r.choice([*unary, *binary])
        return (op, *(grown(depth - 1) for _ in range(1 if op in unary else 2)))

    def places(tree: Tree, at: tuple = ()) -> list[tuple]:
        return [at] if isinstance(tree, str) else [at, *(p for i, x in enumerate(tree[1:], 1) for p in places(x, (*at, i)))]

    def part(tree: Tree, at: tuple) -> Tree:
        return part(tree[at[0]], at[1:]) if at else tree

    def put(tree: Tree, at: tuple, new: Tree) -> Tree:
        return (*tree[: at[0]], put(tree[at[0]], at[1:], new), *tree[at[0] + 1 :]) if at else new

    def score(some: list[Tree]) -> None:
        fresh = {written_out(t): t for t in some if written_out(t) not in known}
        fits = scaled_fits(df, target, {k: as_column(t) for k, t in fresh.items()})
        known.update({k: fits.get(k, (float("inf"), 0.0, 0.0)) for k in ("", *fresh)})
        trees.update(fresh)

    def loss(tree: Tree) -> tuple[float, int]:
        return known[written_out(tree)][0], nodes(tree)

    def child(population: list[Tree]) -> Tree:
        for _ in range(20):
            mother = min(r.sample(population, min(3, len(population))), key=loss)
            at = r.choice(places(mother))
            new = grown(2) if r.random() < 0.5 else part(father := min(r.sample(population, min(3, len(population))), key=loss), r.choice(places(father)))
            made = put(mother, at, new)
            if nodes(made) <= largest and within_limits(made, nested):
                return made
        return r.choice(names)

    def first() -> Tree:
        for _ in range(20):
            made = grown(2)
            if nodes(made) <= largest and within_limits(made, nested):
                return made
        return r.choice(names)

    worlds = [[first() for _ in range(size)] for _ in range(islands)]
    score([t for w in worlds for t in w])
    for _ in range(generations):
        young = [[child(w) for _ in range(size)] for w in worlds]
        score([t for w in young for t in w])
        worlds = [list({written_out(t): t for t in sorted(old + new, key=lambda t: (*loss(t), written_out(t)))}.values())[:size] for old, new in zip(worlds, young)]
        best = [w[0] for w in worlds]
        worlds = [[*w, best[i - 1]] for i, w in enumerate(worlds)]
    out = [(1, known[""][0], f"{known[''][1]:.6g}")]
    for text, tree in sorted(trees.items(), key=lambda x: (nodes(x[1]), known[x[0]][0], x[0])):
        value, a, b = known[text]
        if out[-1][1] <= 1e-12 * out[0][1]:  # what is left is rounding
            break
        if value < out[-1][1] and nodes(tree) + 2 > out[-1][0]:
            out.append((nodes(tree) + 2, value, f"{a:.6g} + {b:.6g} * {text}"))
    return df.sparkSession.createDataFrame(out, "complexity int, loss double, equation string")
