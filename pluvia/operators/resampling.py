"""Bootstrap without resampling: every row has a Poisson weight for each replicate, drawn from a hash, so all replicates are weighted sums of one pass."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.operators.discover import library, term_name, term_value

#: Numbers below 2 ** 32 from which on a Poisson variable of mean 1 is 1, 2, ... or more.
CUTS = [math.floor(sum(math.exp(-1) / math.factorial(k) for k in range(n)) * 2**32) for n in range(1, 13)]


def weights(ident: Column, replicates: int, seed: int = 0) -> Column:
    """An array: 1 for the sample itself, then the row's weight in each replicate. A digest of seed, identifier and a number serves four replicates."""
    digests = F.transform(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)), lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), ident.cast("string"), i.cast("string"))))

    def four(digest: Column) -> Column:
        numbers = F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])
        return F.transform(numbers, lambda u: sum((u >= c).cast("int") for c in CUTS))

    return F.concat(F.array(F.lit(1)), F.slice(F.flatten(F.transform(digests, four)), 1, replicates))


def replicated(df: DataFrame, keys: list[str], ident: str, terms: dict[str, Column], replicates: int = 200, seed: int = 0) -> DataFrame:
    """keys, replicate (0: the sample itself), n (sum of weights) and the weighted sum of each term, null ones left out.

    ident tells rows apart, so results don't depend on how rows are dealt. Sums are formed in parts: what moves is a row a key, replicate and task.
    """
    rows = df.select(*keys, *[c.cast("double").alias(f"__t_{n}") for n, c in terms.items()], F.posexplode(weights(F.col(ident), replicates, seed)).alias("replicate", "__w")).where("__w > 0")
    return rows.groupBy(*keys, "replicate").agg(F.sum("__w").alias("n"), *[F.sum(F.col("__w") * F.col(f"__t_{n}")).alias(n) for n in terms])


def intervals(sums: DataFrame, keys: list[str], statistics: dict[str, Column], level: float = 0.95) -> DataFrame:
    """keys, statistic, value (of the sample), low and high: percentiles over the replicates of columns made of replicated() sums."""
    rows = sums.select(*keys, "replicate", F.explode(F.create_map(*[x for n, c in statistics.items() for x in (F.lit(n), c.cast("double"))])).alias("statistic", "__s"))
    again = F.when(F.col("replicate") > 0, F.col("__s"))
    side = (1 - level) / 2
    return rows.groupBy(*keys, "statistic").agg(F.max(F.when(F.col("replicate") == 0, F.col("__s"))).alias("value"), F.percentile(again, side).alias("low"), F.percentile(again, 1 - side).alias("high"))


def error_intervals(df: DataFrame, keys: list[str], ident: str, estimate: str, truth: str, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Bias, MAE and RMSE with their intervals, over rows that have both values."""
    e = F.col(estimate) - F.col(truth)
    sums = replicated(df.where(e.isNotNull()), keys, ident, {"e": e, "a": F.abs(e), "s": e * e}, replicates, seed)
    n = F.col("n")
    return intervals(sums, keys, {"bias": F.col("e") / n, "mae": F.col("a") / n, "rmse": F.sqrt(F.col("s") / n)}, level)


def confusion_intervals(df: DataFrame, keys: list[str], ident: str, predicted: str, actual: str, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Accuracy, precision, recall and F1 with their intervals; undefined ones are 0."""
    p, a = F.col(predicted), F.col(actual)
    sums = replicated(df.where(p.isNotNull() & a.isNotNull()), keys, ident, {"tp": (p & a).cast("int"), "fp": (p & ~a).cast("int"), "fn": (~p & a).cast("int")}, replicates, seed)
    tp, fp, fn, n = map(F.col, ("tp", "fp", "fn", "n"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return intervals(sums, keys, {"accuracy": ratio(n - fp - fn, n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}, level)


def moments(names: list[str], targets: list[str], degree: int = 2) -> dict[str, Column]:
    """Terms of normal equations by name (g_i_j, b_i_k), as discover.normal_equations() has their means."""
    terms = [term_value(t) for t in library(names, degree)]
    out = {f"g_{i}_{j}": terms[i] * terms[j] for i in range(len(terms)) for j in range(i, len(terms))}
    return out | {f"b_{i}_{k}": t * F.col(y) for i, t in enumerate(terms) for k, y in enumerate(targets)}


def coefficient_intervals(df: DataFrame, ident: str, names: list[str], targets: list[str], degree: int = 2, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """target, feature, coef, low, high of least squares on monomials. The driver solves a system as wide as the library for each replicate; neither grows with the data."""
    terms = library(names, degree)
    rows = sorted(replicated(df, [], ident, moments(names, targets, degree), replicates, seed).collect(), key=lambda r: r["replicate"])
    n = len(terms)
    gram = np.array([[[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)] for r in rows], float)
    out = []
    for k, y in enumerate(targets):
        right = np.array([[r[f"b_{i}_{k}"] for i in range(n)] for r in rows], float)
        coefs = np.array([np.linalg.lstsq(g, b, rcond=None)[0] for g, b in zip(gram, right)])
        low, high = np.quantile(coefs[1:], [(1 - level) / 2, (1 + level) / 2], axis=0)
        out += [(y, term_name(t), *map(float, x)) for t, *x in zip(terms, coefs[0], low, high)]
    return df.sparkSession.createDataFrame(out, "target string, feature string, coef double, low double, high double")
