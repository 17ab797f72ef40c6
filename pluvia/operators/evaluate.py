"""Scores of estimates, weighted losses, fronts of equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def errors(df: DataFrame, keys: list[str], estimate: str, truth: str) -> DataFrame:
    """n, bias, mae, mse, rmse over rows that have both."""
    e = F.col(estimate) - F.col(truth)
    return df.groupBy(*keys).agg(F.count(e).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"))


def confusion(df: DataFrame, keys: list[str], predicted: str, actual: str) -> DataFrame:
    """Cells of two booleans, accuracy, precision, recall and F1 (0 where undefined)."""
    p, a = F.col(predicted), F.col(actual)
    got = df.where(p.isNotNull() & a.isNotNull()).groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return got.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def detection(predicted: Column, actual: Column) -> Column:
    """hit, miss, false alarm or correct rejection."""
    return F.when(predicted & actual, "hit").when(~predicted & actual, "miss").when(predicted & ~actual, "false alarm").when(~predicted & ~actual, "correct rejection")


def by_interval(df: DataFrame, estimate: str, truth: str, n_bins: int = 5) -> DataFrame:
    """Errors in equal intervals of the truth from 0 to its largest value."""
    top = F.broadcast(df.agg(F.max(truth).alias("top"), F.lit(1).alias("one")))  # one row
    at = F.least(F.lit(n_bins), F.floor(F.coalesce(F.try_divide(F.col(truth) * n_bins, F.col("top")), F.lit(0.0))) + 1).cast("int")
    rows = df.where(F.col(truth) >= 0).withColumn("one", F.lit(1)).join(top, "one").withColumn("interval", at)
    return errors(rows, ["interval"], estimate, truth)


def weighted_loss(df: DataFrame, step: str, estimate: str, truth: str, gamma: float, gamma_s: float) -> DataFrame:
    """Sum over steps of the mean over a step's rows of w * error ** 2, w = 1 - gamma_s * exp(-gamma * truth)."""
    e = F.col(estimate) - F.col(truth)
    w = 1 - F.lit(gamma_s) * F.exp(-F.lit(gamma) * F.col(truth))
    return df.groupBy(step).agg(F.avg(w * e * e).alias("l")).agg(F.sum("l").alias("loss"))


def cross_entropy(probability: Column, label: Column) -> Column:
    """Mean of the binary cross entropy; logarithms stop at -100."""
    log = lambda x: F.greatest(F.when(x > 0, F.log(x)).otherwise(-100.0), F.lit(-100.0))
    return F.avg(-(label * log(probability) + (1 - label) * log(1 - probability)))


def physics_losses(df: DataFrame, keys: list[str], t: str, h: str, rate: str, truth: str, h0: float, v0: float, g: float) -> DataFrame:
    """data, ode and start losses of predicted trajectories against h' = v0 - g t and h(0) = h0."""
    return df.groupBy(*keys).agg(
        F.avg(F.pow(F.col(h) - F.col(truth), 2)).alias("data"), F.avg(F.pow(F.col(rate) - (F.lit(v0) - F.lit(g) * F.col(t)), 2)).alias("ode"), F.pow(F.min_by(h, t) - F.lit(h0), 2).alias("start")
    )


def epoch_means(history: DataFrame, keys: list[str], epoch: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric over an epoch's steps, and their number."""
    return history.groupBy(*keys, epoch).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("steps"))


def expression_loss(df: DataFrame, keys: list[str], loss: str) -> DataFrame:
    """Mean of a loss that is given as a SQL expression of the row's columns."""
    return df.groupBy(*keys).agg(F.avg(F.expr(loss)).alias("loss"))


def last_losses(history: DataFrame, keys: list[str], epoch: str, losses: list[str]) -> DataFrame:
    """Losses of each model's last epoch."""
    return history.groupBy(*keys).agg(*[F.max_by(c, epoch).alias(c) for c in losses])


def best(models: DataFrame, model: str, score: str, base: str) -> DataFrame:
    """The model with the least score (the smaller name of ties) and by how many percent it is below the base model's."""
    base_score = F.max(F.when(F.col(model) == base, F.col(score)))
    return models.agg(F.min_by(model, F.struct(score, model)).alias("best"), F.min(score).alias("score"), F.try_divide(100 * (base_score - F.min(score)), base_score).alias("improvement_percent"))


def predict(df: DataFrame, equations: dict[str, str]) -> DataFrame:
    """A column for each equation (several outputs at once), given as SQL expressions of the row's columns."""
    return df.withColumns({name: F.expr(text).cast("double") for name, text in equations.items()})


def pareto(equations: DataFrame, complexity: str, loss: str, tie: list[str]) -> DataFrame:
    """Equations with a smaller loss than all simpler ones. Only the best of each complexity is compared, so the window is over a few rows."""
    rest = [c for c in equations.columns if c != complexity]
    first = equations.groupBy(complexity).agg(F.min_by(F.struct(*rest), F.struct(loss, *tie)).alias("r")).select(complexity, "r.*")
    simpler = F.min(loss).over(Window.orderBy(complexity).rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("__s", simpler).where(F.col("__s").isNull() | (F.col(loss) < F.col("__s"))).drop("__s")
