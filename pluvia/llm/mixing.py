"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.common import checkpoint, n_words

#: Rows before the cut are told apart in steps of this part of a source's target.
STEPS = 4096
#: Buckets of the shuffled order, for running sums without one large window.
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget_share: float, max_repeats: int) -> DataFrame:
    """source, source_size -> source, source_size, weight, target. One row per source: small beside the documents.

    Sources by code point, null last, get the weights in turn. They share budget_share of all sizes by weight;
    a target stops at max_repeats times its source's size and the excess is shared again by weight.
    With level L, the target is min(cap, L * weight); sources ordered by cap / weight fill up one after the other.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("double"))
    capped = ranked.withColumn("cap", (F.col("source_size") * max_repeats).cast("double")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(budget_share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = capped.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "rank", "level"))).over(every)["level"]
    return found.withColumn("target", F.when(fits.isNull(), F.col("cap")).otherwise(F.least("cap", fits * F.col("weight")))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget_share: float = 1.5, max_repeats: int = 2, seed: str = "mix", size: Column | None = None, apart: Column | None = None) -> DataFrame:
    """How often each document enters a mix that comes near its sources' targets.

    Documents of a source are shuffled by a digest of seed and identifier, so reruns agree. The n-th pass over a source
    follows the one before. A document's virtual finish time is its source's cumulative words divided by the source's
    target; the mix takes documents in the order of that time until the total budget is full (a document
    is in if at least half of it fits). Whole documents only, at most max_repeats times each.

    Running sums go by bucket first and within a bucket then, so that a source with a third of all rows meets no
    single window. The cut is found on sums of 1/4096 steps of the virtual time; only rows in that step are ordered.

    A null text has size 0; a null source is a source of its own, the last. Repeated rows count as documents of
    their own; an empty table gives no rows; other columns are ignored. Documents of size 0 enter as often as the time at which they stand says, with 0 words.
    apart: tells rows of one identifier apart (a digest of their text); without it rows of equal identifier, source and size are one another's like.
    Returns doc_id, source, size, source_size, target, copies, taken, with as many rows as documents; with apart, that and nth too: 1, 2, ... of rows that are alike in all of these.
    """
    told = F.lit("") if apart is None else apart
    read = docs.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size"), told.alias("apart"))
    same = read.groupBy("doc_id", "source", "size", "apart").agg(F.count(F.lit(1)).alias("n"))
    rows = same.select("doc_id", "source", "size", "apart", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    rows = rows.withColumn("key", key).withColumn("bucket", (F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % BUCKETS))
    rows = checkpoint(rows)

    per = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(per.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget_share, max_repeats)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "before")
    targets = targets.withColumnRenamed("source", "t_source")
    per = per.join(targets, F.col("b_source").eqNullSafe(F.col("t_source"))).drop("t_source", "weight")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "apart", "copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("inside", F.sum("size").over(within))
        .join(per, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .select("doc_id", "source", "size", "apart", "copy", "key", "source_size", "target", (F.col("before") + F.col("inside")).alias("sum"))
    )
    rounds = placed.withColumn("round", F.explode(F.array(*[F.lit(i) for i in range(max_repeats)]))).withColumn(
        "finish", F.when(F.col("target") > 0, (F.col("sum") + F.col("round") * F.col("source_size")) / F.col("target"))
    )
    rounds = checkpoint(rounds.withColumn("step", F.least(F.floor(F.col("finish") * STEPS), F.lit(2 * STEPS)).cast("int")))

    steps = rounds.where(F.col("step").isNotNull()).groupBy("step").agg(F.sum("size").alias("words"))
    # twice the budget is a whole number of half words: 2 * 1.5 * the sum of all sizes
    total = F.lit(2 * float(budget_share)) * F.sum("words").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / max_repeats
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("step", (F.sum("words").over(upto) - F.col("words")).alias("ahead"), F.sum("words").over(upto).alias("through"), total.alias("budget2"))
    cut = steps.where(2 * F.col("through") >= F.col("budget2")).agg(F.min(F.struct(F.col("step").alias("cut_step"), "ahead", "budget2")).alias("cut")).select(F.lit(1).alias("one"), "cut.*")
    cut = F.broadcast(cut)  # one row
    marked = rounds.withColumn("one", F.lit(1)).join(cut, "one", "left")
    order = Window.partitionBy("step").orderBy("finish", F.col("source").isNull(), "source", "key", "doc_id", "apart", "copy", "round").rowsBetween(Window.unboundedPreceding, 0)
    in_step = marked.where(F.col("step") == F.col("cut_step")).withColumn("end", F.col("ahead") + F.sum("size").over(order)).withColumn("taken", (2 * F.col("end") - F.col("size") <= F.col("budget2")).cast("int"))
    rest = marked.where(~F.col("step").eqNullSafe(F.col("cut_step"))).withColumn("taken", F.coalesce((F.col("step") < F.col("cut_step")).cast("int"), F.lit(0)))
    kinds = ["doc_id", "source", "size", "source_size", "target", "apart", "copy"]
    got = (
        in_step.select(*kinds, "taken").unionByName(rest.select(*kinds, "taken"))
        .groupBy(*kinds).agg(F.sum("taken").alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
    more = [] if apart is None else ["apart", F.col("copy").alias("nth")]
    return got.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *more)
