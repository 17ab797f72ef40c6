"""Series in chunks: the same results for every width of a chunk, one exchange of the rows, and as many tasks as chunks for a single series."""

import contextlib
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pluvia.operators import joins, links, segments
from pluvia.operators import timeseries as ts

DAY = 86400


def made(spark, n=400, seed=1):
    r = random.Random(seed)
    at = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 60, 3600, 90_000]))
        v = r.choice([None, float("nan"), *[round(r.random() * 9, 2)] * 4])
        rows.append((i, r.choice([None, 1, 1, 1, 2]), None if r.random() < 0.03 else at, v, r.choice([None, "a", "a", "b"]), r.random() < 0.4))
    return spark.createDataFrame(rows, "id long, k int, t timestamp, v double, kind string, wet boolean")


WAYS = {
    "total": lambda df, c: ts.running_total(df, ["k"], "t", "v", tie=("id",), chunk=c).select("id", F.round("total", 6)),
    "forward": lambda df, c: ts.fill(df, ["k"], "t", "v", "forward", tie=("id",), chunk=c).select("id", "filled"),
    "linear": lambda df, c: ts.fill(df, ["k"], "t", "v", "linear", tie=("id",), chunk=c).select("id", F.round("filled", 9)),
    "gaps": lambda df, c: ts.gaps(df, ["k"], "t", 100, ("id",), chunk=c).select("id", "previous_ts", "gap_s"),
    "runs": lambda df, c: ts.runs(df, ["k"], "t", "kind", ("id",), True, chunk=c),
    "runs of nulls": lambda df, c: ts.runs(df, ["k"], "t", "kind", ("id",), False, chunk=c),
    "place": lambda df, c: segments.numbered(df, ["k"], "t", ("id",), "n", c).select("id", "n"),
    "neighbour": lambda df, c: segments.neighbour(df, ["k"], "t", ("id",), {"x": F.col("v"), "y": F.col("id")}, c, ahead=True).select("id", "x", "y"),
    "as of": lambda df, c: joins.as_of(df.select("id", "k", "t"), df.where("id % 3 = 0").select("k", "t", "kind"), ["k"], "t", ["kind"], chunk=c),
}


@pytest.mark.parametrize("way", WAYS)
def test_chunks_change_nothing(spark, way):
    df = made(spark).repartition(5)
    whole = sorted(map(str, WAYS[way](df, 10**9).collect()))
    for width in (7, 3600, DAY, 30 * DAY):
        assert sorted(map(str, WAYS[way](df, width).collect())) == whole
    assert len(whole) > 100


def test_blocks_change_nothing(spark):
    df = made(spark).repartition(3)
    for ahead in (1, 2, 8):
        rolled = [sorted(map(str, segments.rolled(df, ["k"], "t", ("id",), ahead, lambda w: {"s": F.sum("id").over(w), "n": F.count(F.lit(1)).over(w)}, DAY, b).select("id", "s", "n").collect())) for b in (1, 5, 10**6)]
        assert rolled[0] == rolled[1] == rolled[2] and len(rolled[0]) == 400
        plain = df.select("id", F.sum("id").over(ts.rolling(["k"], "t", ahead, "id")).alias("s"), F.count(F.lit(1)).over(ts.rolling(["k"], "t", ahead, "id")).alias("n"))
        assert sorted(map(str, plain.collect())) == rolled[0]


def test_baseline_and_keys_of_other_kinds(spark):
    df = made(spark)
    w = ts.so_far(["k"], "t", "id")
    plain = df.select("id", F.last(F.when(~F.col("wet"), F.col("v")), True).over(w).alias("baseline"))
    assert sorted(map(str, links.constant_baseline(df, ["k"], "t", "v", tie=("id",)).select("id", "baseline").collect())) == sorted(map(str, plain.collect()))
    none = segments.numbered(df, [], "t", ("id",), "n")
    assert sorted(r.n for r in none.collect()) == list(range(1, 401))
    text = segments.numbered(df.withColumn("t", F.col("t").cast("string")), ["k"], "t", ("id",), "n")
    assert sorted(map(str, text.select("id", "n").collect())) == sorted(map(str, segments.numbered(df, ["k"], "t", ("id",), "n").select("id", "n").collect()))
    assert segments.numbered(df.limit(0), ["k"], "t", ("id",), "n").count() == 0


@contextlib.contextmanager
def conf(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


FLAT = {"spark__sql__shuffle__partitions": "8", "spark__sql__adaptive__coalescePartitions__enabled": "false"}


@pytest.mark.parametrize("way", ["total", "forward", "linear", "gaps", "place", "neighbour", "as of"])
def test_one_series_is_many_tasks(spark, way):
    """All rows have one key: every task has some of them."""
    df = spark.range(4000).select("id", F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("t"), F.col("id").cast("double").alias("v"), F.lit("a").alias("kind"))
    with conf(spark, **FLAT):
        tasks = Counter(r.p for r in WAYS[way](df, DAY).withColumn("p", F.spark_partition_id()).collect())
        assert len(tasks) == 8 and max(tasks.values()) < 1500
        blocks = segments.rolled(df, ["k"], "t", ("id",), 5, lambda w: {"s": F.sum("id").over(w)}, DAY, 100)
        assert len({r.p for r in blocks.withColumn("p", F.spark_partition_id()).collect()}) == 8


@pytest.mark.parametrize("way,moves", [("total", 1), ("forward", 1), ("gaps", 1), ("neighbour", 1), ("linear", 1), ("as of", 1)])
def test_rows_move_once(spark, tmp_path, way, moves):
    """Exchanges that carry `pad`, a column that only the rows have."""
    path = str(tmp_path / "rows")
    made(spark).withColumn("pad", F.lit("x")).write.parquet(path)
    df = spark.read.parquet(path)
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1", **FLAT):
        if way == "as of":
            got = joins.as_of(df.select("id", "k", "t", "pad"), df.select("k", "t", "kind"), ["k"], "t", ["kind"])
        else:
            ways = {
                "total": lambda: ts.running_total(df, ["k"], "t", "v", tie=("id",)), "forward": lambda: ts.fill(df, ["k"], "t", "v", "forward", tie=("id",)), "linear": lambda: ts.fill(df, ["k"], "t", "v", "linear", tie=("id",)),
                "gaps": lambda: ts.gaps(df, ["k"], "t", tie=("id",)), "neighbour": lambda: segments.neighbour(df, ["k"], "t", ("id",), {"x": F.col("v")}),
            }
            got = ways[way]()
        plan = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    carries = [x for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan) if ("__l#" if way == "as of" else "pad#") in x]
    assert len(carries) == moves, plan
