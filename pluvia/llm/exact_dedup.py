"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import ascii_lower, checkpoint

#: Runs at the leaves; entries of a run's slice, about; a digest with more than this part of all rows is told to all tasks (so there are 1,000 such at most).
RUNS, SLICE, HOT = 16, 4096, 1000


def _same(a: Column, b: Column) -> Column:
    """Entries of one verified digest; false where one is missing."""
    return F.coalesce((a["digest"] == b["digest"]) & (a["sha"] == b["sha"]) & (a["n_bytes"] == b["n_bytes"]), F.lit(False))


def _merged(runs: DataFrame) -> DataFrame:
    """A round: each pair of neighbouring runs becomes one, slice by slice. Sorting two sorted arrays one behind the other merges them; of two
    entries of a digest the better stays, with the rows of both."""
    pairs = runs.groupBy(F.expr("run div 2").alias("run"), "slice").agg(F.array_sort(F.flatten(F.collect_list("entries"))).alias("both"))

    def entry(x: Column, i: Column) -> Column:
        rows = x["rows"] + F.when(_same(x, F.get("both", i + 1)), F.get("both", i + 1)["rows"]).otherwise(0)
        first = ~_same(x, F.get("both", i - 1))
        return F.struct(first.alias("first"), F.struct(x["digest"].alias("digest"), x["sha"].alias("sha"), x["n_bytes"].alias("n_bytes"), x["best"].alias("best"), rows.alias("rows")).alias("entry"))

    return pairs.select("run", "slice", F.transform(F.filter(F.transform("both", entry), lambda x: x["first"]), lambda x: x["entry"]).alias("entries"))


def exact_dedup(docs: DataFrame, keep: str = "smallest", runs: int = RUNS, slice_entries: int = SLICE) -> DataFrame:
    """Groups of equal texts (equal after lower-casing A-Z) and the row of each that stays.

    Each row's text becomes a 64-bit digest with a SHA-256 and a length that verify it. Rows are dealt to `runs` runs by identifier; a
    run holds one entry a digest (its best identifier, its number of rows), sorted. In binomial rounds run 2 i merges with run
    2 i + 1, until one is left. Runs are cut into slices by digest, as many as give `slice_entries` entries each, so that a merge is
    a task's work of bounded size however many rows there are; rows of a frequent digest are one entry a run before anything moves.
    The verdict goes to rows by a join on the digest, of the digests that several rows have; those that hold over a thousandth of all rows, 1,000
    at most, are broadcast.

    keep: "smallest" or "largest" identifier. A null text is an empty one. A null identifier stays only
    where its group has no other. Of repeated rows (same identifier, same text) one is kept at most.
    Columns other than doc_id and text are ignored, whatever their names. An empty table gives no rows.
    Returns doc_id, keep_id, group_size, kept, text_sha256; one row for each input row.
    """
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    read = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("digest"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("n_bytes")
    )
    key = ["digest", "sha", "n_bytes"]
    rows = checkpoint(read.groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("copies")))
    n = rows.agg(F.sum("copies")).first()[0] or 0

    # identifiers in the order in which they are preferred; for the largest, by their complement
    rank = F.col("doc_id") if {"smallest": True, "largest": False}[keep] else F.bitwise_not("doc_id")
    best = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce(rank, F.lit(0)).alias("rank"), "doc_id")
    leaves = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"), *key).agg(F.min(best).alias("best"), F.sum("copies").alias("rows"))
    slices = max(1, -(-n // slice_entries))
    entry = F.struct(*key, "best", "rows")
    tree = leaves.groupBy("run", F.pmod("digest", F.lit(slices)).alias("slice")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    while runs > 1:
        tree, runs = _merged(tree), -(-runs // 2)
    verdict = checkpoint(tree.select(F.explode("entries").alias("e")).select("e.digest", "e.sha", "e.n_bytes", F.col("e.best.doc_id").alias("keep_id"), F.col("e.rows").alias("group_size")).where("group_size > 1"))

    often = F.broadcast(verdict.where(F.col("group_size") * HOT > n).toDF(*key, "hot_id", "hot_size"))
    told = rows.join(often, key, "left")
    hot = told.where("hot_size IS NOT NULL").withColumnsRenamed({"hot_id": "keep_id", "hot_size": "group_size"})
    rest = told.where("hot_size IS NULL").drop("hot_id", "hot_size").join(verdict.where(F.col("group_size") * HOT <= n), key, "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        hot.unionByName(rest)
        .select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", "copies").alias("group_size"), "sha", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        .select("doc_id", "keep_id", "group_size", ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )
