"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words: space and U+0009 to U+000D (the same set as bytes.split()).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package: add it once to the application as a zip."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "pluvia_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, since a row may hold a very long text. The setting is the session's and plans read it when they run, so it is only ever
    lowered; Spark bounds a batch's bytes besides (spark.sql.execution.arrow.maxBytesPerBatch)."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a session of this machine alone gets a temporary one; a cluster has to name one."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("executors need a folder that all of them share: set spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp())
    return sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Written as compressed Parquet to a folder of its own in the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of what written() made, once nothing will read it any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {os.path.dirname(f) for f in df.inputFiles()}:
            if os.path.basename(name).startswith("table-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def by_key(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as a table, from a task's batches in the order of the key; one key is held at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows - 1, bool)
        for c in key:
            x = np.asarray(b.column(c))
            new |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        if held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in key):
            yield pa.Table.from_batches(held)
            held = []
        for at, upto in zip(cuts, cuts[1:]):
            if at:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, upto - at))
    if held:
        yield pa.Table.from_batches(held)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; all-ASCII texts take the JVM's quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def first_by_digest(df: DataFrame, group: str, ident: str, most: Column, salts: int = 256) -> DataFrame:
    """At most `most` (an expression of the group) rows of each group, in the order of a digest of their identifier; columns: group, ident.

    In two steps, so that a group with most of the rows is spread over `salts` windows first; what those leave is bounded.
    """
    key = F.md5(F.col(ident).cast("string"))
    rows = df.select(group, ident).where(F.col(ident).isNotNull()).distinct().withColumn("__key", key).withColumn("__salt", F.pmod(F.xxhash64(ident), F.lit(salts)))
    for by in ([group, "__salt"], [group]):
        rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy("__key", ident))).where(F.col("__nth") <= most)
    return rows.select(group, ident)
