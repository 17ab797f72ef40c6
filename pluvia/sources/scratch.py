"""Folders for what a job writes and reads again."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, kind: str = "landed") -> str:
    """A new folder that driver and executors share, deleted when the application ends: below spark.checkpoint.dir, or where that is unset and all runs on this machine, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("executors need a folder that all of them share: set spark.checkpoint.dir")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{path}/table"
