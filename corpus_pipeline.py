"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing and encoding, each on what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pluvia.llm import stages
from pluvia.llm.common import discard, written

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.exact),
    ("near_dedup", stages.near),
    ("mixing", stages.mixing),
    ("bpe", stages.encoding),
]

#: Hashes, filters and tokenization have no twin in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what a stage makes is written before the next one reads it, and deleted when that one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nth, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if nth + 1 < len(STAGES):
            made = written(made)
            if nth:
                discard(docs)
        docs = made
    return docs
