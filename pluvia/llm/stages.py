"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on docs alone; sf_dir is for stages that need other tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.llm import bpe, langid
from pluvia.llm.common import ascii_lower, small_batches
from pluvia.llm.exact_dedup import exact_dedup
from pluvia.llm.mixing import mix
from pluvia.llm.near import digest, near_copies

#: A document of whose trigrams a smaller part is known in any learned language is in none of them. Of 10,000 documents of learned languages each covers 0.53 at least,
#: sentences of other languages in the same script 0.2 to 0.33. Of fewer trigrams than FEW such a share says little: one known trigram is enough.
LEAST_COVERAGE, FEW = 0.36, 20


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def word_bpe_spec() -> str:
    """The text of the public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose n-grams no learned language knows (see LEAST_COVERAGE). Rows that stay are unchanged.

    Filters are fitted on the input's own labelled documents; where none has a language, only documents without a letter go. Null texts go;
    repeated rows are judged alike; an empty table stays one; all columns pass through, whatever their names.
    """
    model = langid.fit(docs.where(~held_out()))
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.table, model.hashes))

    def run(batches):
        m = langid.Filters(*shared.value)

        def stays(text):
            if not m.langs:
                return any(True for _ in langid.grams(text or ""))
            lang, _, coverage, n = m.decide(text)
            return lang != "und" and (coverage >= LEAST_COVERAGE or n < FEW and coverage > 0)

        for b in batches:
            yield b.filter(pa.array([stays(t) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _named(c: Column) -> Column:
    """A value as a string that is never null, so that joins and windows on it share one dealing of the rows."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _keep(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """Rows of docs whose key (never null, and with a digest of what makes texts equal) is in kept's column __key, one row a key. Texts move once.
    Of several that differ in other columns alone, a digest of all columns decides. A row travels as a struct, so its columns may have any names."""
    order = Window.partitionBy("__key").orderBy(F.xxhash64("row"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("__key"))
    return rows.join(kept, "__key", "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (after lower-casing A-Z; null is as empty) the row with the largest doc_id stays; of rows that share that doc_id too, or have none, one.
    An empty table stays one; all columns pass through."""

    def key(sha: Column) -> Column:
        return F.concat_ws("/", _named(F.col("doc_id")), sha)

    kept = exact_dedup(docs, keep="largest").where("kept").select(key(F.col("text_sha256")).alias("__key")).distinct()
    return _keep(docs, key(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)), kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies join (five-word shingles, likeness of 0.8 or more, verified) one stays: that with the smallest doc_id.

    A row is known by its doc_id and its text's digest, and ranks by both, a null doc_id behind all others; so rows that share a doc_id are judged each by its own text.
    Texts without words are alike. An empty table stays one; all columns pass through.
    """

    def key(d: Column) -> Column:
        return F.concat_ws("/", _named(F.col("doc_id")), F.hex(d))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "d")).alias("first")
    kept = near_copies(docs).groupBy("component").agg(first).select("first.*").select(key(F.col("d")).alias("__key"))
    return _keep(docs, key(digest()), kept)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it doesn't take go. Texts move once, rows as structs. An empty table stays one.

    A row is known by its doc_id, source and text (by digest), so rows that share a doc_id, or have none, get each its own copies; rows that are alike in all three are told apart by a digest of all their columns."""

    def key(sha: Column) -> Column:
        return F.concat_ws("/", _named(F.col("doc_id")), _named(F.col("source")), sha)

    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    taken = mix(docs, apart=sha).where("copies > 0").select(key(F.col("apart")).alias("__key"), F.col("nth").cast("int").alias("__nth"), F.col("copies").cast("int").alias("__copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(sha).alias("__key"))
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64("row"))))
    return rows.join(taken, ["__key", "__nth"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe.round_trip(docs, word_bpe_spec())
