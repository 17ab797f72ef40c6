"""The registered queries of this subpackage, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm import bpe, collocations, conversations, fingerprints, langid, line_dedup, recompression, simhash, suffix_arrays, toxicity
from pluvia.llm.chat_format import format_chats, learned_text, read_back
from pluvia.llm.exact_dedup import exact_dedup
from pluvia.llm.mixing import mix
from pluvia.llm.stages import held_out, word_bpe_spec


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup(documents(spark, sf_dir)).drop("kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out()
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out))
    return toxicity.score(docs, net).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.dedup(documents(spark, sf_dir)).drop("kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out()))
    return langid.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "coverage")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), word_bpe_spec())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    done = format_chats(rows.unionByName(probe)).withColumn("turns", read_back(F.col("formatted"))).withColumn("learned", learned_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", F.col("copies").cast("long").alias("copies"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir)).drop("kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damaged(rows), also=rows)


QUERIES = {"op1_fingerprints": op1_fingerprints, "op3_simhash": op3_simhash, "op4_substring_dedup": op4_substring_dedup, "op8_suffix_dedup": op8_suffix_dedup, "op6_toxicity": op6_toxicity, "op7_language_id": op7_language_id, "op9_bpe": op9_bpe, "op2_exact_dedup": op2_exact_dedup, "op5_chat_format": op5_chat_format, "op10_mixing": op10_mixing, "op11_line_dedup": op11_line_dedup, "op12_collocations": op12_collocations, "op13_conversation_repair": op13_conversation_repair}

ORACLES = {
    "op2_exact_dedup": r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT doc_id, sha256(x) AS text_sha256, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op5_chat_format": r"""
WITH r AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
    replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS code FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || chr(10) || code || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' WHEN prev = 'assistant' THEN role = 'user' ELSE false END)
    AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM e GROUP BY conv_id""",
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':1') AS key FROM d),
c AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM k),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][(rk - 1) % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM r),
f AS (SELECT *, cap / weight AS fills_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fills_at, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fills_at, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
m AS (SELECT arg_min(level, (fills_at, rk)) AS level FROM l WHERE level <= fills_at),
t AS (SELECT l.source, l.source_size, CASE WHEN m.level IS NULL THEN cap ELSE least(cap, m.level * weight) END AS target FROM l, m),
q AS (
  SELECT c.*, t.source_size, t.target, i.round, CASE WHEN t.target > 0 THEN (c.cum + i.round * t.source_size)::DOUBLE / t.target END AS finish
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) i(round)),
z AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, key, doc_id, round ROWS UNBOUNDED PRECEDING) AS ends FROM q),
y AS (SELECT *, CASE WHEN 2 * ends - size <= 3 * (SELECT sum(size) FROM d) THEN 1 ELSE 0 END AS inn FROM z)
SELECT doc_id, size, source_size, target, (sum(inn) * size)::BIGINT AS taken, source, sum(inn)::BIGINT AS copies
FROM y GROUP BY doc_id, source, size, source_size, target""",
    "op11_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id""",
    "op12_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS x FROM t),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS u FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(u) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(u) - 1), lambda i: u[i] || ' ' || u[i + 1] || ' ' || u[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
s AS (SELECT *, string_split(phrase, ' ') AS u FROM f WHERE k > 1),
c AS (SELECT lang, k, phrase, f AS a, 1 AS cut, u[1] AS head, array_to_string(u[2:], ' ') AS tail FROM s UNION ALL SELECT lang, k, phrase, f, 2, u[1] || ' ' || u[2], u[3] FROM s WHERE k = 3),
v AS (SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, unnest([u[1] || ' ' || u[2], u[2] || ' ' || u[3]]) AS phrase, f FROM s WHERE k = 3),
m AS (SELECT lang, phrase, max(f) AS f FROM o GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN m ON b.k = 2 AND m.lang = b.lang AND m.phrase = b.phrase WHERE m.f IS NULL OR 100 * m.f < 50 * b.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS u FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(u) - 48)) AS i, unnest(list_transform(range(1, len(u) - 48), lambda j: md5_number(array_to_string(u[j:j + 49], ' ')))) AS k FROM d),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM p),
w AS (SELECT doc_id, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS x FROM d),
c AS (SELECT w.doc_id, w.i, w.x, coalesce(max(CASE WHEN f.first < f.doc_id THEN f.i END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS UNBOUNDED PRECEDING) > w.i - 50, false) AS gone FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.i = w.i),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY 1)
SELECT d.doc_id, len(u)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
}
