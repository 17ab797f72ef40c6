"""Language identification by language-bitmask n-gram filters (bit-sliced Bloom filters)."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import first_by_digest, small_batches

#: Labelled documents of a language that a model is fitted on, at most.
TRAIN_DOCS = 2000
#: Rows of the filter; each holds one bit a language. Hash functions of an n-gram.
ROWS, HASHES = 1 << 20, 3
#: An n-gram belongs to a language that uses it at least 1 / RATIO as often as the language that uses it most, and MIN_COUNT times at least.
RATIO, MIN_COUNT = 4.0, 2
_PIECE = 1 << 20


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for what is not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def grams(text: str):
    """Blocks of letter trigrams (uint64), runs of other characters standing as one space; nothing if the text has no letter.

    A trigram has a letter in its middle. Texts go piece by piece, so memory is bounded for any length.
    """
    table, carry = _letters(), np.zeros(1, np.uint32)
    for at in range(0, len(text) + 1, _PIECE):
        piece = text[at : at + _PIECE]
        c = table[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if at + _PIECE > len(text):
            c = np.append(c, np.uint32(0))
        c = np.concatenate([carry, c])
        keep = c != 0
        keep[1:] |= c[:-1] != 0
        keep[0] = True
        c = c[keep]
        if len(c) > 2:
            a = c.astype(np.uint64)
            k = a[:-2] << np.uint64(42) | a[1:-1] << np.uint64(21) | a[2:]
            k = k[c[1:-1] != 0]
            if len(k):
                yield k
        carry = c[-2:]


def slots(keys: np.ndarray, rows: int, hashes: int) -> list[np.ndarray]:
    """Rows of the filter that an n-gram's hash functions point to."""
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    low, high, mask = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1), np.uint64(rows - 1)
    return [((low + np.uint64(i) * high) & mask).astype(np.int64) for i in range(hashes)]


@dataclass
class Filters:
    """table[r, w]: bits of the languages 64 w to 64 w + 63 in row r."""

    langs: list[str]
    table: np.ndarray
    hashes: int = HASHES
    false: np.ndarray = field(init=False)  # rate of false positives by language

    def __post_init__(self):
        fill = [float(np.mean(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))) for i in range(len(self.langs))]
        self.false = np.array(fill) ** self.hashes

    def shares(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """The part of the text's n-grams that each language holds, corrected for false positives (None: no letter), and their number."""
        hits, n = np.zeros(len(self.langs)), 0
        for keys in grams(text or ""):
            n += len(keys)
            spots = slots(keys, len(self.table), self.hashes)
            for w in range(self.table.shape[1]):
                column = self.table[:, w]
                held = column[spots[0]]
                for s in spots[1:]:
                    held &= column[s]
                for i in range(64 * w, min(len(self.langs), 64 * w + 64)):
                    hits[i] += np.count_nonzero(held & np.uint64(1 << (i % 64)))
        if not n:
            return None, 0
        return np.maximum(0.0, (hits / n - self.false) / np.maximum(1e-9, 1 - self.false)), n

    def decide(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score (the best share's part of all shares), coverage (the best share) and number of n-grams."""
        s, n = self.shares(text)
        if s is None or not len(s):
            return "und", 0.0, 0.0, n
        best = int(np.argmax(s))
        return self.langs[best], float(s[best] / s.sum()) if s.sum() > 0 else 0.0, float(s[best]), n


def fit(labelled: DataFrame, max_docs: int = TRAIN_DOCS, rows: int = ROWS, hashes: int = HASHES, ratio: float = RATIO, min_count: int = MIN_COUNT) -> Filters:
    """Filters from rows of (doc_id, text, lang), of which max_docs a language (in the order of a digest of doc_id) are used whole.

    Rows without text, language or identifier are left out; rows that share a doc_id are used together. Languages of equal share keep an n-gram both. An
    empty table gives filters of no language, which call every text `und`. Counting, choice of n-grams and filling run on Spark; what
    comes to the driver are the languages and the filter's rows, of which there are `rows` times (languages / 64) at most.
    """
    small_batches(labelled.sparkSession)
    known = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = first_by_digest(known, "lang", "doc_id", F.lit(max_docs))
    picked = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")  # max_docs rows a language at most

    def count(batches):
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by.setdefault(lang, []).extend(grams(text))
            for lang, keys in by.items():
                if keys:
                    k, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    langs = sorted(totals)
    if not langs:
        counts.unpersist()
        return Filters([], np.zeros((rows, 1), np.uint64), hashes)
    table = labelled.sparkSession.createDataFrame([(k, i, float(totals[k])) for i, k in enumerate(langs)], "lang string, nth int, total double")
    part = F.col("n") / F.col("total")
    shares = counts.join(F.broadcast(table), "lang").select("gram", "nth", "n", part.alias("part"))
    most = shares.groupBy("gram").agg(F.max("part").alias("most"))
    chosen = shares.join(most, "gram").where((F.col("part") * ratio >= F.col("most")) & (F.col("n") >= min_count)).select("gram", "nth")

    def place(batches):
        for b in batches:
            keys, nth = np.asarray(b.column("gram")).view(np.uint64), np.asarray(b.column("nth"))
            for s in slots(keys, rows, hashes):
                bits = (np.uint64(1) << (nth % 64).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array((nth // 64).astype(np.int32)), pa.array(bits)], ["slot", "word", "bits"])

    filled = chosen.mapInArrow(place, "slot long, word int, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits"))
    got = filled.toArrow()
    counts.unpersist()
    out = np.zeros((rows, -(-len(langs) // 64)), np.uint64)
    out[got.column("slot").to_numpy(), got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Filters(langs, out, hashes)


def identify(docs: DataFrame, model: Filters, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and the columns in keep), lang_pred, score, coverage of every whole text; `und` without a letter.

    Ties go to the smaller language name. Rows stay as they are, repeated ones and null identifiers included; null texts are `und`; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.table, model.hashes))
    kept = [c for c in docs.columns if c in ("doc_id", *keep)]
    fields = [f for f in docs.select(*kept).schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, coverage double"])
    source = docs.select(*kept, F.col("text").alias("__text"))

    def run(batches):
        m = Filters(*shared.value)
        for b in batches:
            found = [m.decide(t) for t in b.column("__text").to_pylist()]
            cols = list(zip(*found)) if found else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], [*kept, "lang_pred", "score", "coverage"]
            )

    return source.mapInArrow(run, schema)
