"""Document fingerprints: threshold-scaled sketches of word shingles, mergeable across documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import small_batches

#: Shingles of so many words; a shingle's hash is retained below this part of its range.
WORDS = 5
FRACTION = 0.25
_BLOCK = 1 << 16


def sketch(text: str | None, words: int = WORDS, fraction: float = FRACTION) -> tuple[np.ndarray, int]:
    """The retained hashes, ascending, and the smallest hash of all (-1: no words).

    Texts of fewer words than a shingle has are one shingle. The smallest hash stands beside the sketch,
    so that a short text whose hashes all lie above the threshold can still be told from another; minima merge like the sketch does.
    """
    w = (text or "").encode("utf-8", "surrogatepass").split()
    if not w:
        return np.empty(0, np.uint64), -1
    n = max(1, len(w) - words + 1)
    top = np.uint64(int(fraction * 2**64) - 1)
    found, least = [], None
    for at in range(0, n, _BLOCK):
        upto = min(n, at + _BLOCK)
        part = w[at : upto + words - 1]
        columns = [part[j : j + upto - at] for j in range(min(words, len(w)))]
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*columns))), np.uint64, upto - at)
        least = min(h.min(), least) if least is not None else h.min()
        found.append(h[h <= top])
    return np.unique(np.concatenate(found)), int(least)


def merge(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """The sketch of both texts' shingles together."""
    least = [x for x in (a[1], b[1]) if x >= 0]
    return np.union1d(a[0], b[0]), min(least, default=-1)


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> tuple[float, float, float]:
    """Estimates of Jaccard likeness, of the part of a that b contains and of the part of b that a contains."""
    if not len(a[0]) or not len(b[0]):
        if len(a[0]) or len(b[0]):
            return 0.0, 0.0, 0.0
        same = float(a[1] == b[1])
        return same, same, same
    x, y = set(a[0].tolist()), set(b[0].tolist())
    both = len(x & y)
    return both / (len(x) + len(y) - both), both / len(x), both / len(y)


def as_string(s: tuple[np.ndarray, int]) -> str:
    """The upper 48 bits of each retained hash as hex digits, ascending; then, after a dot, the smallest hash of all."""
    if s[1] < 0:
        return ""
    return (s[0] >> np.uint64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex() + f".{s[1]:016x}"


def sketches(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """doc_id, text -> doc_id, hashes (array of long, as signed), least (long, signed; null: no words). Null text: empty. A row for each row, other columns ignored."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [sketch(t, words, fraction) for t in b.column("text").to_pylist()]
            signed = [s[0].view(np.int64).tolist() for s in got]
            least = [None if s[1] < 0 else int(np.uint64(s[1]).astype(np.int64)) for s in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(signed, pa.list_(pa.int64())), pa.array(least, pa.int64())], ["doc_id", "hashes", "least"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, hashes array<long>, least long")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows in descending doc_id, dealt to buckets, each bucket ending with a copy (halo = 1) of the row that follows its last.

    The bounds of buckets are identifiers that occur (approximate quantiles), so the row that a bucket needs from its
    neighbour is known by its identifier alone, and each text moves once. After the last row comes the first.
    Null identifiers come last of all. Rows with equal identifiers go by text. Columns: bucket, halo, doc_id, text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = buckets or min(8192, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = F.array(*[F.lit((i + 1) / n) for i in range(n)])
    got = rows.agg(F.percentile_approx("doc_id", parts, F.lit(4 * n)).alias("q"), F.max("doc_id").alias("top")).first()
    bounds = np.array(sorted({*(got["q"] or []), *([] if got["top"] is None else [got["top"]])}), np.int64)

    def deal(batches):
        for b in batches:
            ids = b.column("doc_id")
            null = np.asarray(ids.is_null())
            x = np.asarray(ids.fill_null(0))
            at = np.searchsorted(bounds, x)
            at[null] = 0
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.zeros(len(x), np.int32)), ids, b.column("text")], ["bucket", "halo", "doc_id", "text"])
            edge = np.flatnonzero(~null & np.isin(x, bounds))
            if len(edge):
                moved = b.take(pa.array(edge))
                to = (at[edge] + 1) % len(bounds)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.ones(len(edge), np.int32)), moved.column("doc_id"), moved.column("text")], ["bucket", "halo", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "bucket int, halo int, doc_id long, text string")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Each text's fingerprint, that of its edited text and of the next document, and their likeness.

    The edited text ends with the first floor(n / 2) code points (or all) of the next document, by descending doc_id, in
    place of its own last floor(n / 2). Null text: empty. The text after the only row is its own; where all
    identifiers are null, the text after the last is empty. Repeated rows give repeated results, an empty table none. Other columns are ignored.
    """

    def run(batches):
        held = None

        def result(row, bucket, following):
            doc_id, text, own = row
            n = len(text)
            edited = text[: n - n // 2] + following[1][: n // 2]
            other = sketch(edited, words, fraction)
            near, near_in, _ = likeness(own, other)
            nxt, nxt_in, nxt_of = likeness(own, following[2])
            return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_string(own), as_string(other), near, nxt, near_in, nxt_in, nxt_of

        def block(rows):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

        for b in batches:
            out = []
            for bucket, halo, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text"))):
                row = (doc_id, text, sketch(text, words, fraction))
                if held is not None and held[0] == bucket:
                    out.append(result(held[1], bucket, row))
                elif held is not None:
                    out.append(result(held[1], held[0], (None, "", sketch(None))))
                held = None if halo else (bucket, row)
            if out:
                yield block(out)
        if held is not None:
            yield block([result(held[1], held[0], (None, "", sketch(None)))])

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_by_edited double, held_by_next double, holds_of_next double"
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(name, types[kind]) for name, kind in (x.split() for x in kinds.split(", "))])
    return with_next(docs).mapInArrow(run, kinds)
