"""BPE encoding and decoding by a distinct-word table.

Tasks split whole texts into words, a chunk of documents at a time, and keep a chunk's documents as positions in the chunk's
list of distinct words. The lists go out, dealt to buckets by a word's hash; a bucket's task encodes each distinct
word once, whatever the number of chunks that have it; ids go back to the chunks, where they meet the positions.
What moves is the chunks' distinct words and packed positions, never a row an occurrence.
"""

from __future__ import annotations

import functools
import hashlib
import json
import pickle
import re
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import small_batches

#: Characters of text in a chunk, about; a longer document is a chunk of its own.
CHUNK_CHARS = 12_000_000
#: Buckets of words, at most.
MOST_BUCKETS = 4096
#: The tokenizer's own split of lower-cased text (a fixed value of its file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = regex.compile(PATTERN)
#: The same over ASCII. Spaces are listed, since re's \s has U+001C to U+001F too, which the tokenizer's hasn't.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+")


_MARKS = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)]
#: The first (oldest) mark of each combining class.
_CLASSES = list({unicodedata.combining(c): c for c in reversed(_MARKS)}.values())


@functools.lru_cache
def unsure(spec: str) -> np.ndarray:
    """Whether this module's splitting and the tokenizer's may differ on a code point. Python, the regex module and the tokenizer follow different versions of Unicode: it may on
    what Python doesn't know (unassigned code points), and on marks that the two put in another order."""
    from tokenizers import Tokenizer

    pairs = [f"a{x}{y}" for x in _MARKS for y in _CLASSES]
    theirs, ours = Tokenizer.from_str(spec).normalizer.normalize_str(" ".join(pairs)).split(" "), unicodedata.normalize("NFC", " ".join(pairs)).lower().split(" ")
    other = np.array([x != y for x, y in zip(theirs, ours)]).reshape(len(_MARKS), len(_CLASSES))
    odd = other.sum(axis=0) > len(_MARKS) // 8  # a mark that comes in another order with very many others has moved itself
    moved = {c for c, x in zip(_MARKS, other[:, ~odd].any(axis=1)) if x} | {c for c, x in zip(_CLASSES, odd) if x}
    out = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])
    out[[ord(c) for c in moved]] = True
    return out



def _parts(step: dict | None) -> list[dict]:
    """The steps of a (sequence of) pre-tokenizer(s) in a tokenizer's file."""
    return [] if step is None else step["pretokenizers"] if step["type"] == "Sequence" else [step]


class Words:
    """The words of a text, as the tokenizer in spec (the text of its JSON file) splits them, and their ids."""

    def __init__(self, spec: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        splits = [x["pattern"].get("Regex") for x in _parts(json.loads(spec).get("pre_tokenizer")) if x["type"] == "Split"]
        if splits != [PATTERN]:
            raise ValueError(f"this tokenizer splits words by {splits}; only {PATTERN} is known here")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # pre-tokenized words: bytes become the model's characters, nothing more is split
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.unsure = unsure(spec)
        self.pieces = pre_tokenizers.Split(Regex(PATTERN), behavior="removed", invert=True)
        added = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.added = {t: self.tokenizer.token_to_id(t) for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(t in text for t in self.added):
            return self._plain(text)
        return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII.findall(text.lower())
        if self.unsure[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():  # the tokenizer's own tables decide
            return [w for w, _ in self.pieces.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        if "Σ" in text:  # str.lower() knows a final sigma, the tokenizer doesn't
            return _SPLIT.findall(self.tokenizer.normalizer.normalize_str(text))
        return _SPLIT.findall(unicodedata.normalize("NFC", text).lower())

    def ids(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        piece = self.bytes.pre_tokenize_str(word)
        return [t.id for p, _ in piece for t in self.tokenizer.model.tokenize(p)]


def _planes(x: np.ndarray) -> bytes:
    """uint32 as byte planes, which compress better than the numbers do."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _ranked(x: np.ndarray) -> tuple[bytes, list[bytes]]:
    """Ranks of words, small ones being frequent: the bit length of each (compresses well), and the bits below the highest, by length."""
    size = np.frexp(x.astype(np.float64))[1].astype(np.uint8)
    return size.tobytes(), [np.packbits(x[size == k][:, None] >> np.arange(k - 1, dtype=np.uint32) & 1).tobytes() for k in range(2, 33)]


def _unranked(packed: tuple[bytes, list[bytes]]) -> np.ndarray:
    size = np.frombuffer(packed[0], np.uint8)
    out = (size == 1).astype(np.uint32)
    for k, raw in enumerate(packed[1], 2):
        own = np.flatnonzero(size == k)
        if len(own):
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(own) * (k - 1)).reshape(-1, k - 1)
            out[own] = (1 << k - 1) + (bits.astype(np.uint32) << np.arange(k - 1, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    return out


_ROW = "kind int, chunk long, bucket int, blob binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
_BODY, _ASK = 1, 0


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def _coded(docs: DataFrame, spec: str, buckets: int, chunk_chars: int) -> DataFrame:
    """Rows by chunk: first the ids of its distinct words (a row a bucket), then its body of positions."""

    def split(batches):
        words, press = Words(spec), zstandard.ZstdCompressor(level=3)
        part, made = TaskContext.get().partitionId(), 0
        names: dict[str, int] = {}
        ids, counts, where, chars = [], [], [], 0

        def flush():
            nonlocal names, ids, counts, where, chars, made
            if not ids:
                return
            chunk, made = part << 24 | made, made + 1
            at = np.concatenate(where) if where else np.empty(0, np.uint32)
            rank = np.empty(len(names), np.uint32)
            rank[np.argsort(-np.bincount(at, minlength=len(names)), kind="stable")] = np.arange(len(names), dtype=np.uint32)
            yield _rows([(_BODY, chunk, -1, press.compress(pickle.dumps((ids, np.array(counts, np.int64), len(names), _ranked(rank[at])))))])
            home = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in names), np.int64, len(names)) % buckets
            order = np.argsort(home, kind="stable")
            edges = np.searchsorted(home[order], np.arange(buckets + 1))
            listed = list(names)
            out = []
            for b in np.flatnonzero(np.diff(edges)):
                own = order[edges[b] : edges[b + 1]]
                out.append((_ASK, chunk, int(b), press.compress(pickle.dumps((_planes(rank[own]), "\n".join([listed[i] for i in own]))))))
                if len(out) == 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)
            names, ids, counts, where, chars = {}, [], [], [], 0

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = words.split(text or "")
                known = len(names)
                where.append(np.fromiter([names.setdefault(x, len(names)) for x in w], np.uint32, len(w)))
                ids.append(doc_id)
                counts.append(len(w))
                chars += len(text or "") + 64
                if chars >= chunk_chars:
                    yield from flush()
        yield from flush()

    def encode(batches):
        words, press, open_ = Words(spec), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        known: dict[str, list[int]] = {}
        at = None
        for b in batches:
            out = []
            for kind, chunk, bucket, blob in zip(*(b.column(c).to_pylist() for c in _SCHEMA.names)):
                if kind == _ASK:
                    if bucket != at:
                        known, at = {}, bucket
                    ranks, listed = pickle.loads(open_.decompress(blob))
                    got = []
                    for w in listed.split("\n"):
                        if (x := known.get(w)) is None:
                            x = known[w] = words.ids(w)
                        got.append(x)
                    blob = press.compress(pickle.dumps((ranks, _planes(np.fromiter(map(len, got), np.uint32, len(got))), _planes(np.array([i for x in got for i in x], np.uint32)))))
                out.append((kind, chunk, bucket, blob))
                if len(out) == 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    asked = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, _ROW)
    # a body goes wherever its chunk is dealt, the words of a bucket together
    dealt = asked.repartition(F.when(F.col("kind") == _ASK, F.xxhash64("bucket")).otherwise(F.xxhash64("chunk", "kind"))).sortWithinPartitions("bucket")
    return dealt.mapInArrow(encode, _ROW).repartition("chunk").sortWithinPartitions("chunk", "kind")


def _chunks(batches):
    """(doc_ids, word counts, positions, ids of each distinct word) by chunk."""
    open_ = zstandard.ZstdDecompressor()
    held, at = [], None
    for b in batches:
        for kind, chunk, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "chunk", "blob"))):
            if chunk != at:
                held, at = [], chunk
            got = pickle.loads(open_.decompress(blob))
            if kind == _ASK:
                held.append(got)
                continue
            doc_ids, counts, n, packed = got
            table: list = [None] * n
            for ranks, lengths, ids in held:
                upto = np.cumsum(_unplanes(lengths)).tolist()
                listed, lo = _unplanes(ids).tolist(), 0
                for r, hi in zip(_unplanes(ranks).tolist(), upto):
                    table[r] = listed[lo:hi]
                    lo = hi
            held = []
            yield doc_ids, counts, _unranked(packed), table


def _buckets(docs: DataFrame) -> int:
    """As many as shuffle partitions, MOST_BUCKETS at most: a chunk sends a row a bucket, so rows must not grow with the cluster."""
    return min(MOST_BUCKETS, max(256, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def encode(docs: DataFrame, spec: str, buckets: int | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, ids (array of int) of every whole text, one row for each input row; null text: no ids.

    spec: text of a tokenizer's JSON file (word-level split as in PATTERN, BPE with word ends). Strings of its added tokens
    are those tokens; no others are added. Rows stay apart: repeated ones, and ones that share a doc_id or have none, give a row each. An empty
    table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession, 128)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for doc_ids, counts, at, table in _chunks(batches):
            lo = 0
            for k in range(0, len(doc_ids), 256):
                out = []
                for n in counts[k : k + 256]:
                    out.append([i for w in at[lo : lo + n].tolist() for i in table[w]])
                    lo += n
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[k : k + 256], pa.int64()), pa.array(out, pa.list_(pa.int32()))], schema=schema)

    return _coded(docs, spec, buckets or _buckets(docs), chunk_chars).mapInArrow(run, "doc_id long, ids array<int>")


def pieces(spark, spec: str) -> DataFrame:
    """id, piece: the tokenizer's whole vocabulary, of fixed size."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_str(spec).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, p) for p, i in vocab.items()], "id int, piece string")


def decode(ids: DataFrame, spec: str) -> DataFrame:
    """doc_id, ids -> doc_id, text, through a join of ids to pieces (broadcast: a vocabulary has a fixed size).

    Pieces are joined by a space, as the library does for a tokenizer without a decoder. doc_id must tell rows apart; no ids: empty text.
    """
    flat = ids.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces(ids.sparkSession, spec)), "id")
    texts = flat.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    texts = texts.select(F.col("doc_id").alias("__id"), F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"))
    return ids.select("doc_id").join(texts, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def round_trip(docs: DataFrame, spec: str, buckets: int | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256 of every whole text.

    As encode(), and decoded where ids meet positions: an id-to-piece table (broadcast: a vocabulary has a fixed size) gives each
    distinct word's decoded form, and a text's are joined. Null text: empty. Repeated rows give repeated results, an empty table none; a null doc_id
    stays null; other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark, 128)
    vocab = Tokenizer.from_str(spec).get_vocab(with_added_tokens=True)
    listed = [""] * (max(vocab.values(), default=-1) + 1)
    for piece, i in vocab.items():
        listed[i] = piece
    shared = spark.sparkContext.broadcast(listed)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        piece = shared.value
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for doc_ids, counts, at, table in _chunks(batches):
            sizes = np.fromiter(map(len, table), np.int64, len(table))
            numbers = [" ".join(map(str, x)) for x in table]
            said = [" ".join([piece[i] for i in x]) for x in table]
            lo = 0
            for k in range(0, len(doc_ids), 256):
                out = []
                for doc_id, n in zip(doc_ids[k : k + 256], counts[k : k + 256]):
                    own = at[lo : lo + n]
                    lo += n
                    w = own.tolist()
                    out.append((doc_id, int(sizes[own].sum()), sha(" ".join([numbers[i] for i in w])), sha(" ".join([said[i] for i in w]))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return _coded(docs, spec, buckets or _buckets(docs), chunk_chars).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
