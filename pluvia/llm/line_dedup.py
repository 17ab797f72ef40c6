"""Line dedup that can be taken back: exact reference counts of lines in shards, and a cuckoo filter a shard of the lines that several documents have."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import by_key, discard, small_batches, written

#: Lines of fewer code points (stripped) are never dropped.
LEAST = 10
#: Shards at least, and references a shard.
SHARDS, SHARD_REFS = 1024, 500_000
#: A line with more than this part of all references is looked up where its documents are; there are fewer than 1,000 of them.
HOT = 1000
_SLOTS, _KICKS = 4, 500
#: What a null identifier counts as.
_NULL = (1 << 63) - 1


class Cuckoo:
    """Filter of 64-bit keys: buckets of four fingerprints of 16 bits, each key in one of two buckets. Keys are added once and can be removed. Bulk operations in numpy."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots

    @classmethod
    def of(cls, keys: np.ndarray, buckets: int = 4) -> Cuckoo:
        """A filter of distinct keys, as many buckets as it takes."""
        while buckets * _SLOTS * 0.9 < len(keys):
            buckets *= 2
        while True:
            made = cls(np.zeros((buckets, _SLOTS), np.uint16))
            if made.add(keys):
                return made
            buckets *= 2

    @classmethod
    def read(cls, blob: bytes) -> Cuckoo:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, _SLOTS).copy())

    def blob(self) -> bytes:
        return self.slots.tobytes()

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = np.maximum(keys >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return (keys & np.uint64(len(self.slots) - 1)).astype(np.int64), mark

    def has(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that was added; for others with a probability of about 8 in 65,536."""
        bucket, mark = self._places(keys)
        return (self.slots[bucket] == mark[:, None]).any(axis=1) | (self.slots[self._other(bucket, mark)] == mark[:, None]).any(axis=1)

    def _place(self, bucket: np.ndarray, mark: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Puts marks into slots that hold `wanted`'s value (0: free ones) of their buckets, several of a bucket into several slots; which ones found one."""
        if not len(bucket):
            return np.zeros(0, bool)
        order = np.lexsort((mark, wanted, bucket))
        b = bucket[order]
        fits = self.slots[b] == wanted[order][:, None]
        same = np.r_[False, (b[1:] == b[:-1]) & (wanted[order][1:] == wanted[order][:-1])]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(b))))
        rank = np.arange(len(b)) - first
        slot = np.argsort(~fits, axis=1, kind="stable")  # fitting slots first
        ok = rank < fits.sum(axis=1)
        at = np.take_along_axis(slot, np.minimum(rank, _SLOTS - 1)[:, None], axis=1)[:, 0]
        self.slots[b[ok], at[ok]] = mark[order][ok]
        done = np.zeros(len(b), bool)
        done[order] = ok
        return done

    def add(self, keys: np.ndarray) -> bool:
        """False if a place couldn't be found for all; the filter is of no use then."""
        bucket, mark = self._places(keys)
        for kick in range(_KICKS):
            for _ in range(2):
                left = ~self._place(bucket, mark, np.zeros(len(mark), np.uint16))
                bucket, mark = bucket[left], mark[left]
                if not len(mark):
                    return True
                bucket = self._other(bucket, mark)
            # one of each bucket takes a slot's place, and what stood there goes on to its other bucket
            _, one = np.unique(bucket, return_index=True)
            at = (one + kick) % _SLOTS
            out = self.slots[bucket[one], at]
            self.slots[bucket[one], at] = mark[one]
            mark[one] = out
            bucket[one] = self._other(bucket[one], out)
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Takes out keys that were added."""
        bucket, mark = self._places(keys)
        left = ~self._place(bucket, np.zeros(len(mark), np.uint16), mark)
        bucket, mark = bucket[left], mark[left]
        self._place(self._other(bucket, mark), np.zeros(len(mark), np.uint16), mark)


def line_key(line: bytes) -> bytes | None:
    """128 bits of a line, stripped and with A-Z lower-cased; None if it is too short to be dropped."""
    bare = line.strip().lower()  # of bytes: the six separators, and A-Z alone
    if len(bare) < LEAST or len(bare) < 4 * LEAST and len(bare.decode("utf-8", "replace")) < LEAST:
        return None
    return hashlib.blake2b(bare, digest_size=16).digest()


def _short(keys: Iterable[bytes]) -> np.ndarray:
    """The last 64 bits of each key: what filters know of it (shards go by the first 32)."""
    return np.frombuffer(b"".join(k[8:] for k in keys), np.uint64)


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    ident = F.col("doc_id").cast("long")
    return docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit(_NULL)).alias("oid"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def references(docs: DataFrame) -> DataFrame:
    """oid, keys: the different lines of each row that may be dropped."""

    def run(batches):
        for b in batches:
            keys = [list({k for k in map(line_key, t.split(b"\n")) if k}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("oid"), pa.array(keys, pa.list_(pa.binary()))], ["oid", "keys"])

    return _rows(docs).select("oid", "text").mapInArrow(run, "oid long, keys array<binary>")


def _sharded(key, shards: int):
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _counted(refs: DataFrame, shards: int) -> DataFrame:
    """shard, key, n (rows that have the line), lo, hi (smallest and largest identifier of them); counted in parts before rows move."""
    each = refs.select("oid", F.explode("keys").alias("key"))
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("oid").alias("lo"), F.max("oid").alias("hi")).select(_sharded(F.col("key"), shards).alias("shard"), "key", "n", "lo", "hi")


@dataclass
class Lines:
    """The state of incremental line dedup, in tables of the shared folder: a generation; add() and remove() make new ones and leave this one readable.

    refs: oid, keys of every row. counts: shard, key, n, lo, hi, exactly. filters: shard, blob: the cuckoo filter of the shard's lines that several documents have (lo < hi).
    """

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    def add(self, docs: DataFrame) -> Lines:
        """With more documents. Counts of new lines and known ones are summed; only lines that became shared touch a filter."""
        new = written(references(docs))
        both = self.counts.select("*", F.lit(True).alias("old")).unionByName(_counted(new, self.shards).withColumn("old", F.lit(False)))
        merged = both.groupBy("shard", "key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.coalesce(F.bool_or(F.col("old") & (F.col("lo") < F.col("hi"))), F.lit(False)).alias("was"))
        return self._next(self.refs.unionByName(new), merged)

    def remove(self, ids: DataFrame) -> Lines:
        """Without the documents of ids (column doc_id). Counts go down, lines with none left go, and a line that lost its first or last document gets the next one from the references."""
        gone = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("oid")).distinct()
        rest = self.refs.join(gone, "oid", "left_anti")
        less = written(_counted(self.refs.join(gone, "oid", "left_semi"), self.shards))
        left = _counted(rest.select("oid", F.explode("keys").alias("key")).join(less.select("key"), "key", "left_semi").select("oid", F.array("key").alias("keys")), self.shards)
        known = self.counts.join(less.select("key", F.col("n").alias("minus")), "key", "left").join(left.select("key", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "key", "left")
        known = known.withColumn("was", F.col("lo") < F.col("hi")).withColumn("n", F.col("n") - F.coalesce("minus", F.lit(0)))
        now = known.withColumn("lo", F.when(F.col("minus").isNull(), F.col("lo")).otherwise(F.col("lo2"))).withColumn("hi", F.when(F.col("minus").isNull(), F.col("hi")).otherwise(F.col("hi2")))
        made = self._next(rest, now.select("shard", "key", F.when(F.col("n") > 0, F.col("n")).alias("n"), "lo", "hi", "was"), own_refs=True)
        discard(less)
        return made

    def _next(self, refs: DataFrame, merged: DataFrame, own_refs: bool = False) -> Lines:
        """merged: counts with was (shared before); n is null where no document is left. Filters take in what became shared and lose what is no longer."""
        table = written(merged)
        counts = table.where(F.col("n").isNotNull())
        turned = table.withColumn("now", F.coalesce(F.col("n").isNotNull() & (F.col("lo") < F.col("hi")), F.lit(False))).where("now != was").select("shard", F.col("now").cast("int").alias("kind"), "key")
        before = self.filters.select("shard", F.lit(-1).alias("kind"), F.col("blob").alias("key"))

        def update(batches):
            for t in by_key(batches, ["shard"]):
                kind, keys = np.asarray(t.column("kind")), t.column("key").to_pylist()
                had = int(kind[0] == -1)
                changes, kind = keys[had:], kind[had:]
                out, new = (_short(k for k, c in zip(changes, kind) if c == which) for which in (0, 1))
                if had:
                    f = Cuckoo.read(keys[0])
                    f.remove(out)
                    blob = f.blob() if f.add(new) else None  # full: built anew from the counts
                else:
                    blob = Cuckoo.of(new).blob()
                yield pa.RecordBatch.from_arrays([t.column("shard").combine_chunks()[:1], pa.array([blob], pa.binary())], ["shard", "blob"])

        def build(batches):
            for t in by_key(batches, ["shard"]):
                yield pa.RecordBatch.from_arrays([t.column("shard").combine_chunks()[:1], pa.array([Cuckoo.of(_short(t.column("key").to_pylist())).blob()], pa.binary())], ["shard", "blob"])

        small_batches(table.sparkSession)
        filters = written(before.unionByName(turned).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(update, "shard int, blob binary"))
        full = filters.where(F.col("blob").isNull()).select("shard")
        if full.take(1):
            anew = counts.where("lo < hi").join(full, "shard", "left_semi").select("shard", "key").repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, blob binary")
            filters = written(filters.where(F.col("blob").isNotNull()).unionByName(anew))
        return Lines(written(refs) if own_refs else refs, counts.drop("was"), filters, self.shards)

    def dropped(self, refs: DataFrame) -> DataFrame:
        """oid, key: lines that documents of refs lose, since one with a smaller identifier has them. The documents have to be in this state.

        References go to their shard and meet its filter; what passes is looked up in the exact counts. Very frequent lines (fewer than 1,000) don't move: their verdict goes to them.
        """
        small_batches(refs.sparkSession)
        total = self.counts.agg(F.sum("n")).first()[0] or 0
        frequent = self.counts.where((F.col("n") > total / HOT) & (F.col("lo") < F.col("hi")))
        hot = refs.sparkSession.sparkContext.broadcast({bytes(r["key"]): r["lo"] for r in frequent.select("key", "lo").collect()})  # fewer than HOT rows
        n_shards = self.shards

        def deal(batches):
            owner = hot.value
            for b in batches:
                shard, oid, key, known = [], [], [], []
                for o, keys in zip(b.column("oid").to_pylist(), b.column("keys").to_pylist()):
                    for k in keys:
                        first = owner.get(k)
                        if first is None or first != o:
                            shard.append(int.from_bytes(k[:4], "big") % n_shards)
                            oid.append(o)
                            key.append(k)
                            known.append(first is not None)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(oid, pa.int64()), pa.array(key, pa.binary()), pa.array(known, pa.bool_())], ["shard", "oid", "key", "known"])

        def probe(batches):
            at, f = None, None
            for b in batches:
                shards = np.asarray(b.column("shard"))
                cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else []
                for x, y in zip(cuts, cuts[1:]):
                    part = b.slice(x, y - x)
                    if shards[x] != at:
                        at, f = shards[x], None
                    if not part.column("oid")[0].is_valid:
                        f = Cuckoo.read(part.column("key")[0].as_py())
                        part = part.slice(1)
                    if f is not None and part.num_rows:
                        hit = part.filter(pa.array(f.has(_short(part.column("key").to_pylist()))))
                        if hit.num_rows:
                            yield hit.select(["oid", "key"])

        dealt = refs.mapInArrow(deal, "shard int, oid long, key binary, known boolean")
        blobs = self.filters.select("shard", F.lit(None).cast("long").alias("oid"), F.col("blob").alias("key"))
        met = dealt.where("NOT known").drop("known").unionByName(blobs).repartition("shard").sortWithinPartitions("shard", F.col("oid").asc_nulls_first())
        hits = met.mapInArrow(probe, "oid long, key binary")
        shared = self.counts.where("lo < hi").select("key", "lo")
        verdict = hits.join(shared, "key").where("oid != lo").select("oid", "key")
        return dealt.where("known").select("oid", "key").unionByName(verdict)


def lines(docs: DataFrame) -> Lines:
    """The state over documents. A null text is one empty line; a null doc_id counts as larger than any other; rows that share a doc_id are one document: their lines are counted by row,
    but shared only if another doc_id has them too. An empty table gives an empty state."""
    spark = docs.sparkSession
    new = references(docs)
    n = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, n // 64 // SHARD_REFS)  # as if lines had 64 bytes
    nothing = [spark.createDataFrame([], s) for s in (new.schema, "shard int, key binary, n long, lo long, hi long", "shard int, blob binary")]
    return Lines(*nothing, shards).add(docs)


def dedup(docs: DataFrame, state: Lines | None = None) -> DataFrame:
    """Drops a document's lines that one with a smaller identifier has too, both compared without separators at the ends and with A-Z lower-cased; lines of fewer than ten code points stay.

    state: lines(docs), or a state that holds these documents besides others. A text moves once, to meet its dropped lines. See lines() for nulls and shared identifiers;
    an empty table gives no rows; other columns are ignored.
    Returns doc_id, n_lines, n_dropped, kept (the other lines, joined by a newline), kept_sha256.
    """
    refs = None
    if state is None:
        state = lines(docs)
        refs = state.refs
    gone = state.dropped(references(docs) if refs is None else refs).groupBy("oid").agg(F.collect_list("key").alias("keys"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, keys in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "keys"))):
                own = text.split(b"\n")
                away = set(keys or ())
                kept = [x for x in own if line_key(x) not in away] if away else own
                whole = b"\n".join(kept)
                out.append((doc_id, len(own), len(own) - len(kept), whole, hashlib.sha256(whole).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    met = _rows(docs).join(gone.hint("shuffle_hash"), "oid", "left").select("doc_id", "text", "keys")
    return met.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept binary, kept_sha256 string").withColumn("kept", F.col("kept").cast("string"))
