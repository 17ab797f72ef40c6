"""Finds what a document repeats of documents with smaller identifiers: the part that two operators share.

A document is a sequence of units (words, or bytes); a window is so many consecutive units. Each kind of sequence names for
every window an anchor, a hash that depends on the window's own units alone, and neighbouring windows mostly share theirs:

0. Exact copies need no windows: all but the copy with the smallest identifier lose everything, if a window fits in. What repeats one of
   them repeats that copy too, so the others take no further part.
1. An anchor that only one text has can have no repeated window; a grouping tells which anchors several texts have.
2. For those, segments go out: the units under a stretch of windows with the same anchor. Equal windows have equal
   anchors, so they meet.
3. Shards of whole anchors compare windows unit by unit (equal segments once) and tell which parts of a segment an earlier
   document has. An anchor with very many segments is no shard: its segments are cut down to windows that recur, then
   equal pieces are grouped, and only the windows of different pieces are grouped a row each.
4. The parts go back to the documents, where their union is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import checkpoint, discard, small_batches, written

#: Bits of a filter that tasks get (32 MB), and values that one of several takes. With more than MOST_ANCHORS shared anchors, they are joined to their documents instead.
MOST_BITS, FILTER_VALUES, MOST_ANCHORS = 1 << 28, 1 << 24, 1 << 29
#: Anchors and characters of text that a task holds before it asks the filters, about.
HELD_ANCHORS, HELD_TEXT = 1 << 18, 1 << 22
#: Segments of one anchor that a shard's task takes. Those of an anchor with more are compared in other steps (_hot_spans()).
MOST_SEGMENTS = 50_000
#: Bytes of segments that a shard's task compares at a time, about.
SHARD_BYTES = 1 << 20
#: Stands for a null identifier, and for the end of a text.
_NULL, _END = (1 << 63) - 1, 1 << 60


@dataclass
class Kind:
    """units: text -> sequence; anchors: sequence -> blocks of (first window, number of windows, anchor), all windows covered;
    cut: sequence, from, to -> bytes; sizes: array of segments -> array of their numbers of units; windows: segment bytes -> the byte range of each window; compare: see hashed()."""

    window: int
    units: Callable
    anchors: Callable
    cut: Callable
    sizes: Callable
    windows: Callable
    compare: Callable


def spans_of(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The union of [s, s + window) for ascending s, as maximal runs."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + window).tolist()))


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = keys * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return [h & np.uint64(bits - 1), h >> np.uint64(64 - bits.bit_length() + 1)]


def _in(keys: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which keys the filter has."""
    hit = np.ones(len(keys), bool)
    for s in _slots(keys, bits):
        hit &= (table[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def _bloom(shared: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A filter of values (anchor, of which there are n); its size is bounded by MOST_BITS. What it lets through wrongly costs work, not results."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * max(n, 1)).bit_length()))

    def place(batches):
        for b in batches:
            for s in _slots(np.asarray(b.column("anchor")).view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array((s >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (s & np.uint64(63))).view(np.int64))], ["at", "bits"])

    got = shared.mapInArrow(place, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table, bits


def _filters(values: DataFrame, n: int) -> list[Broadcast]:
    """Filters of values (anchor, not negative, of which there are n), of about FILTER_VALUES each: the remainder of a value says which one has it."""
    many, sc = max(1, -(-n // FILTER_VALUES)), values.sparkSession.sparkContext
    own = [values.where(F.col("anchor") % many == nth) for nth in range(many)] if many > 1 else [values]
    return [sc.broadcast(_bloom(x, -(-n // many))) for x in own]


def _passing(keys: np.ndarray, filters: list[Broadcast]) -> np.ndarray:
    """Which keys their filters have. Of several filters a task holds one at a time, so its memory doesn't follow their number."""
    if len(filters) == 1:
        return _in(keys, *filters[0].value)
    found, nth = np.zeros(len(keys), bool), keys % np.uint64(len(filters))
    for i, filled in enumerate(filters):
        own = np.flatnonzero(nth == i)
        if len(own):
            path = getattr(filled, "_path", None)  # .value would keep what it has read
            found[own] = _in(keys[own], *(filled.load_from_path(path) if path else filled.value))
    return found


def _home_bits(spark: SparkSession) -> int:
    """Anchors are dealt to so many bits' number of homes, of which tasks have several each."""
    return max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _shortened(kind: Kind, bits: int) -> Kind:
    """Anchors of so many bits, mixed. Those that clash share a shard, which compares units, so it costs work, not results."""

    def anchors(seq):
        for first, count, anchor in kind.anchors(seq):
            h = anchor.view(np.uint64)
            yield first, count, (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)

    return replace(kind, anchors=anchors)


def _segments(docs: DataFrame, kind: Kind, shared: DataFrame, n_shared: int, most_anchors: int, leading, hot: np.ndarray, only_hot: bool = False) -> DataFrame:
    """oid, tkey, anchor, at, seg of the shared anchors without those in hot, or of those in hot alone (only_hot)."""
    spark, window = docs.sparkSession, kind.window
    apart, filters = spark.sparkContext.broadcast(np.sort(hot)), None
    source = docs.withColumn("shared", F.lit(None).cast("array<long>"))
    if not only_hot and n_shared <= most_anchors:
        filters = _filters(shared, n_shared)
    elif not only_hot:
        own = _anchors(docs, kind, leading, None, every=True).join(shared, "anchor").groupBy("tkey").agg(F.collect_set("anchor").alias("shared"))
        source = docs.join(own, "tkey")

    def wanted(held: list[tuple]) -> np.ndarray:
        keys, cold = np.concatenate([h[-1] for h in held]), True
        if len(apart.value):
            at = np.searchsorted(apart.value, keys.view(np.int64))
            is_hot = apart.value[np.minimum(at, len(apart.value) - 1)] == keys.view(np.int64)
            if only_hot:
                return is_hot
            cold = ~is_hot
        if filters is not None:
            return _passing(keys, filters) & cold
        return np.concatenate([np.isin(h[-1].view(np.int64), np.array(h[3], np.int64)) for h in held]) & cold

    def cut(held: list[tuple]):
        out, size, upto = [], 0, 0
        hit = wanted(held) if held else None
        for oid, tkey, seq, _, first, count, anchor in held:
            own = hit[upto : upto + len(anchor)]
            upto += len(anchor)
            for at, n, name in zip(first[own].tolist(), count[own].tolist(), anchor[own].view(np.int64).tolist()):
                seg = kind.cut(seq, at, at + n + window - 1)
                size += len(seg)
                out.append((oid, tkey, name, at, seg))
            if size > 1 << 22:
                yield _batch(out, _SEGMENT)
                out, size = [], 0
        if out:
            yield _batch(out, _SEGMENT)

    def run(batches):
        held, n, size = [], 0, 0
        for b in batches:
            b = b.filter(pa.array(_in(np.asarray(b.column("row")).view(np.uint64), *leading.value)))
            for oid, tkey, text, own in zip(*(b.column(c).to_pylist() for c in ("oid", "tkey", "text", "shared"))):
                seq = kind.units(text)
                size += len(text)
                for block in kind.anchors(seq):
                    held.append((oid, tkey, seq, own, *block))
                    n += len(block[-1])
                    if n > HELD_ANCHORS or size > HELD_TEXT:
                        yield from cut(held)
                        held, n, size = [], 0, 0
        yield from cut(held)

    return source.select("row", "oid", "tkey", "text", "shared").mapInArrow(run, "oid long, tkey long, anchor long, at long, seg binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


_SEGMENT = pa.schema([("oid", pa.int64()), ("tkey", pa.int64()), ("anchor", pa.int64()), ("at", pa.int64()), ("seg", pa.binary())])
_SPAN = pa.schema([("oid", pa.int64()), ("tkey", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_SPANS = "oid long, tkey long, a long, b long"
_PIECE = pa.schema([("oid", pa.int64()), ("tkey", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("seg", pa.binary())])


def _spans_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SPAN)


def _anchors(docs: DataFrame, kind: Kind, leading, twins, every: bool = False) -> DataFrame:
    """bucket, anchor, tkey, k of the rows that the filter `leading` has (None: all). Of a stretch of texts an anchor's smallest and largest tkey go out alone (all of them: every);
    k adds up to its segments. A text that one row alone has (it isn't in the filter `twins`, or there is none) needs no name to be told from others: its tkey is 0.

    They travel as arrays by bucket, four bytes an anchor (the bucket's number is the rest of it), and are dealt by bucket, so grouping by (bucket, anchor) moves nothing more.
    """
    home_bits = _home_bits(docs.sparkSession)

    def packed(anchor: np.ndarray, tkey: np.ndarray, k: np.ndarray):
        if not every:
            order = np.lexsort((tkey, anchor))
            anchor, tkey, k = anchor[order], tkey[order], k[order]
            new = np.append(True, anchor[1:] != anchor[:-1])
            start = np.flatnonzero(new)
            total, k = np.add.reduceat(k, start), np.zeros(len(k), np.int32)
            k[start] = total
            last = np.append(new[1:], True)
            edge = new | last
            anchor, tkey, k = anchor[edge], tkey[edge], k[edge]
        home = (anchor & ((1 << home_bits) - 1)).astype(np.int32)
        anchor = (anchor >> home_bits).astype(np.uint32).view(np.int32)
        order = np.argsort(home.astype(np.uint16) if home_bits <= 16 else home, kind="stable")
        home = home[order]
        cuts = np.append(np.flatnonzero(np.append(True, home[1:] != home[:-1])), len(home)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(home[cuts[:-1]]), *[pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order])) for x in (anchor, tkey, k)]], ["bucket", "anchors", "tkeys", "ks"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if leading is not None:
                b = b.filter(pa.array(_in(np.asarray(b.column("row")).view(np.uint64), *leading.value)))
            names = np.asarray(b.column("tkey"))
            if not every:
                names = np.where(_in(names.view(np.uint64), *twins.value), names, 0) if twins is not None else np.zeros_like(names)
            for tkey, text in zip(names.tolist(), b.column("text").to_pylist()):
                for _, _, anchor in kind.anchors(kind.units(text)):
                    a = np.sort(anchor)
                    new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                    a, k = a[new], np.diff(np.append(new, len(a)))
                    held.append((a.view(np.int64), np.full(len(a), tkey, np.int64), k.astype(np.int32)))
                    size += len(a)
                    if size > 1 << 18:
                        yield packed(*map(np.concatenate, zip(*held)))
                        held, size = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held)))

    rows = docs.select("row", "tkey", "text").mapInArrow(run, "bucket int, anchors array<int>, tkeys array<long>, ks array<int>").repartition("bucket")
    each = rows.select("bucket", F.inline(F.arrays_zip(F.col("anchors").alias("rest"), F.col("tkeys").alias("tkey"), F.col("ks").alias("k"))))
    whole = F.shiftleft(F.col("rest").cast("long").bitwiseAND(F.lit((1 << 32) - 1)), home_bits).bitwiseOR(F.col("bucket").cast("long"))
    return each.select("bucket", whole.alias("anchor"), "tkey", "k")


def hashed(kind_windows: Callable, window: int):
    """A comparison for shards: windows by 128-bit names, each match verified by its bytes. Returns the repeated parts of each segment.

    It takes groups (lists of (least, segment), one group an anchor) and gives, for each, a list of parts by segment: runs of
    units that windows cover which a document with a smaller identifier than the segment's has too.
    """

    def compare(groups: list[list[tuple[int, bytes]]]) -> list[list[list[tuple[int, int]]]]:
        done = []
        for group in groups:
            best: dict = {}
            named = []
            for least, seg in group:
                keys = []
                for a, b in kind_windows(seg):
                    w = seg[a:b]
                    key: object = xxhash.xxh3_128_digest(w)
                    had = best.get(key)
                    if had is not None and had[1] != w:
                        key = w  # two windows of one name: by their bytes then
                        had = best.get(key)
                    if had is None or least < had[0]:
                        best[key] = (least, w)
                    keys.append(key)
                named.append(keys)
            done.append([spans_of(np.array([i for i, k in enumerate(keys) if best[k][0] < least], np.int64), window) for (least, _), keys in zip(group, named)])
        return done

    return compare


def _spans(segments: DataFrame, kind: Kind) -> DataFrame:
    """oid, tkey, a, b: units of a document that a document with a smaller identifier has too, segment by segment."""

    def compared(rows: pa.Table):
        """Parts of the rows of whole anchors, ordered by anchor and segment."""
        anchor, oid, tkey, at = (rows.column(c).to_numpy() for c in ("anchor", "oid", "tkey", "at"))
        segs = rows.column("seg").combine_chunks()
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        starts = np.flatnonzero(new_anchor | np.append(True, pc.not_equal(segs[1:], segs[:-1]).to_numpy(zero_copy_only=False)))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(oid))))  # each row's segment
        least = np.minimum.reduceat(oid, starts)
        later = oid > least[of]
        whole = np.flatnonzero(later)
        if len(whole):
            yield _spans_batch(oid[whole], tkey[whole], at[whole], at[whole] + kind.sizes(segs.take(pa.array(starts))).to_numpy()[of[whole]])
        opens = np.flatnonzero(new_anchor[starts])
        n = np.diff(np.append(opens, len(starts)))  # an anchor's segments
        several = np.flatnonzero(np.repeat(n > 1, n))
        if not len(several):
            return
        flat = list(zip(least[several].tolist(), segs.take(pa.array(starts[several])).to_pylist()))
        found: list[tuple[int, int, int]] = []  # segment, from, to

        def flush(since: int, groups: list) -> None:
            i = since
            for parts in kind.compare(groups):
                for each in parts:
                    found.extend((i, x, y) for x, y in each)
                    i += 1

        since = upto = size = 0
        groups: list[list[tuple[int, bytes]]] = []
        for k in n[n > 1].tolist():
            groups.append(flat[upto : upto + k])
            upto += k
            size += sum(len(s) + 1 for _, s in groups[-1])
            if size > SHARD_BYTES:
                flush(since, groups)
                since, groups, size = upto, [], 0
        flush(since, groups)
        if found:
            which, x, y = np.array(found, np.int64).T
            which = several[which]
            own = np.flatnonzero(~later)  # those that are later lose the segment as a whole
            low = np.searchsorted(of[own], which)
            times = np.searchsorted(of[own], which, "right") - low
            row = own[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
            yield _spans_batch(oid[row], tkey[row], at[row] + np.repeat(x, times), at[row] + np.repeat(y, times))

    def shard(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            last = b.column("anchor")[-1]
            if size > 4 * SHARD_BYTES and held[0].column("anchor")[0] != last:
                rows = pa.Table.from_batches(held)
                cut = int(np.searchsorted(rows.column("anchor").to_numpy(), last.as_py()))
                yield from compared(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from compared(pa.Table.from_batches(held))

    return segments.repartition("anchor").sortWithinPartitions("anchor", "seg").mapInArrow(shard, _SPANS)


def _packed(df: DataFrame) -> DataFrame:
    """A checkpoint of rows as compressed Arrow batches."""

    def pack(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    def unpack(batches):
        for b in batches:
            for x in b.column("batch").to_pylist():
                yield from pa.ipc.open_stream(x)

    return checkpoint(df.mapInArrow(pack, "batch binary")).mapInArrow(unpack, df.schema)


def _hot_spans(segments: DataFrame, kind: Kind) -> DataFrame:
    """What _spans() returns, of anchors with very many segments.

    Most of such a segment's windows are one text's own, around a passage that many have. Hashes of windows, grouped as anchors are, tell which recur; segments are cut down to
    those, so what is left are the passages, equal for the most part. Of equal pieces all but those with the smallest identifier are repeats as a whole, and add nothing to
    what the first ones have; the first ones' windows are grouped by SHA-256, a row each.
    """
    window = kind.window

    def names(seg: bytes):
        found = np.array([xxhash.xxh3_64_intdigest(seg[x:y]) for x, y in kind.windows(seg)], np.uint64)
        yield np.arange(len(found)), np.ones(len(found), np.int64), found

    by_window = _shortened(replace(kind, units=lambda seg: seg, anchors=names), 32 + _home_bits(segments.sparkSession))
    each = _anchors(segments.select(F.lit(0).cast("long").alias("row"), "tkey", F.col("seg").alias("text")), by_window, None, None)
    again = written(each.groupBy("bucket", "anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    filters = _filters(again, again.count())
    discard(again)

    def cut(rows: list[tuple], keys: list[np.ndarray]):
        hit, upto, out = _passing(np.concatenate(keys), filters) if keys else None, 0, []
        for (oid, tkey, at, seg), own in zip(rows, keys):
            there = np.flatnonzero(hit[upto : upto + len(own)])
            upto += len(own)
            where = kind.windows(seg) if len(there) else []
            for x, y in spans_of(there, 1):
                out.append((oid, tkey, at + x, at + y - 1 + window, seg[where[x][0] : where[y - 1][1]]))
        if out:
            yield _batch(out, _PIECE)

    def trim(batches):
        rows, keys, n = [], [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("oid", "tkey", "at", "seg"))):
                rows.append(row)
                keys += [key for *_, key in by_window.anchors(row[-1])]
                n += len(keys[-1])
                if n > HELD_ANCHORS:
                    yield from cut(rows, keys)
                    rows, keys, n = [], [], 0
        yield from cut(rows, keys)

    pieces = _packed(segments.mapInArrow(trim, f"{_SPANS}, seg binary")).withColumn("w", F.unhex(F.sha2("seg", 256)))
    first = pieces.join(pieces.groupBy("w").agg(F.min("oid").alias("oid")), ["w", "oid"], "left_semi")

    def explode(batches):
        for b in batches:
            for oid, tkey, a, seg in zip(*(b.column(c).to_pylist() for c in ("oid", "tkey", "a", "seg"))):
                w = [hashlib.sha256(seg[x:y]).digest() for x, y in kind.windows(seg)]
                n = len(w)
                yield pa.RecordBatch.from_arrays([pa.array([oid] * n, pa.int64()), pa.array([tkey] * n, pa.int64()), pa.array(range(a, a + n), pa.int64()), pa.array(w, pa.binary())], ["oid", "tkey", "a", "w"])

    each = first.select("oid", "tkey", "a", "seg").mapInArrow(explode, "oid long, tkey long, a long, w binary")
    return _not_first(pieces, "w").select("oid", "tkey", "a", "b").unionByName(_not_first(each, "w").select("oid", "tkey", "a", (F.col("a") + window).alias("b")))


def _not_first(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose oid isn't the smallest of their name. A name and its smallest oid are one key of the join, so the rows of a frequent name are spread by oid."""
    return rows.join(rows.groupBy(name).agg(F.min("oid").alias("oid")), [name, "oid"], "left_anti")


def repeats(docs: DataFrame, kind: Kind, same: Column, most_anchors: int = MOST_ANCHORS, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """doc_id, text -> doc_id, text (compressed: unpacked()), parts (array of (a, b), units to remove, unsorted and overlapping; null: none).

    same: a digest of the text as a Column; texts with equal digests are copies. A null text is an empty one. A null
    identifier counts as larger than any other (and as equal to 2 ** 63 - 1). Rows with the same identifier don't repeat each other.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("oid"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    rows = rows.withColumn("row", F.xxhash64("oid", "tkey"))
    digests = checkpoint(rows.groupBy("oid", "tkey", same.alias("digest")).agg(F.count(F.lit(1)).alias("n")))
    sc, twice = docs.sparkSession.sparkContext, digests.where("n > 1")
    first = digests.groupBy("digest").agg(F.min_by(F.xxhash64("oid", "tkey"), "oid").alias("anchor"))
    leading, n_twice = sc.broadcast(_bloom(first, digests.count())), twice.count()
    twins = sc.broadcast(_bloom(twice.select(F.col("tkey").alias("anchor")), n_twice)) if n_twice else None
    kind = _shortened(kind, 32 + _home_bits(docs.sparkSession))
    grouped = _anchors(rows, kind, leading, twins).groupBy("bucket", "anchor").agg(F.min("tkey").alias("x"), F.max("tkey").alias("y"), F.count_if(F.col("tkey") == 0).alias("single"), F.sum("k").alias("k"))
    shared = written(grouped.where("x != y OR single > 1").select("anchor", "k"))
    hot = shared.where(F.col("k") > most_segments).select("anchor").toArrow().column("anchor").to_numpy()
    n_shared = shared.count()
    found = _spans(_segments(rows, kind, shared.select("anchor"), n_shared, most_anchors, leading, hot), kind)
    if n_shared <= most_anchors:
        discard(shared)
    if len(hot):
        found = found.unionByName(_hot_spans(_packed(_segments(rows, kind, shared, 0, most_anchors, leading, hot, True)), kind))
    found = found.select("oid", "tkey", F.struct("a", "b").alias("part"))
    copies = _not_first(digests, "digest").select("oid", "tkey", F.struct(F.lit(0).cast("long").alias("a"), F.lit(_END).cast("long").alias("b")).alias("part"))
    parts = found.unionByName(copies).groupBy("oid", "tkey").agg(F.collect_list("part").alias("parts"))

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("oid"), b.column("tkey"), packed], ["doc_id", "oid", "tkey", "packed"])

    # whole texts move once, to meet their parts, and move compressed
    texts = rows.select("doc_id", "oid", "tkey", "text").mapInArrow(pack, "doc_id long, oid long, tkey long, packed binary")
    return texts.join(parts, ["oid", "tkey"], "left").select("doc_id", F.col("packed").alias("text"), "parts")


def unpacked(text: bytes) -> bytes:
    """UTF-8 of a text that repeats() returned."""
    return zstandard.ZstdDecompressor().decompress(text)


def union(parts: Iterable[dict] | None, n: int, window: int) -> list[tuple[int, int]]:
    """Maximal runs to remove of n units."""
    out: list[tuple[int, int]] = []
    if n < window:
        return out
    for a, b in sorted((p["a"], min(p["b"], n)) for p in parts or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
