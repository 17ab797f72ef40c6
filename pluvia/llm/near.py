"""Near-dedup by likeness: texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more are joined.

Shards are the texts that agree on a band of their shingles' minima. A shard's first text meets all of it; then BK-trees of
SimHash fingerprints find, of the shard's other texts, the pairs that aren't joined yet. A pair whose minima differ too much for that
likeness goes no further; every other is verified on its whole texts before it counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm import simhash
from pluvia.llm.common import by_key, checkpoint, discard, small_batches, written
from pluvia.llm.components import components

#: Words of a shingle, and the likeness (a fraction, so that it is compared in whole numbers) from which texts are joined.
WORDS, LEAST = 5, (4, 5)
#: Texts share a shard if ROWS minima of some band are equal: of pairs with likeness 0.8, all but (1 - 0.8 ** ROWS) ** BANDS = 1.3e-7 do.
BANDS, ROWS = 40, 5
#: Differing bits of fingerprints up to which a pair is verified. At likeness 0.8, bits differ with probability 0.15: 9.7 of 64 expected, deviation 2.9.
RADIUS = 24
#: Equal minima, of BANDS * ROWS, from which a pair is verified. At likeness 0.8, 160 of 200 are expected, deviation 5.7: fewer than 130 have probability 2.5e-7.
EQUAL = 130
#: Shingles (and 256 a text) that one side of a verification task holds, about.
BLOCK = 1 << 20

_RANDOM = np.random.default_rng(5)
_FLIP, _TIMES = (_RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None] for _ in range(2))
_TIMES |= np.uint32(1)
_MIX = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def digest() -> Column:
    """Texts are told apart by it (128 bits of a SHA-256); null is as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)


def number(digest: Column) -> Column:
    """What stands for a digest in the graph, 63 bits; see apart()."""
    return F.xxhash64(digest).bitwiseAND(F.lit((1 << 63) - 1))


def apart(texts: DataFrame) -> DataFrame | None:
    """d, own: digests (of texts: d) that share a number with another one, with a negative number of their own. Of 3 * 10 ** 10 texts some fifty do; None if none does."""
    twice = texts.groupBy(number(F.col("d")).alias("t")).agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x != y")
    if not twice.count():
        return None
    both = texts.select("d", number(F.col("d")).alias("t")).join(twice.select("t"), "t", "left_semi").select("d").distinct()
    place = Window.orderBy("d")  # over these few
    return checkpoint(both.withColumn("own", -F.row_number().over(place).cast("long")))


def numbered(rows: DataFrame, own: DataFrame | None) -> DataFrame:
    """rows (with a digest d) with t, a number that no other text has."""
    if own is None:
        return rows.withColumn("t", number(F.col("d")))
    return rows.join(own, "d", "left").withColumn("t", F.coalesce("own", number(F.col("d")))).drop("own")


def signature(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """The fingerprint, a key for each band of minima, and a byte of each minimum, of the set of the text's shingles. Texts without words have the same."""
    h = shingle_set(text)
    least, ones, upper = np.full(BANDS * ROWS, ~np.uint32(0)), np.zeros(64, np.int64), (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        np.minimum(least, ((upper[at : at + 1024] ^ _FLIP) * _TIMES).min(axis=1), out=least)
        ones += simhash.set_bits(h[at : at + 1024])
    m = least.reshape(BANDS, ROWS).astype(np.uint64)
    k = ((m ^ (m << np.uint64(31))) * _MIX).sum(axis=1, dtype=np.uint64)
    k = (k ^ (k >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)
    return simhash.majority(ones, len(h)), k, (least ^ (least >> np.uint32(13))).astype(np.uint8)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Sets of hashes whose likeness is LEAST or more; two empty ones are."""
    if min(len(a), len(b)) * LEAST[1] < max(len(a), len(b)) * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *simhash.shingles(text, WORDS)]))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, d (the text's digest), fp, keys, minima (a byte of each, then four bytes of each key) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fps, keys, minima = zip(*map(signature, b.column("text").to_pylist()))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys).view(np.int64)))
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), listed, pa.array([m.tobytes() + k.astype("<u4").tobytes() for m, k in zip(minima, keys)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("d"), *made], ["doc_id", "d", "fp", "keys", "minima"])

    return docs.select(F.col("doc_id").cast("long"), digest().alias("d"), "text").mapInArrow(run, "doc_id long, d binary, fp long, keys array<long>, minima binary")


def _minima(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of minima and the parts of keys, a line a text."""
    lines = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return lines[:, : BANDS * ROWS], np.ascontiguousarray(lines[:, BANDS * ROWS :]).view("<u4")


def likely(pairs: DataFrame, minima: DataFrame) -> DataFrame:
    """key, u, v of those pairs (numbers) of which EQUAL minima or more are equal. minima: t, minima, one row a text."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                equal = (_minima(b.column("x"))[0] == _minima(b.column("y"))[0]).sum(axis=1)
                yield b.select(["key", "u", "v"]).filter(pa.array(equal >= EQUAL))

    both = pairs.join(minima.toDF("u", "x"), "u").join(minima.toDF("v", "y"), "v")
    return both.select("key", "u", "v", "x", "y").mapInArrow(run, "key long, u long, v long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs u, v (of key, u, v; numbers) whose whole texts are alike. texts: t, text.

    The texts of a key's pairs are dealt to parts of about BLOCK shingles; a task takes two parts (or one) with the pairs between them,
    so a text moves once a part that it has partners in, never once a pair.
    """
    small_batches(pairs.sparkSession)
    nodes = pairs.select("key", F.explode(F.array("u", "v")).alias("t")).distinct()
    ids = written(nodes.select("t").distinct())
    texts = written(texts.select("t", "text", (F.char_length("text") + 1024).alias("size")).join(ids, "t", "left_semi").dropDuplicates(["t"]))
    parts = nodes.join(texts.select("t", "size"), "t").groupBy("key").agg(F.ceil(F.sum("size") / F.lit(4 * BLOCK)).cast("int").alias("parts"))

    def part(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.col("parts")).cast("int")

    dealt = pairs.join(parts, "key").select("key", F.least(part("u"), part("v")).alias("a"), F.greatest(part("u"), part("v")).alias("b"), "u", "v")
    there = dealt.select("key", "a", "b", F.explode(F.array("u", "v")).alias("t")).distinct().join(texts, "t")
    rows = there.select("key", "a", "b", F.lit(0).alias("kind"), F.col("t").alias("u"), F.col("t").alias("v"), "text")
    rows = rows.unionByName(dealt.select("key", "a", "b", F.lit(1).alias("kind"), "u", "v", F.lit("").alias("text")))

    def run(batches):
        at, sets = None, {}
        for b in batches:
            us, vs = [], []
            for *block, kind, u, v, text in zip(*(b.column(c).to_pylist() for c in ("key", "a", "b", "kind", "u", "v", "text"))):
                if block != at:
                    at, sets = block, {}
                if kind == 0:
                    sets[u] = shingle_set(text)
                elif alike(sets[u], sets[v]):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    found = checkpoint(rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "kind").mapInArrow(run, "u long, v long"))
    discard(ids, texts)
    return found


def _apart(ask: pa.Table, tree: pa.Table, radius: int, twice: bool):
    """Blocks of pairs (place in ask, place in tree) of nodes that no component joins, within the radius and with EQUAL minima.

    A pair that shares an earlier band is left to that band's shard, if that isn't one of the hot ones (bits of `hot`). twice: ask and tree are the same nodes; of such
    a pair, one at least lies outside their largest component, so only those ask.
    """
    (fp, comp), (fps, comps) = ([np.asarray(x.column(c)) for c in ("fp", "component")] for x in (ask, tree))
    own = np.arange(len(fp))
    if twice:
        names, count = np.unique(comp, return_counts=True)
        own = np.flatnonzero(comp != names[np.argmax(count)])
    if not len(own) or not len(fps):
        return
    band = int(ask.column("band")[0].as_py())
    cold = (np.asarray(ask.column("hot"))[:, None] >> np.arange(band) & 1) == 0
    (mine, keys), (theirs, their_keys) = _minima(ask.column("minima")), _minima(tree.column("minima"))
    values, place = np.unique(fps.view(np.uint64), return_inverse=True)
    order = np.argsort(place, kind="stable")
    start = np.searchsorted(place[order], np.arange(len(values) + 1))
    for q, v in simhash.BKTree(values).near(fp[own].view(np.uint64), radius):
        n = start[v + 1] - start[v]
        ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q, v = own[np.repeat(q, n)], order[np.repeat(start[v], n) + ramp]
        apart = comp[q] != comps[v]
        q, v = q[apart], v[apart]
        for at in range(0, len(q), 1 << 14):
            x, y = q[at : at + (1 << 14)], v[at : at + (1 << 14)]
            there = ((mine[x] == theirs[y]).sum(axis=1) >= EQUAL) & ~((keys[x, :band] == their_keys[y, :band]) & cold[x]).any(axis=1)
            if there.any():
                yield x[there], y[there]


def _dealt(members: DataFrame, size: Column, most: int, more: DataFrame | None = None) -> DataFrame:
    """members dealt to parts of a key whose sizes add up to about `most`: each row once for each pair of parts (a, b) that its own part is in.

    Where a key has several parts, its largest component has parts of its own (the last ones), which don't meet each other.
    more: by node, what rows take along. It joins them on their way to the parts, so it moves once a row and isn't in the plan of the parts.
    """
    by_component = members.groupBy("key", "component").agg(F.sum(size).alias("size"))
    parts = by_component.groupBy("key").agg(F.sum("size").alias("all"), F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("large"), F.count(F.lit(1)).alias("apart")).where("apart > 1")

    def needed(size: Column) -> Column:
        return F.ceil(size / F.lit(most)).cast("int")

    one = F.col("all") <= most
    parts = parts.select("key", "main", F.when(one, 1).otherwise(needed(F.col("all") - F.col("large"))).alias("few"), F.when(one, 0).otherwise(needed(F.col("large"))).alias("many"))
    inside = (F.col("component") == F.col("main")) & (F.col("many") > 0)
    own = F.when(inside, F.col("few") + F.pmod(F.xxhash64("node"), F.greatest("many", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int")
    others = F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    spread = members.join(parts, "key").withColumn("own", own).withColumn("other", F.explode(others))
    spread = spread.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("main", "few", "many", "other")
    if more is not None:
        spread = spread.join(more, "node")
    return spread.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")


def _meetings(batches):
    """Of each (key, a, b): what asks, what is asked, and whether both are the same nodes."""
    for shard in by_key(batches, ["key", "a", "b"]):
        a, b, own = (np.asarray(shard.column(c)) for c in ("a", "b", "own"))
        one = shard.filter(pa.array(own == a))
        yield (one, one, True) if a[0] == b[0] else (shard.filter(pa.array(own != a)), one, False)


def hopeful(members: DataFrame, marks: DataFrame, radius: int = RADIUS, tree: int = simhash.TREE) -> DataFrame:
    """key, node: the members (key, band, node, component, hot) that _apart() finds a partner for in their shard. Never the pairs, of which a large shard may have very many.
    marks: node, fp, minima, one row a text."""
    small_batches(members.sparkSession, 10_000)

    def run(batches):
        for ask, other, twice in _meetings(batches):
            left, right = np.zeros(len(ask), bool), np.zeros(len(other), bool)
            for x, y in _apart(ask, other, radius, twice):
                left[x], right[y] = True, True
            for t, found in ((ask, left), (other, right)):
                if found.any():
                    yield from t.filter(pa.array(found)).select(["key", "node"]).combine_chunks().to_batches()

    dealt = _dealt(members, F.lit(1), tree, marks)
    return checkpoint(dealt.select("key", "a", "b", "own", "band", "hot", "fp", "node", "component", "minima").mapInArrow(run, "key long, node long").distinct())


def linked(members: DataFrame, marks: DataFrame, texts: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links u, v that join all nodes of a shard that verified pairs of _apart() join. Texts go to the shards, pairs stay in the tasks."""
    small_batches(members.sparkSession, 128)
    ids = written(members.select("node").distinct())
    texts = written(texts.select(F.col("t").alias("node"), "text", (F.char_length("text") + 1024).alias("size")).join(ids, "node", "left_semi").dropDuplicates(["node"]))

    def run(batches):
        for ask, other, twice in _meetings(batches):
            nodes = [np.asarray(t.column("node")) for t in (ask, other)]
            shift = 0 if twice else len(ask)
            sets, root = {}, list(range(len(ask) + len(other)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            def shingled(t: pa.Table, i: int, at: int) -> np.ndarray:
                if at not in sets:
                    sets[at] = shingle_set(t.column("text")[i].as_py())
                return sets[at]

            u, v = [], []
            for x, y in _apart(ask, other, radius, twice):
                for i, j in zip(x.tolist(), y.tolist()):
                    p, q = find(i), find(j + shift)
                    if p != q and alike(shingled(ask, i, i), shingled(other, j, j + shift)):
                        root[p] = q
                        u.append(nodes[0][i])
                        v.append(nodes[1][j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    dealt = _dealt(members.join(texts.select("node", "size"), "node"), F.col("size"), 4 * block, marks.join(texts.select("node", "text"), "node"))
    found = checkpoint(dealt.select("key", "a", "b", "own", "band", "hot", "fp", "node", "component", "minima", "text").mapInArrow(run, "u long, v long"))
    discard(ids, texts)
    return found


def cooled(members: DataFrame, keys: DataFrame, most: int = simhash.TREE) -> DataFrame:
    """members with the column hot, and without shards of over `most` nodes in several components: such a shard is divided by its nodes' other hot shards.

    A pair of likeness 0.8 shares 13 of 40 bands on average. If one of those is no hot shard, the pair is met there; else it shares two hot ones, but for a probability of 2.6e-6, and
    meets in the shard of those two. So a node makes a row a pair of its hot shards (780 at most), whatever their size. What is hot even so is dealt in parts.
    This is a first pass that joins most of a hot shard: near_copies() then deals the divided shards whole, so results don't depend on `most`.
    keys: the shard of each node, which are counted first: mostly none is large.
    """
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key")
    if not counted.count():
        return members.withColumn("hot", F.lit(0).cast("long"))
    large = members.select("key", "component").join(counted, "key", "left_semi").groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    large = checkpoint(large.where("x != y").select("key"))
    inside = members.join(large, "key", "left_semi")
    by_node = inside.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("band", "key"))).alias("own"), F.first("component").alias("component"))
    by_node = checkpoint(by_node.withColumn("hot", F.aggregate("own", F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), y["band"])))))
    pairs = by_node.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("own")))).where(F.col("i") < F.size("own"))
    pairs = pairs.withColumn("other", F.explode(F.slice("own", F.col("i") + 1, F.size("own")))).withColumn("key", F.xxhash64(F.element_at("own", F.col("i"))["key"], F.col("other")["key"]))
    pairs = pairs.select("key", F.lit(0).alias("band"), "node", "component", "hot")  # band 0: nothing is left to an earlier one
    rest = members.join(large, "key", "left_anti").join(by_node.select("node", "hot"), "node", "left").withColumn("hot", F.coalesce("hot", F.lit(0).cast("long")))
    return rest.select(pairs.columns).unionByName(pairs)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, d (the text's digest), component (a number) of each row: rows are in one component if alike texts link them, one after the other."""
    rows = checkpoint(signatures(docs))
    own = apart(rows.select("d"))
    rows = numbered(rows, own)
    texts = numbered(docs.select(digest().alias("d"), F.coalesce("text", F.lit("")).alias("text")), own).select("t", "text")
    keyed = rows.select("t", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("t").alias("first"), F.max("t").alias("last")).where("first != last").select("key", "first")
    members = checkpoint(keyed.join(shared, "key").distinct())
    once = checkpoint(rows.join(members.select("t").distinct(), "t", "left_semi").select("t", "fp", "minima").dropDuplicates(["t"]))
    met = members.where("first < t").groupBy(F.col("first").alias("u"), F.col("t").alias("v")).agg(F.min("key").alias("key"))
    edges = verified(checkpoint(likely(met, once.select("t", "minima"))), texts)
    found = checkpoint(components(edges))
    # a shard's first text is settled in it
    inside = members.where("first != t").select("key", "band", F.col("t").alias("node")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # shards that are one component by now need no more. Fingerprints and minima are no part of these rows: they join them on the way to a task, which keeps both rows and plans small
    several = checkpoint(inside.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key"))
    whole = checkpoint(inside.join(several, "key", "left_semi"))
    marks = once.withColumnRenamed("t", "node")
    rest = cooled(whole, whole.select("key"))
    chosen = checkpoint(rest.join(hopeful(rest, marks), ["key", "node"], "left_semi"))
    if not chosen.isEmpty():
        edges = edges.unionByName(linked(chosen, marks, texts))
        found = checkpoint(components(edges))
    cold = F.lit(0).cast("long").alias("hot")
    if not rest.sameSemantics(whole.select("*", cold)):
        # shards were divided: pairs that share one of them alone are met in it, as far as no component joins them by now
        left = whole.drop("component").join(rest.select("key").distinct(), "key", "left_anti").join(found, "node", "left")
        left = checkpoint(left.select("key", "band", "node", F.coalesce("component", "node").alias("component"), cold))
        chosen = checkpoint(left.join(hopeful(left, marks), ["key", "node"], "left_semi"))
        if not chosen.isEmpty():
            found = components(edges.unionByName(linked(chosen, marks, texts)))
    return rows.select("doc_id", "d", "t").join(found.withColumnRenamed("node", "t"), "t", "left").select("doc_id", "d", F.coalesce("component", "t").alias("component"))
