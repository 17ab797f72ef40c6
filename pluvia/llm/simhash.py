"""SimHash near-dedup: fingerprints, links within a radius by BK-trees, and their components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import by_key, checkpoint, small_batches
from pluvia.llm.components import components

#: Words of a shingle, and the differing bits at which fingerprints still link.
WORDS, RADIUS = 3, 2
_BLOCK = 1 << 15
#: Fingerprints of a shard's tree, about; larger shards are split.
TREE = 20_000


def shingles(text: str | None, words: int = WORDS):
    """Blocks of the XXH64 (seed 42) of the text's shingles, repeats included; nothing without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z alone
    if not w:
        return
    n, step = max(1, len(w) - words + 1), _BLOCK
    for at in range(0, n, step):
        upto = min(n, at + step)
        part = w[at : upto + words - 1]
        columns = [part[j : j + upto - at] for j in range(min(words, len(w)))]
        yield np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*columns))), "<u8", upto - at)


def set_bits(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that are set in over half of n."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingles(text, words):
        n += len(h)
        ones += set_bits(h)
    return majority(ones, n)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (long: the 64 bits as signed) of every whole text; null: as empty, zero."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Distinct fingerprints; children hang on edges named by their whole Hamming distance to the parent. Built and searched level by level."""

    def __init__(self, values: np.ndarray):
        self.values = np.asarray(values, np.uint64)
        edges, to = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        left = np.arange(1, len(self.values))
        at = np.zeros(len(left), np.int64)
        while len(left):
            edge = at * 65 + np.bitwise_count(self.values[at] ^ self.values[left])
            found, first, own = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(found)
            to.append(left[first])
            at, child = left[first][own], np.zeros(len(left), bool)
            child[first] = True
            left, at = left[~child], at[~child]
        edge, to = np.concatenate(edges), np.concatenate(to)
        order = np.argsort(edge)
        #: parent * 65 + distance, ascending, and the child there
        self.edge, self.to = edge[order], to[order]

    def near(self, queries: np.ndarray, radius: int):
        """Blocks of (place of a query, place of a value within the radius of it); only edges within it of the parent's distance are followed."""
        step = max(1, (1 << 20) // max(1, len(self.values)))
        for begin in range(0, len(queries) if len(self.values) else 0, step):
            q = np.arange(begin, min(len(queries), begin + step))
            at = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[at]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], at[hit]
                lo = np.searchsorted(self.edge, at * 65 + np.maximum(d - radius, 0))
                n = np.searchsorted(self.edge, at * 65 + np.minimum(d + radius, 64), "right") - lo
                ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, at = np.repeat(q, n), self.to[np.repeat(lo, n) + ramp]


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of a forest (each the smallest place of its tree) after links a-b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _forest(fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, a smaller node of its tree) for nodes that links of this group join."""
    order = np.argsort(nodes, kind="stable")
    fps, nodes = fps[order], nodes[order]
    root = np.arange(len(fps))
    for q, v in BKTree(fps).near(fps, radius):
        root = join(root, q, v)
    own = np.flatnonzero(root != np.arange(len(fps)))
    return nodes[own], nodes[root[own]]


def masks(bits: list[int], radius: int) -> list[int]:
    """Choices of these bits: two fingerprints within the radius agree on all bits of one choice at least.

    The bits are dealt to radius + 2 blocks; at most `radius` blocks differ, so two agree, and each pair of blocks is a choice.
    """
    blocks = [bits[i * len(bits) // (radius + 2) : (i + 1) * len(bits) // (radius + 2)] for i in range(radius + 2)]
    return [sum(1 << b for block in pair for b in block) for pair in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(choices: list[int], under) -> F.Column:
    return F.array(*[F.xxhash64(under, F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(choices)])


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Distinct fp with its node -> u, v: links that join the same nodes as all pairs within the radius do.

    Shards: fingerprints that agree on one of the masks() of all bits; a shard's task builds its BK-tree and queries it, and of the
    pairs found a spanning forest goes on. A shard of more than `tree` fingerprints is split by the masks() of the bits that its own mask leaves free. With
    radius 2 that fixes 48 bits, so a split shard has 65,536 distinct fingerprints at most, whatever the input.
    """
    spark = distinct.sparkSession
    small_batches(spark, 10_000)
    first = masks(list(range(64)), radius)
    second = [[m | x for x in masks([b for b in range(64) if not m >> b & 1], radius)] for m in first]
    keyed = distinct.select("fp", "node", F.posexplode(_keys(first, F.lit(0))).alias("nth", "shard"))
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    split = F.when(F.col("n") <= tree, F.array("shard"))
    for k, choices in enumerate(second):
        split = split.when(F.col("nth") == k, _keys(choices, F.col("shard")))
    dealt = keyed.join(sizes, "shard").select("fp", "node", F.explode(split).alias("shard"))

    def run(batches):
        for shard in by_key(batches, ["shard"]):
            fps, nodes = (np.asarray(shard.column(c)) for c in ("fp", "node"))
            if len(fps) > 1:
                u, v = _forest(fps.view(np.uint64), nodes, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach, itself included; one row for each input row.

    Equal fingerprints are one node, so copies are never paired. Texts without words have fingerprint zero and link like any
    other. A document with a null doc_id keeps it and takes the component of the others; component_id is null where no document of it has an identifier.
    Rows that share a doc_id are judged each by its own text. An empty table gives no rows; other columns are ignored.
    """
    fps = checkpoint(fingerprints(docs, words))
    # a fingerprint is its own node, since one doc_id may have several
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(least, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
