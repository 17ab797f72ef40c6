"""Collocations: phrases counted by tries of word ids whose leaves are hash containers that burst, and scored against their parts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.common import LOWER, UPPER, by_key, small_batches, written

#: Bits of a word's id within a task; ids are given out anew once MOST_WORDS are in use.
_BITS = 21
MOST_WORDS = 400_000
#: Entries of a container before it bursts, of one of its prefixes to get a container of its own, and of a task's tries before subtrees are spilled.
BURST, CHILD, MOST_ENTRIES = 200_000, 2_000, 1_200_000
#: Words counted at a time, and bytes of text for each prefix partition.
CHUNK, PARTITION_BYTES = 300_000, 512 << 10
#: A-Z, what ends a piece (as a full stop), and a tab (as a space). No word has a full stop or a tab.
_TABLE = bytes.maketrans(UPPER.encode() + b",;:!?\n\x0b\x0c\r\t", LOWER.encode() + b"." * 9 + b" ")


class Words(dict):
    """Ids of words in the order of their first use; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def leaves_of(ids: np.ndarray, starts: int) -> np.ndarray:
    """Codes of what begins at the first `starts` places: each word by itself, and each pair with the word after it (0: the piece ends). A code has the ids from the left.
    The count of a pair is the sum of its leaves', as that of any inner node of a trie."""
    one = ids[:starts]
    two, three = (np.concatenate([ids[k : k + starts], np.zeros(max(0, len(one) + k - len(ids)), np.int64)])[: len(one)] for k in (1, 2))
    first = one << (2 * _BITS)
    pair = (one > 0) & (two > 0)
    return np.concatenate([first[one > 0], (first | two << _BITS | three)[pair]])


class Trie:
    """Counts of leaves (see leaves_of()) below a root of one language. A container is a hash table of codes; one that has grown over BURST bursts: beginnings with many
    phrases get a node of their own, and what is left stays together. Nodes are keyed by the first word; a node that grows too large bursts by the second."""

    def __init__(self, depth: int = 0) -> None:
        self.depth, self.nodes, self.rest = depth, {}, Counter()
        self.bursts_at = BURST

    def shift(self) -> int:
        return _BITS * (2 - self.depth)

    def add(self, codes: np.ndarray, counts: np.ndarray | None = None) -> None:
        if self.nodes:
            first = codes >> self.shift()
            own = np.isin(first, np.fromiter(self.nodes, np.int64))
            if own.any():
                order = np.argsort(first[own], kind="stable")
                inner, heads = codes[own][order], first[own][order]
                weights = None if counts is None else counts[own][order]
                cuts = [0, *(np.flatnonzero(np.diff(heads)) + 1).tolist(), len(heads)]
                for a, b in zip(cuts, cuts[1:]):
                    self.nodes[int(heads[a])].add(inner[a:b], None if weights is None else weights[a:b])
                codes, counts = codes[~own], None if counts is None else counts[~own]
        if counts is None:
            self.rest.update(codes.tolist())
        else:  # of a container that bursts: each code once, and nothing here yet
            dict.update(self.rest, zip(codes.tolist(), counts.tolist()))
        if len(self.rest) > self.bursts_at and self.depth < 2:
            self.burst()

    def burst(self) -> None:
        codes, counts = self.entries(own=True)
        heads, n = np.unique(codes >> self.shift(), return_counts=True)
        large = heads[n >= CHILD]
        for h in large.tolist():
            self.nodes[h] = Trie(self.depth + 1)
        self.rest = Counter()
        self.bursts_at = 1 << 62
        self.add(codes, counts)
        self.bursts_at = max(BURST, 2 * len(self.rest))

    def entries(self, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.rest)
        codes, counts = [np.fromiter(self.rest.keys(), np.int64, n)], [np.fromiter(self.rest.values(), np.int64, n)]
        for node in () if own else self.nodes.values():
            c, k = node.entries()
            codes.append(c)
            counts.append(k)
        return np.concatenate(codes), np.concatenate(counts)

    def __len__(self) -> int:
        return len(self.rest) + sum(map(len, self.nodes.values()))

    def largest(self, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Takes out whole subtrees, the largest ones first, until they have `least` entries."""
        out, taken = [], 0
        for head in sorted(self.nodes, key=lambda h: -len(self.nodes[h])):
            if taken >= least:
                return out
            out.append(self.nodes.pop(head).entries())
            taken += len(out[-1][0])
        if taken < least:
            out.append(self.entries(own=True))
            self.rest, self.bursts_at = Counter(), BURST
        return out


class Counting:
    """Counts of one task: a trie a language, and the sorted runs that it spills."""

    def __init__(self, partitions: int) -> None:
        self.partitions, self.words = partitions, Words()
        self.tries: dict[str, Trie] = {}
        self.press = zstandard.ZstdCompressor(level=1)
        self.waiting: dict[str, list[list[int]]] = {}
        self.n_waiting = 0

    def text(self, lang: str, text: bytes) -> Iterator[tuple]:
        words = text.translate(_TABLE).replace(b".", b" . ").split()
        words.append(b".")
        if len(words) <= CHUNK:
            ids = list(map(self.words.__getitem__, words))
            self.waiting.setdefault(lang, []).append(ids)
            self.n_waiting += len(ids)
            if self.n_waiting > CHUNK:
                yield from self.count()
        else:  # in stretches; phrases that begin in one go on into the next
            yield from self.count()
            for at in range(0, len(words), CHUNK):
                part = words[at : at + CHUNK + 2]
                yield from self.add(lang, np.fromiter(map(self.words.__getitem__, part), np.int64, len(part)), CHUNK)
                yield from self.forget()

    def count(self) -> Iterator[tuple]:
        waiting, self.waiting, self.n_waiting = self.waiting, {}, 0
        for lang, some in waiting.items():
            ids = np.concatenate([np.array(x, np.int64) for x in some])
            yield from self.add(lang, ids, len(ids))
        yield from self.forget()

    def add(self, lang: str, ids: np.ndarray, starts: int) -> Iterator[tuple]:
        self.tries.setdefault(lang, Trie()).add(leaves_of(ids, starts))
        if sum(map(len, self.tries.values())) > MOST_ENTRIES:
            yield from self.spill(MOST_ENTRIES // 2)

    def forget(self) -> Iterator[tuple]:
        """Words whose ids nothing uses any more, once they are many."""
        if len(self.words) > MOST_WORDS:
            yield from self.spill()
            self.words = Words()

    def spill(self, least: int | None = None) -> Iterator[tuple]:
        """Runs of whole subtrees, or of everything."""
        words = list(self.words)  # in the order of their ids; the first is a piece's end
        ends = [x + b"\t" for x in words]
        marks = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        taken = 0
        for lang in sorted(self.tries, key=lambda x: -len(self.tries[x])):
            if least is not None and taken >= least:
                break
            trie = self.tries[lang]
            if least is None:
                parts = [trie.entries()]
                self.tries[lang] = Trie()
            else:
                parts = trie.largest(least - taken)
            codes, counts = (np.concatenate(x) for x in zip(*parts))
            taken += len(codes)
            yield from self.run(lang, codes, counts, words, ends, marks)

    def run(self, lang: str, codes: np.ndarray, counts: np.ndarray, words: list[bytes], ends: list[bytes], marks: np.ndarray) -> Iterator[tuple]:
        """partition, lang, blob: the phrases of a prefix partition (phrases with the same first two words are in one), sorted, each with a tab and its count (if it isn't 1)."""
        first = np.argsort(codes)  # neighbours share words, which then are at hand
        codes, counts, mask = codes[first], counts[first], (1 << _BITS) - 1
        w = [codes >> (_BITS * (2 - k)) & mask for k in range(3)]
        prefix = marks[w[0]] * np.uint64(0x9E3779B97F4A7C15) + marks[w[1]] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(zlib.crc32(lang.encode("utf-8", "surrogatepass")))
        partition = ((prefix >> np.uint64(32)) % np.uint64(self.partitions)).astype(np.int64)
        made = np.empty(len(codes), object)
        for k, own in ((0, np.flatnonzero(w[1] == 0)), (2, np.flatnonzero(w[1]))):
            ids = [x[own].tolist() for x in w[: k + 1]]
            made[own] = list(map(b" ".join, zip(*(map(words.__getitem__, x) for x in ids[:-1]), map(ends.__getitem__, ids[-1]))))
        many = np.flatnonzero(counts > 1)
        made[many] += np.array([b"%d" % n for n in counts[many].tolist()], object)
        order = np.argsort(partition, kind="stable")
        partition, lines = partition[order], made[order].tolist()
        cuts = [0, *(np.flatnonzero(np.diff(partition)) + 1).tolist(), len(lines)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(partition[a]), lang, self.press.compress(b"\n".join(sorted(lines[a:b])))

    def done(self) -> Iterator[tuple]:
        yield from self.count()
        yield from self.spill()


def merged(runs: Iterable[bytes], least: int) -> tuple[int, list[tuple[bytes, int]]]:
    """Words in all (the counts of phrases of one word), and the phrases of sorted runs with counts of `least` or more. Concatenated runs are merged by the sort, which finds and keeps their order."""
    press = zstandard.ZstdDecompressor()
    lines = [x for blob in runs for x in press.decompress(blob).split(b"\n")]
    lines.sort()
    lines.append(b"\t0")
    words, out, now, n, pair, both = 0, [], b"", 0, b"", 0
    for line in lines:
        phrase, _, k = line.partition(b"\t")  # no word has a tab or a space, so entries of a phrase are neighbours, and leaves of a pair
        if phrase != now:
            front, _, last = now.rpartition(b" ")
            if front:
                if front != pair:
                    if both >= least:
                        out.append((pair, both))
                    pair, both = front, 0
                both += n
            else:
                words += n
            if n >= least and last != b".":
                out.append((now, n))
            now, n = phrase, 0
        n += int(k) if k else 1
    if both >= least:
        out.append((pair, both))
    return words, out


def counted(docs: DataFrame, least: int = 10) -> DataFrame:
    """lang, words (1 to 3; 0 for the row of all words of a part of the language), phrase, f: counts of all phrases that occur `least` times or more, and of all words.

    Each task counts in tries and spills sorted runs by prefix partition; a partition's runs are merged in one task, which holds one partition at a time. The number of partitions grows with the text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    partitions = max(1024, (docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) // PARTITION_BYTES)

    def count(batches):
        task = Counting(partitions)

        def packed(some):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.int64(), pa.string(), pa.binary()))], ["partition", "lang", "blob"])

        def runs():
            for b in batches:
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                    yield from task.text(lang, text)
            yield from task.done()

        some = []
        for row in runs():
            some.append(row)
            if len(some) == 4096:
                yield packed(some)
                some = []
        if some:
            yield packed(some)

    def merge(batches):
        for t in by_key(batches, ["partition", "lang"]):
            words, found = merged(t.column("blob").to_pylist(), least)
            if words:
                found.append((b"", words))
            if found:
                phrase, f = zip(*found)
                n = [p.count(b" ") + 1 if p else 0 for p in phrase]
                lang = t.column("lang")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(n, pa.int32()), pa.array(phrase, pa.binary()), pa.array(f, pa.int64())], ["lang", "words", "phrase", "f"])

    runs = rows.mapInArrow(count, "partition long, lang string, blob binary")
    dealt = runs.repartition("partition").sortWithinPartitions("partition", "lang")
    return dealt.mapInArrow(merge, "lang string, words int, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string"))


def _first(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def _part(rows: DataFrame, parts: DataFrame, key: str, out: str, salts: int = 8) -> DataFrame:
    """rows with the count of the phrase in column key, which is in parts (columns lang, phrase, f). A frequent word begins many phrases, so rows are spread and parts repeated `salts` times."""
    there = parts.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), F.col("f").alias(out), F.explode(F.array(*map(F.lit, range(salts)))).alias("__at"))
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int"))
    return spread.join(there, (F.col("lang") == F.col("__lang")) & (F.col(key) == F.col("__phrase")) & (F.col("__salt") == F.col("__at"))).drop("__lang", "__phrase", "__at", "__salt")


def collocations(docs: DataFrame, least: int = 10, top: int | None = 2000) -> DataFrame:
    """Phrases of two or three words of each language whose words come together more often than apart.

    Texts are lower-cased (A-Z) and split into pieces at . , ; : ! ? and U+000A to U+000D, pieces into words at spaces and tabs; overlapping occurrences all count. A candidate
    occurs `least` times or more (a). A cut after its first k words gives l and r, the counts of both parts, and the score floor(1000000 * a * a / (l * r)); the lowest-scoring cut counts,
    of equal ones that with the smallest k. A candidate goes if it lies in a longer candidate with at least half its occurrences, kept or not.
    Numbers are exact: decimals of 38 digits, enough for a up to 10 ** 15.

    A null language is `und`, as that value itself; a null text is empty; repeated rows count each; an empty table gives no rows; other columns are ignored.
    Returns lang, rank, phrase, a, l, r, n (words of the language), score: the first `top` of each language (None: all) by score and a, descending, and phrase in the order of its bytes.
    """
    return scored(written(counted(docs, least)), top)


def scored(found: DataFrame, top: int | None) -> DataFrame:
    """The collocations among counted phrases (see counted())."""
    many = found.where("words > 0").select("lang", "words", "phrase", "f")
    n = found.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    cand = many.where("words > 1").withColumnRenamed("f", "a")
    cand = cand.withColumn("head", _first(F.col("phrase"), 1)).withColumn("tail", F.substring_index("phrase", " ", -1))
    ones, twos, threes = (many.where(F.col("words") == k) for k in (1, 2, 3))
    cand = _part(_part(cand, ones, "head", "l1"), ones, "tail", "r1")

    def score(left: str, right: str) -> Column:
        a = F.col("a").cast("decimal(19,0)")
        return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), F.col(left).cast("decimal(19,0)") * F.col(right).cast("decimal(19,0)"))

    pairs = cand.where("words = 2").select("lang", "phrase", "a", F.col("l1").alias("l"), F.col("r1").alias("r"), score("l1", "r1").alias("score"))
    long = cand.where("words = 3").withColumn("front", _first(F.col("phrase"), 2)).withColumn("back", F.substring_index("phrase", " ", -2))
    long = _part(_part(long, twos, "front", "l2"), twos, "back", "r2")  # cuts: l1 and r2 after one word, l2 and r1 after two
    long = long.withColumn("s1", score("l1", "r2")).withColumn("s2", score("l2", "r1")).withColumn("early", F.col("s1") <= F.col("s2"))
    triples = long.select("lang", "phrase", "a", F.when(F.col("early"), F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(F.col("early"), F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))
    around = threes.select("lang", F.explode(F.array(_first(F.col("phrase"), 2), F.substring_index("phrase", " ", -2))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    alone = pairs.join(around, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 50 * a").drop("longer")
    rows = alone.unionByName(triples)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # a language may have most of the rows: the first of each of 16 parts, then of those
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
