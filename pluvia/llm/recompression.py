"""Substring dedup over words by recompression."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import SPACE
from pluvia.llm.repeats import Kind, hashed, repeats, union, unpacked

#: Words of a window; rounds of recompression; neighbouring symbols of the highest level that are an anchor together.
WINDOW, ROUNDS, CHAIN = 50, 4, 3
_PIECE = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def rounds(names: np.ndarray, n_rounds: int):
    """Levels of symbols, from words up: (names, from, to), where [from, to) are the words that determine a symbol.

    A symbol's class, left or right, is a bit of its name. In a round, equal neighbours, and a left one with a right one
    that follows, become one symbol: a run, or a pair of runs. Its name is a hash of its symbols, so all tasks name alike without
    meeting. Whether a symbol ends where it does depends on itself and its two neighbours, which is what [from, to) grows by;
    at the ends of the sequence, where a neighbour is missing, a symbol's range is unbounded.
    """
    n = len(names)
    lo, hi = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    yield names, lo, hi
    for k in range(n_rounds):
        right = (_mix(names + np.uint64(2 * k + 1)) >> np.uint64(40) & np.uint64(1)).astype(bool)
        joined = (names[:-1] == names[1:]) | (~right[:-1] & right[1:])
        start = np.flatnonzero(np.append(True, ~joined))
        end = np.append(start[1:], len(names)) - 1
        merged = _mix(np.add.reduceat(_mix(names + np.uint64(2 * k + 2)), start))
        lo = np.where(start > 0, lo[start - 1], -1)
        hi = np.where(end < len(names) - 1, hi[np.minimum(end + 1, len(names) - 1)], 1 << 40)
        names = merged
        yield names, lo, hi


def anchors(words: list[bytes], window: int = WINDOW, n_rounds: int = ROUNDS):
    """Blocks of (first window, number of windows, anchor): the smallest name among the chains of symbols of the highest level
    that the window's own words determine; where it determines no chain, among its symbols of the highest level that it does.
    Single words are the lowest level, so every window has one. Chains are long enough to be rarely shared by chance."""
    for at in range(0, len(words) - window + 1, _PIECE):
        part = words[at : at + _PIECE + window - 1]
        n = len(part) - window + 1
        names = np.fromiter(map(xxhash.xxh64_intdigest, part), np.uint64, len(part))
        found, left = np.zeros(n, np.uint64), np.ones(n, bool)
        levels = list(rounds(names, n_rounds))
        s, lo, hi = levels[-1]
        if len(s) >= CHAIN:
            chain = s[: len(s) - CHAIN + 1].copy()
            for j in range(1, CHAIN):
                chain = _mix(chain) + s[j : len(s) - CHAIN + 1 + j]
            levels.append((_mix(chain), lo[: len(chain)], hi[CHAIN - 1 :]))
        for level, (s, lo, hi) in reversed(list(enumerate(levels))):
            # windows are [p, p + window): the first symbol determined from p on, the last determined by p + window
            first = np.cumsum(np.bincount(np.clip(lo + 1, 0, len(part) + 1), minlength=len(part) + 2))[:n]
            last = np.cumsum(np.bincount(np.clip(hi, 0, len(part) + 1), minlength=len(part) + 2))[window : window + n]
            todo = np.flatnonzero(left & (last > first))
            if len(todo):
                f, wide = first[todo], last[todo] - first[todo]
                value = _mix(s ^ np.uint64(level << 1 | 1))
                power = np.frexp(wide.astype(np.float64))[1] - 1
                best = np.empty(len(todo), np.uint64)
                table, size = value, 1
                for p in range(int(power.max()) + 1):
                    own = power == p
                    best[own] = np.minimum(table[f[own]], table[f[own] + wide[own] - size])
                    if len(table) > size:
                        table = np.minimum(table[:-size], table[size:])
                    size *= 2
                found[todo] = best
                left[todo] = False
            if not left.any():
                break
        edge = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        yield edge + at, np.diff(np.append(edge, n)), found[edge]


def _units(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def kind(window: int = WINDOW, n_rounds: int = ROUNDS) -> Kind:
    def windows(seg: bytes):
        ends = np.append(np.flatnonzero(np.frombuffer(seg, np.uint8) == 32), len(seg)).tolist()
        return [(ends[i - 1] + 1 if i else 0, ends[i + window - 1]) for i in range(len(ends) - window + 1)]

    return Kind(window, _units, lambda words: anchors(words, window, n_rounds), lambda words, a, b: b" ".join(words[a:b]), lambda segs: pc.add(pc.count_substring(segs, " ").cast(pa.int64()), 1), windows, hashed(windows, window))


def dedup(docs: DataFrame, window: int = WINDOW, n_rounds: int = ROUNDS, **limits) -> DataFrame:
    """Removes each word that a window covers whose words also start in a document with a smaller identifier.

    Words are runs of characters other than space and U+0009 to U+000D, unchanged; windows are judged on the input. Symbols
    name tokens' runs and pairs round by round (see rounds()): by hashes, since naming through an exchange a round would move three times the
    input (README). A window's anchor is one of its interior symbols of the highest
    level, symbols that several texts share reveal candidates, and windows are verified word by word (see repeats.py).
    A null text has no words; a null identifier counts as larger than any other; rows with one identifier don't repeat each other.
    An empty table gives no rows; other columns are ignored.
    Returns doc_id, n_words, n_removed, n_spans, kept (the words that stay, joined by a space), kept_sha256.
    """
    same = F.sha2(F.trim(F.regexp_replace("text", SPACE, " ")), 256)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "parts"))):
                words = unpacked(text).split()
                gone = union(parts, len(words), window)
                stays, at = [], 0
                for x, y in gone:
                    stays += words[at:x]
                    at = y
                kept = b" ".join(stays + words[at:])
                out.append((doc_id, len(words), sum(y - x for x, y in gone), len(gone), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    found = repeats(docs.select(F.col("doc_id").cast("long"), "text"), kind(window, n_rounds), same, **limits)
    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, n_spans long, kept string, kept_sha256 string")
