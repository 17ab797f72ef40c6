"""Substring dedup over bytes by suffix arrays of shards, built by induced sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.repeats import Kind, repeats, spans_of, union, unpacked

#: Bytes of a window, and of the strings whose smallest hash in a window is its anchor.
WINDOW, GRAM = 50, 16
_PIECE = 1 << 20


def _fit_s(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one that follows (type S); a smallest sentinel is thought behind the end."""
    n = len(t)
    d = np.append(np.sign(np.diff(t.astype(np.int32))), -1)
    at = np.where(d != 0, np.arange(n), n)
    return d[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """The order of all suffixes induced from that of the leftmost S suffixes: L suffixes from left to right, S from right to left.

    What a bucket puts into itself are the runs of its letter that lead to the suffixes it holds: they are laid out at once, the
    suffixes one letter back first, then those two back, and so on. Then the whole bucket puts into others, so each is passed once.
    """
    n = len(t)
    sizes = np.bincount(t, minlength=letters)
    head = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    tail = head + sizes
    sa = np.full(n, -1, np.int64)
    seeds = lms[np.argsort(t[lms], kind="stable")]
    cuts = np.searchsorted(t[seeds], np.arange(letters + 1))
    here, present = head.copy(), np.flatnonzero(sizes)
    opens = np.append(True, t[1:] != t[:-1])
    run = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))  # equal symbols just before

    def back(held: np.ndarray) -> np.ndarray:
        """held, then its suffixes' runs, one letter back at a time."""
        long = run[held]
        if not long.any():
            return held
        total = int(long.sum())
        steps = np.arange(total) - np.repeat(np.cumsum(long) - long, long) + 1
        made = np.repeat(held, long) - steps
        return np.concatenate([held, made[np.argsort(steps, kind="stable")]])

    def put(held: np.ndarray, kind: bool, c: int) -> None:
        j = held - 1
        j = j[j >= 0]
        j = j[(s_type[j] == kind) & (t[j] != c)]
        if not len(j):
            return
        to = t[j]
        order = np.argsort(to, kind="stable")
        j, to = j[order], to[order]
        counts = np.bincount(to, minlength=letters)
        nth = np.arange(len(to)) - np.repeat(np.cumsum(counts) - counts, counts)
        if kind:
            sa[there[to] - 1 - nth] = j
            there[:] -= counts
        else:
            sa[here[to] + nth] = j
            here[:] += counts

    put(np.array([n]), False, -1)
    for c in present.tolist():
        if head[c] < here[c]:
            held = back(sa[head[c] : here[c]])
            sa[head[c] : head[c] + len(held)] = held
            here[c] = head[c] + len(held)
            put(held, False, c)
        if cuts[c] < cuts[c + 1]:
            put(seeds[cuts[c] : cuts[c + 1]], False, c)
    there = tail.copy()
    for c in present[::-1].tolist():
        if there[c] < tail[c]:
            held = back(sa[there[c] : tail[c]][::-1])
            sa[tail[c] - len(held) : tail[c]] = held[::-1]
            there[c] = tail[c] - len(held)
            put(held, True, c)
        if head[c] < here[c]:
            put(sa[head[c] : here[c]][::-1], True, c)
    return sa


def suffix_array(t: np.ndarray, depth: int, letters: int = 257) -> np.ndarray:
    """Suffixes of t (small whole numbers) in the order of their first `depth` symbols at least.

    Leftmost S suffixes are sorted by their substrings up to the next one, by one inducing pass; their names make a string a
    third as long, whose suffixes are ranked by names of two, four, ... of its symbols, until all differ or the
    names cover `depth` symbols of t; a second pass induces the rest. Prefix doubling stands for the recursion, which needs a step a name here (README).
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    s_type = _fit_s(t)
    is_lms = s_type.copy()
    is_lms[0] = False
    is_lms[1:] &= ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    if not len(lms):
        return _induce(t, s_type, lms, letters)
    sa = _induce(t, s_type, lms, letters)
    order = sa[is_lms[sa]]
    following = np.append(lms[1:], n - 1)
    nth = np.empty(n, np.int64)
    nth[lms] = np.arange(len(lms))
    size = (following - lms + 1)[nth[order]]
    differs = np.ones(len(order), bool)
    same = np.flatnonzero(size[1:] == size[:-1]) + 1
    if len(same):
        k = size[same]
        ramp = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        equal = t[np.repeat(order[same], k) + ramp] == t[np.repeat(order[same - 1], k) + ramp]
        differs[same] = ~np.logical_and.reduceat(equal, np.cumsum(k) - k)
    # the last one runs into the sentinel and equals no other
    last = nth[order] == len(lms) - 1
    differs |= last
    differs[1:] |= last[:-1]
    rank = np.empty(len(lms), np.int64)
    rank[nth[order]] = np.cumsum(differs)
    width = 1
    while rank.max() < len(lms) and 2 * width < depth:
        key = rank * (len(lms) + 1)
        key[:-width] += rank[width:] if width < len(lms) else 0
        by = np.argsort(key, kind="stable")
        new = np.append(True, np.diff(key[by]) != 0)
        rank = np.empty(len(lms), np.int64)
        rank[by] = np.cumsum(new)
        width *= 2
        if width >= len(lms):
            break
    return _induce(t, s_type, lms[np.argsort(rank, kind="stable")], letters)


def capped_plcp(raw: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """By text position (permuted): the length, `cap` at most, of the prefix in common with the suffix before it in order.

    order holds whole windows alone (positions followed by `cap` bytes of their segment), so no separator is ever compared. Elsewhere 0.
    """
    found = np.zeros(len(raw), np.uint8)
    words = np.ndarray((len(raw),), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))
    before = np.empty(len(raw), np.int64)
    before[order[1:]] = order[:-1]
    p = np.sort(order[1:])
    for off in [*range(0, cap - 7, 8), cap - 8] if cap % 8 else range(0, cap, 8):
        differs = words[p + off] ^ words[before[p] + off]
        same = differs == 0
        gone, low = p[~same], differs[~same]
        found[gone] = off + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // 8
        p = p[same]
    found[p] = cap
    return found


def _recurring(groups: list[list[tuple[int, bytes]]], window: int) -> np.ndarray:
    """Which segments have a window whose hash recurs in their group. The others hold no repeat, so no suffix array needs them; hashes that clash cost work, not results."""
    flat = [s for g in groups for _, s in g]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    n = np.maximum(sizes - window + 1, 0)
    home = np.repeat(np.arange(len(flat)), n)
    if not len(home):
        return np.zeros(len(flat), bool)
    at = np.arange(len(home)) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(n) + n, n)
    group = np.repeat(np.arange(len(groups), dtype=np.uint64), [len(g) for g in groups])
    key = _hashes(np.frombuffer(b"".join(flat), np.uint8), window)[at] + (group * np.uint64(0xD6E8FEB86659FD93))[home]
    order = np.argsort(key)
    again = np.flatnonzero(np.diff(key[order]) == 0)
    found = np.zeros(len(flat), bool)
    found[home[order[again]]] = True
    found[home[order[again + 1]]] = True
    return found


def compare(groups: list[list[tuple[int, bytes]]], window: int = WINDOW) -> list[list[list[tuple[int, int]]]]:
    """A comparison for repeats.py: one suffix array over the shard's segments that _recurring() leaves; windows that follow each other in it with a common
    prefix of `window` bytes are one class, and a class's smallest identifier tells which windows are repeats."""
    if not groups:
        return []
    whole = [x for g in groups for x in g]
    taken = np.flatnonzero(_recurring(groups, window))
    parts: list[list[tuple[int, int]]] = [[] for _ in whole]
    if len(taken):
        flat = [whole[k] for k in taken.tolist()]
        sizes = np.fromiter((len(s) for _, s in flat), np.int64, len(flat))
        starts = np.cumsum(sizes + 1) - sizes - 1
        raw = np.frombuffer(b"\0".join([s for _, s in flat]) + b"\0", np.uint8)
        t = raw.astype(np.int16) + 1
        t[starts + sizes] = 0  # separators are smaller than any byte
        home = np.repeat(np.arange(len(flat)), sizes + 1)
        full = np.arange(len(t)) + window <= (starts + sizes)[home]
        sa = suffix_array(t, window)
        valid = sa[full[sa]]  # equal windows stand together: what is between two of them begins with the same window
        ident = np.array([least for least, _ in flat], np.int64)
        first = np.flatnonzero(capped_plcp(raw, valid, window)[valid] < window)
        low = np.minimum.reduceat(ident[home[valid]], first)
        late = np.sort(valid[np.repeat(low, np.diff(np.append(first, len(valid)))) < ident[home[valid]]])
        cuts = np.searchsorted(late, np.append(starts, len(t)))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            parts[int(taken[i])] = spans_of(late[cuts[i] : cuts[i + 1]] - starts[i], window)
    out, i = [], 0
    for g in groups:
        out.append(parts[i : i + len(g)])
        i += len(g)
    return out


def _hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the string of `size` bytes at each position, from its words of eight bytes; the last word overlaps the one before if it has to."""
    n = len(raw) - size + 1
    words = np.ndarray((len(raw),), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,)).copy()
    if size < 8:
        words &= np.uint64((1 << 8 * size) - 1)
    found, factor = np.zeros(n, np.uint64), 0x9E3779B97F4A7C15
    for off in [*range(0, size - 7, 8), size - 8] if size % 8 and size > 8 else range(0, max(size - 7, 1), 8):
        found += words[off : off + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return found


def anchors(data: bytes, window: int = WINDOW, gram: int = GRAM):
    """Blocks of (first window, number of windows, anchor): the smallest hash of the window's strings of `gram` bytes."""
    wide = window - gram + 1
    for at in range(0, len(data) - window + 1, _PIECE):
        h = _hashes(np.frombuffer(data[at : at + _PIECE + window - 1], np.uint8), gram)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        size = 1
        while 2 * size <= wide:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        if wide > size:
            h = np.minimum(h[: len(h) - (wide - size)], h[wide - size :])
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        yield edge + at, np.diff(np.append(edge, len(h))), h[edge]


def kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind(
        window, lambda text: text.encode("utf-8", "surrogatepass"), lambda data: anchors(data, window, gram), lambda data, a, b: data[a:b], lambda segs: pc.binary_length(segs).cast(pa.int64()),
        lambda seg: [(i, i + window) for i in range(len(seg) - window + 1)], lambda groups: compare(groups, window),
    )


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits) -> DataFrame:
    """Removes each byte of the UTF-8 text that a string of `window` bytes covers which also starts in a document with a smaller identifier.

    Matches never cross documents; overlaps count; strings are judged on the input. Candidates go to shards, where suffix arrays by induced
    sorting and common prefixes in text order find the classes of equal strings (see repeats.py for the way there and back).
    A null text is empty; a null identifier counts as larger than any other; rows with one identifier don't repeat each other.
    An empty table gives no rows; other columns are ignored.
    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "parts"))):
                data = unpacked(text)
                gone = union(parts, len(data), window)
                ends = [0, *(y for _, y in gone)]
                kept = b"".join([data[a:x] for a, (x, _) in zip(ends, gone)] + [data[ends[-1] :]])
                out.append((doc_id, len(data), sum(y - x for x, y in gone), len(gone), kept, hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    found = repeats(docs.select(F.col("doc_id").cast("long"), "text"), kind(window, gram), F.sha2("text", 256), **limits)
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
