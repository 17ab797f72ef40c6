"""op11: dropped lines by plain loops; states that grow and shrink against states made at once; the cuckoo filter by itself."""

import hashlib
import random

import numpy as np
import pytest

from pluvia.llm import line_dedup as ld

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP))
    return k if len(k) >= 10 else None


def expected(rows):
    big = (1 << 63) - 1
    first, holders = {}, {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                holders.setdefault(key(x), set()).add(big if i is None else i)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if first.get(key(x), big if i is None else i) == (big if i is None else i)]
        whole = "\n".join(kept)
        out.append((i, len(own), len(own) - len(kept), whole, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=str)


def texts(seed=5, n=80):
    r = random.Random(seed)
    pool = [f"line number {k} of the pool" for k in range(30)] + ["Short", "", "  Padded out line \t", "padded OUT line", "日本語のとても長い行です", "İstanbul is a line", "ISTANBUL IS A LINE", "\x0bPadded out line\x1f", "ééééééééé", "éééééééééé"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for i in range(n)]
    return rows + [(i, "everyone has this line\n" + t) for i, t in texts_tail(r)] + [(None, "everyone has this line\nand null has its own"), (None, None), (3, "everyone has this line\nline number 1 of the pool"), (900, "line number 1 of the pool\r\n" * 3000)]


def texts_tail(r):
    return [(100 + k, f"own line of document {k}\nline that two have {k // 2}") for k in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, oid int, keys string").repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("rows", [texts(), [], [(1, None)], [(5, "a line that repeats\n" * 4), (5, "a line that repeats")]])
def test_dropped_lines(spark, rows):
    assert got(ld.dedup(frame(spark, rows))) == expected(rows)


def content(state):
    return sorted((r["key"], r["n"], r["lo"], r["hi"]) for r in state.counts.collect())


def shared(state):
    return sorted(r["key"] for r in state.counts.where("lo < hi").collect())


def passes(state, keys):
    filters = {r["shard"]: ld.Cuckoo.read(r["blob"]) for r in state.filters.collect()}
    return [k for k in keys if int.from_bytes(k[:4], "big") % state.shards in filters and filters[int.from_bytes(k[:4], "big") % state.shards].has(ld._short([k]))[0]]


def test_states_grow_and_shrink(spark):
    rows = [(i, t) for i, t in texts() if i != 3]
    parts = [rows[0::3], rows[1::3], rows[2::3]]
    state = ld.lines(frame(spark, parts[0]))
    for p in parts[1:]:
        state = state.add(frame(spark, p))
    assert content(state) == content(ld.lines(frame(spark, rows)))
    assert got(ld.dedup(frame(spark, rows), state)) == expected(rows)
    assert passes(state, shared(state)) == shared(state)

    away = [i for i, _ in rows if i is not None and (i % 2 == 0 or i < 9)]  # smallest holders among them
    less = state.remove(frame(spark, [(i, None) for i in away]))
    rest = [(i, t) for i, t in rows if i not in away]
    assert content(less) == content(ld.lines(frame(spark, rest)))
    assert got(ld.dedup(frame(spark, rest), less)) == expected(rest)
    assert passes(less, shared(less)) == shared(less)
    gone = sorted(set(shared(state)) - set(shared(less)))
    assert gone and len(passes(less, gone)) <= len(gone) // 4 + 1

    again = less.add(frame(spark, [(i, t) for i, t in rows if i in away]))
    assert content(again) == content(state) and got(ld.dedup(frame(spark, rows), again)) == expected(rows)
    nobody = again.remove(frame(spark, rows))
    assert content(nobody) == [] and passes(nobody, shared(state)) == []


def test_full_filters_are_built_anew(spark, monkeypatch):
    monkeypatch.setattr(ld, "SHARDS", 1)
    a = [(i, "\n".join(f"line number {k} of many" for k in range(i, i + 12))) for i in range(0, 20, 10)]
    b = [(100 + i, "\n".join(f"line number {k} of many" for k in range(i, i + 400))) for i in range(0, 400, 100)]
    state = ld.lines(frame(spark, a))
    small = len(state.filters.first()["blob"])
    state = state.add(frame(spark, b))
    assert len(state.filters.first()["blob"]) > small and state.filters.count() == 1
    assert passes(state, shared(state)) == shared(state)
    assert got(ld.dedup(frame(spark, a + b), state)) == expected(a + b)


def test_frequent_lines_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(ld, "HOT", 30)
    rows = texts()
    assert got(ld.dedup(frame(spark, rows))) == expected(rows)


def test_cuckoo():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 63, 20_000, np.uint64))
    f = ld.Cuckoo.of(keys)
    assert f.slots.size <= 4 * len(keys) and f.has(keys).all()
    others = r.integers(1 << 63, (1 << 64) - 1, 200_000, np.uint64)
    assert f.has(others).mean() < 3e-4
    f.remove(keys[::2])
    assert f.has(keys[1::2]).all() and f.has(keys[::2]).mean() < 0.01
    assert f.add(keys[::2]) and ld.Cuckoo.read(f.blob()).has(keys).all()
    assert (f.slots != 0).sum() == len(keys)
    tight = ld.Cuckoo(np.zeros((16, 4), np.uint16))
    assert tight.add(keys[:58]) and not tight.add(keys[58:80])
    same = np.full(9, 7 << 48, np.uint64) | np.uint64(5)  # nine keys that look alike don't fit two buckets
    assert not ld.Cuckoo(np.zeros((4, 4), np.uint16)).add(same)
