"""op12: counts by plain loops over pieces; tries under small bounds, so that they burst, spill and forget their words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pluvia.llm import collocations as co


def plain(rows, least):
    counts, total = Counter(), Counter()
    for t, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                counts.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return {k: n for k, n in counts.items() if n >= least}, {k: n for k, n in total.items() if n}


def expected(rows, least, top):
    f, total = plain(rows, least)
    kept = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        if any(len(q) > len(p) and g == lang and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * n >= 50 * a for (g, q), n in f.items()):
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        kept.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, nth + 1, p.decode(), -a, l, r, total[lang], -s) for lang, some in kept.items() for nth, (s, a, p, l, r) in enumerate(sorted(some)[:top]))


def texts(n=60, seed=2):
    r = random.Random(seed)
    vocabulary = "the of a rain falls New York city gauge été ÉTÉ x\x01 x \x00 naïve 日本 \x1f |".split(" ")
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) if r.random() < 0.7 else "new york city" for _ in range(r.randint(0, 60))]
        rows.append(("".join(w + r.choice([" ", " ", "\t", "  ", ". ", "\n", ",", " \x0b"]) for w in words), r.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), ("a a a a a a a a a", "en"), ("go " * 4000, "en"), ("...,,,", "xx")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "f", 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, words int").repartition(3)


@pytest.mark.parametrize("rows,least,top", [(texts(), 3, 2000), (texts(40, 3), 2, 25), ([], 2, 10), ([(None, None)], 1, 10)])
def test_collocations(spark, rows, least, top):
    got = sorted(map(tuple, co.collocations(frame(spark, rows), least, top).collect()))
    assert got == expected(rows, least, top)
    if top == 25:
        assert any(r[1] == top for r in got)


def test_counts_with_all_bounds_small(spark, monkeypatch):
    """Containers burst at both levels, subtrees are spilled, ids are given out anew, and texts are cut into stretches."""
    for name, value in (("BURST", 30), ("CHILD", 3), ("MOST_ENTRIES", 200), ("MOST_WORDS", 9), ("CHUNK", 50)):
        monkeypatch.setattr(co, name, value)
    rows = texts()
    task = co.Counting(7)
    runs = [x for t, lang in rows for x in task.text(lang or "und", (t or "").encode())] + list(task.done())
    f, total = plain(rows, 2)
    blobs = {}
    for partition, lang, blob in runs:
        blobs.setdefault((partition, lang), []).append(blob)
    found, words = {}, Counter()
    for (_, lang), some in blobs.items():
        n, phrases = co.merged(some, 2)
        words[lang] += n
        for p, k in phrases:
            assert (lang, tuple(p.decode().split(" "))) not in found
            found[lang, tuple(p.decode().split(" "))] = k
    assert found == f and +words == total
    assert len(runs) > 100


def test_tries_burst_and_spill_whole_subtrees(monkeypatch):
    monkeypatch.setattr(co, "BURST", 20_000)
    r = np.random.default_rng(0)
    codes = (r.zipf(1.3, 300_000) % 1000 + 1) << 42 | (r.zipf(1.3, 300_000) % 1000 + 1) << 21 | r.integers(0, 40_000, 300_000)
    trie = co.Trie()
    for part in np.split(codes, 10):
        trie.add(part)
    assert trie.nodes and any(n.nodes for n in trie.nodes.values())
    want = Counter(codes.tolist())
    assert len(trie) == len(want)
    heaviest = max(trie.nodes, key=lambda h: len(trie.nodes[h]))
    out = trie.largest(1)
    assert len(out) == 1 and (out[0][0] >> 42 == heaviest).all()  # one subtree, whole
    rest = trie.entries()
    assert not (rest[0] >> 42 == heaviest).any()
    assert Counter(dict(zip(*(np.concatenate(x).tolist() for x in zip(*out, rest))))) == want


def test_scores_are_exact(spark):
    """Products beyond 64 bits."""
    a, l, r = 3_000_000_019, 4_000_000_007, 5_000_000_029
    rows = [("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a), ("en", 0, "", 10**10)]
    df = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    got = co.scored(df, None).collect()
    assert [tuple(x) for x in got] == [("en", 1, "x y", a, l, r, 10**10, 10**6 * a * a // (l * r))]
