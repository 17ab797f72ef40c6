"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pluvia.llm import bpe, chat_format, components, exact_dedup, fingerprints, langid, mixing, near, recompression, repeats, simhash, stages, suffix_arrays, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, run int, digest string, key string, bucket int, oid long, tkey long, score double, target double, fp long, kept boolean, copies int"
WORDS = "the of and rain falls on links gauge level storm weather field sensor tower north south wind snow melt river".split()


def made(seed=1, n=60):
    r = random.Random(seed)
    passage = " ".join(r.choices(WORDS, k=70))
    rows = []
    for i in range(n):
        text = " ".join(r.choices(WORDS, k=r.randint(1, 160)))
        if i % 5 == 0:
            text += " " + passage + " " + r.choice(WORDS)
        if i % 7 == 3 and rows:
            text = rows[r.randrange(len(rows))][1] or ""
        if i % 11 == 4:
            text = text.upper()
        rows.append((i, text))
    return rows


EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "a b c"), (4, "a b c"), (5, "A B c"), (None, "x y z"), (None, None), (6, "ÀÉ été ß 日本 Σας ΣΑΣ İ"), (7, "go " * 3000), (8, "12 34 !!"), (9, "a" * 3000), (10, "<|endoftext|> a</turn> # \\ b"), (11, "été " * 60), (12, "été " * 60)]


def frame(spark, rows):
    full = [(i, t, "en" if k % 3 else None, None if k % 4 == 0 else f"s{k % 3}", len(t or ""), 1, 1, "d", "k", 1, 1, 1, 0.5, 0.5, 1, True, 1) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module", params=["made", "edge", "empty"])
def docs(spark, request):
    rows = {"made": made(), "edge": EDGE, "empty": []}[request.param]
    return rows, frame(spark, rows).repartition(3).cache()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_exact_dedup(docs, keep, pick):
    rows, df = docs
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    got = exact_dedup.exact_dedup(df, keep=keep, runs=8, slice_entries=5).collect()
    assert len(got) == len(rows)
    want = {sha(t): (pick((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert {(r.text_sha256, r.keep_id, r.group_size) for r in got} == {(s, *v) for s, v in want.items()}
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def brute_repeats(rows, split, join, window):
    """Exact, by a table of every window's smallest identifier; a null identifier is larger than any."""
    big = 1 << 60
    first = {}
    for i, t in rows:
        u = split(t)
        for p in range(len(u) - window + 1):
            k = tuple(u[p : p + window])
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, t in rows:
        u = split(t)
        gone = [False] * len(u)
        for p in range(len(u) - window + 1):
            if first[tuple(u[p : p + window])] < (big if i is None else i):
                gone[p : p + window] = [True] * window
        out.append((-1 if i is None else i, len(u), sum(gone), sha(join([x for x, g in zip(u, gone) if not g]))))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"most_anchors": -1}, {"most_segments": 1}])
def test_recompression(docs, limits):
    rows, df = docs
    got = recompression.dedup(df, **limits).collect()
    want = brute_repeats(rows, lambda t: (t or "").encode().split(), b" ".join, 50)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("limits", [{}, {"most_anchors": -1}, {"most_segments": 1}])
def test_suffix_arrays(docs, limits):
    rows, df = docs
    got = suffix_arrays.dedup(df, **limits).collect()
    want = brute_repeats(rows, lambda t: (t or "").encode(), bytes, 50)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == want


def test_suffix_array_orders_all_suffixes():
    r = np.random.default_rng(0)
    for k in range(120):
        t = r.integers(0, 1 + k % 4, r.integers(1, 150)).astype(np.int16)
        t = np.tile(t[: 1 + len(t) // 4], 4) if k % 3 == 0 else t
        b = bytes(t.astype(np.uint8).tolist())
        assert suffix_arrays.suffix_array(t, 1000).tolist() == sorted(range(len(t)), key=lambda i: b[i:])


def brute_classes(group, window):
    best = {}
    for least, s in group:
        for i in range(len(s) - window + 1):
            best[s[i : i + window]] = min(best.get(s[i : i + window], 1 << 62), least)
    return [repeats.spans_of(np.array([i for i in range(len(s) - window + 1) if best[s[i : i + window]] < least], np.int64), window) for least, s in group]


def test_separators_are_no_bytes():
    group = [(1, b"P" * 9 + b"A" * 51), (2, b"Q" * 45 + b"P" * 10), (3, b"Y" * 60), (4, b"P" * 10 + b"\0" + b"Y" * 39)]
    assert suffix_arrays.compare([group]) == [brute_classes(group, 50)]
    r = random.Random(1)
    for _ in range(150):
        letters = r.choice([b"\0a", b"\0ab", b"ab", b"\0\1\xff"])
        base = bytes(r.choices(letters, k=200))
        group = []
        for i in range(r.randint(2, 6)):
            a = r.randint(0, 120)
            group.append((i, base[a : a + r.randint(64, 80)] + bytes([r.choice(letters)]) * r.randint(0, 60)))
        for window in (8, 13, 50, 64):
            assert suffix_arrays.compare([group], window) == [brute_classes(group, window)]


def test_suffix_dedup_keeps_what_only_holds_nul_bytes(spark):
    n = "\0"
    texts = ["abb" + n * 72 + "abab" + n * 5, "aba" + n * 55 + "a" + n * 14 + "ab" + n * 10, "a" + n * 19 + "bb", "ab" + n * 60 + "ab" + n * 19 + "bb", "aaaabb" + n * 8, "abbaba" + n * 36]
    rows = list(enumerate(texts))
    got = suffix_arrays.dedup(frame(spark, rows).coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows, lambda t: t.encode(), bytes, 50)


def test_runs_of_one_byte_take_no_longer():
    import time

    began = time.time()
    suffix_arrays.suffix_array(np.full(1_000_000, 98, np.int16), 50)
    assert time.time() - began < 5


def test_long_texts_cross_blocks(monkeypatch):
    """Whatever is done block by block gives the same for blocks of a few units."""
    r = random.Random(4)
    text = " ".join(r.choices(WORDS, k=900)) + " é ß " + "go " * 300
    units = text.encode().split()

    def all_of():
        by_window = lambda blocks: [int(a) for _, count, anchor in blocks for c, a in zip(count, anchor) for _ in range(c)]
        return (
            by_window(suffix_arrays.anchors(text.encode())), simhash.fingerprint(text), fingerprints.as_string(fingerprints.sketch(text)), np.concatenate(list(langid.grams(text))).tolist(),
            near.shingle_set(text).tolist(), len(by_window(recompression.anchors(units))),
        )

    whole = all_of()
    monkeypatch.setattr(suffix_arrays, "_PIECE", 101)
    monkeypatch.setattr(recompression, "_PIECE", 97)
    monkeypatch.setattr(simhash, "_BLOCK", 13)
    monkeypatch.setattr(fingerprints, "_BLOCK", 7)
    monkeypatch.setattr(langid, "_PIECE", 11)
    assert all_of() == whole


def test_repeats_across_blocks(spark, monkeypatch):
    r = random.Random(14)
    passage = r.choices(WORDS, k=700)
    rows = [(1, " ".join(passage)), (2, " ".join(r.choices(WORDS, k=333) + passage[50:600] + ["end"])), (3, " ".join(passage[100:180] * 8))]
    monkeypatch.setattr(recompression, "_PIECE", 64)
    monkeypatch.setattr(suffix_arrays, "_PIECE", 128)
    got = recompression.dedup(frame(spark, rows)).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == brute_repeats(rows, lambda t: t.encode().split(), b" ".join, 50)
    got = suffix_arrays.dedup(frame(spark, rows)).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in got) == brute_repeats(rows, lambda t: t.encode(), bytes, 50)


def test_anchors_cover_all_windows_and_depend_on_them_alone():
    r = random.Random(3)
    passage = [r.choice(WORDS).encode() for _ in range(90)]

    def by_window(w):
        out = {}
        for first, count, anchor in recompression.anchors(w):
            for f, c, a in zip(first, count, anchor):
                for p in range(f, f + c):
                    assert p not in out
                    out[p] = int(a)
        assert sorted(out) == list(range(len(w) - 49))
        return out

    a, b = by_window([b"x"] * 7 + passage + [b"y"]), by_window([r.choice(WORDS).encode() for _ in range(33)] + passage)
    assert [a[7 + i] for i in range(41)] == [b[33 + i] for i in range(41)]


def test_spans_of():
    assert repeats.spans_of(np.array([0, 1, 60, 111]), 50) == [(0, 51), (60, 110), (111, 161)]


def test_simhash(docs):
    rows, df = docs
    fps = []
    for _, t in rows:
        w = words(lower(t))
        s = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    got = simhash.near_duplicates(df).select("doc_id", F.lpad(F.hex("fp"), 16, "0").alias("f"), "component_id").collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.f.lower(), r.component_id) for r in got), key=key) == sorted(((i, f"{f:016x}", least.get(find(a))) for a, ((i, _), f) in enumerate(zip(rows, fps))), key=key)


def test_bk_trees_find_all_within_the_radius():
    r = random.Random(5)
    centre = r.getrandbits(64)
    values = list({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(400)} | {r.getrandbits(64) for _ in range(400)})
    whole = np.array(values, np.uint64)
    for radius in (0, 2, 24):
        found = sorted((int(a), int(b)) for q, v in simhash.BKTree(whole).near(whole[:100], radius) for a, b in zip(q, v))
        assert found == [(a, b) for a in range(100) for b in range(len(values)) if (values[a] ^ values[b]).bit_count() <= radius]
    assert not list(simhash.BKTree(whole[:0]).near(whole, 2))


def test_near_blocks_of_one_text_find_the_same(spark, monkeypatch):
    r = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if r.random() < 0.985 else r.choice(base) for w in base)) for i in range(60)]
    monkeypatch.setattr(near, "BLOCK", 600)
    monkeypatch.setattr(near.hopeful, "__defaults__", (near.RADIUS, 7))
    monkeypatch.setattr(near.linked, "__defaults__", (near.RADIUS, 600))
    pairs, _ = check_near(spark, rows)
    assert len(pairs) > 20


def test_near_tells_texts_with_one_number_apart(spark, monkeypatch):
    """Numbers of texts clash nearly always here; components are those of the texts even so."""
    monkeypatch.setattr(near, "number", lambda d: F.pmod(F.xxhash64(d), F.lit(7)))
    r = random.Random(14)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if r.random() < 0.985 else r.choice(base) for w in base)) for i in range(25)] + [(100 + i, f"text {i} of its own kind, alone among all of these {i}") for i in range(25)]
    pairs, _ = check_near(spark, rows)
    assert pairs


def test_near_hot_shards_are_divided(spark, monkeypatch):
    """With nearly every shard counted as hot, all pairs of 0.8 are joined still."""
    r = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if r.random() < 0.985 else r.choice(base) for w in base)) for i in range(80)]
    sizes = []
    plain = near.cooled
    monkeypatch.setattr(near, "cooled", lambda members, keys: sizes.append((members.count(), (got := plain(members, keys, 4)).where("hot != 0").count())) or got)
    pairs, _ = check_near(spark, rows)
    assert len(pairs) > 20 and sizes[0][1] > 100


def test_near_pairs_that_share_one_hot_shard_alone_are_joined(spark, monkeypatch):
    """All texts share one shard and no other: whether it counts as hot makes no difference."""
    r = random.Random(16)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if r.random() < 0.99 else r.choice(base) for w in base)) for i in range(12)] + [(100 + i, " ".join(f"x{r.randrange(9999)}" for _ in range(60))) for i in range(60)]
    signatures, plain = near.signatures, near.cooled
    alone = F.concat(F.array(F.lit(7).cast("long")), F.transform(F.sequence(F.lit(1), F.lit(near.BANDS - 1)), lambda i: F.xxhash64("d", i)))
    monkeypatch.setattr(near, "signatures", lambda docs: signatures(docs).withColumn("keys", alone))
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    for most in (4, 10**6):
        monkeypatch.setattr(near, "cooled", lambda members, keys, most=most: plain(members, keys, most))
        groups = {}
        for x in near.near_copies(docs).collect():
            groups.setdefault(x.component, []).append(x.doc_id)
        got.append(sorted(sorted(g) for g in groups.values()))
    assert got[0] == got[1] and max(map(len, got[0])) > 2


def test_near_plans_are_small(spark, monkeypatch):
    """The driver plans a query anew after each of its stages, so what it holds for that grows with the square of a plan."""
    r = random.Random(17)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if r.random() < 0.985 else r.choice(base) for w in base)) for i in range(40)]
    exchanges = []
    for module in (near, components):

        def counted(df, plain=module.checkpoint):
            exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
            return plain(df)

        monkeypatch.setattr(module, "checkpoint", counted)
    near.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(exchanges) > 10 and max(exchanges) <= 16, exchanges


def test_near_one_large_component_meets_the_few_others_alone(spark):
    rows = [(1, 0, 0, i, 0 if i % 100 else i + 1) for i in range(1000)]
    members = spark.createDataFrame(rows, "key long, band int, hot long, node long, component long")
    got = near._dealt(members, F.lit(1), 100).collect()
    assert len(got) < 1200
    blocks = {}
    for x in got:
        blocks.setdefault((x.a, x.b), set()).add(x.node)
    assert all(any({0 if i < 1 else i, j} <= b for b in blocks.values()) for i in range(0, 1000, 100) for j in range(1000))


def test_near_rows_of_a_hot_shard_grow_with_its_size(spark):
    """Texts with a passage in common share shards by it, and no others; in how many rows they go to the shards."""
    made = []
    for n in (400, 800):
        r = np.random.default_rng(n)
        # four bands that many have by the passage: each text has each of them with probability 1/2; nodes are components of their own
        rows = [(int(band + 1), int(band), int(r.integers(-(1 << 62), 1 << 62)), i, i, bytes(360)) for i in range(n) for band in range(4) if r.random() < 0.5]
        members = spark.createDataFrame(rows, "key long, band int, fp long, node long, component long, minima binary")
        plain = near._dealt(members.withColumn("hot", F.lit(0)), F.lit(1), 20).count()
        made.append((plain, near._dealt(near.cooled(members, members, 50), F.lit(1), 10**6).count()))
    (plain, few), (plain2, more) = made
    assert plain2 > 3.5 * plain and more < 2.3 * few and more < plain2 / 3


def test_large_shards_are_split(spark):
    r = random.Random(6)
    centre = r.getrandbits(63)
    values = sorted({centre ^ sum(1 << b for b in r.sample(range(63), 2)) for _ in range(300)})
    for radius in (1, 2, 3):
        choices = simhash.masks(list(range(64)), radius)
        for _ in range(300):
            x = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not x & m for m in choices)
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fp long, node long")
    whole = {tuple(x) for x in components.components(simhash.links(df)).collect()}
    parts = {tuple(x) for x in components.components(simhash.links(df, tree=20)).collect()}
    assert whole == parts and len(whole) > 100


def test_components_of_a_chain(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "u long, v long")
    assert {tuple(x) for x in components.components(df).collect()} == {(i, 0) for i in range(n + 1)} | {(1000, 1000), (1001, 1000)}
    assert components.components(df.limit(0)).count() == 0


def test_fingerprints(docs):
    rows, df = docs
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n, nxt = len(t), order[(k + 1) % len(order)][1]
        want.append((-1 if i is None else i, n, sha(t[: n - n // 2] + nxt[: n // 2])))
    got = fingerprints.edited_fingerprints(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    plain = fingerprints.sketches(df).collect()
    assert len(plain) == len(rows)

    def brute(t):
        w = t.encode().split()
        h = {xxhash.xxh64_intdigest(b" ".join(w[j : j + 5])) for j in range(max(1, len(w) - 4))} if w else set()
        return {x for x in h if x < 2**62}, min(h, default=-1)

    def like(a, b):
        return len(a[0] & b[0]) / len(a[0] | b[0]) if a[0] | b[0] else float(a[1] == b[1])

    def shown(a):
        return "" if a[1] < 0 else "".join(f"{x >> 16:012x}" for x in sorted(a[0])) + f".{a[1]:016x}"

    want = []
    for k, (i, t) in enumerate(order):
        n, nxt = len(t), order[(k + 1) % len(order)][1]
        own, edited = brute(t), brute(t[: n - n // 2] + nxt[: n // 2])
        want.append((-1 if i is None else i, shown(own), shown(edited), like(own, edited), like(own, brute(nxt))))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == sorted(want)


def test_sketches_estimate_and_merge():
    r = random.Random(2)
    a, b = [" ".join(r.choice("abcdefghij") * 3 for _ in range(4000)) for _ in range(2)]
    s = fingerprints.sketch
    assert fingerprints.likeness(s(a), s(a)) == (1.0, 1.0, 1.0)
    j, held, _ = fingerprints.likeness(s(a), s(a + " " + b))
    assert abs(held - 1) < 1e-9 and abs(j - 0.5) < 0.1
    both = fingerprints.merge(s(a), s(b))
    assert set(both[0].tolist()) == set(s(a)[0].tolist()) | set(s(b)[0].tolist())
    assert fingerprints.as_string(s("")) == "" and fingerprints.as_string(s("one")) != fingerprints.as_string(s("two"))


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    rows, df = docs
    spec = stages.word_bpe_spec()
    tk = Tokenizer.from_str(spec)
    enc = [(i, tk.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    want = sorted((-1 if i is None else i, len(x), sha(" ".join(map(str, x))), sha(tk.decode(x, skip_special_tokens=False))) for i, x in enc)
    for chunk in (50, bpe.CHUNK_CHARS):
        got = bpe.round_trip(df, spec, chunk_chars=chunk).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    ids = bpe.encode(df, spec)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in ids.collect()) == sorted((-1 if i is None else i, x) for i, x in enc)
    once = ids.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in bpe.decode(once, spec).collect()}
    assert texts == {i: tk.decode(x, skip_special_tokens=False) for i, x in enc if i is not None}


def test_bpe_splits_as_the_library_does():
    from tokenizers import Tokenizer

    spec = stages.word_bpe_spec()
    tk, w = Tokenizer.from_str(spec), bpe.Words(spec)
    r = random.Random(9)
    alphabet = [chr(c) for c in [*range(0, 0x250), *range(0x300, 0x370), 0x3A3, 0x3C3, 0x130, 0x2028, 0x3000, 0x65E5, 0x1F600, 0x200B, 0x660, 0xB2, 0x2160]] + ["'s", "'LL", " ", " ", "<|endoftext|>", "<|startoftext|>"]
    for _ in range(1500):
        t = "".join(r.choices(alphabet, k=r.randint(1, 25)))
        assert [i for x in w.split(t) for i in w.ids(x)] == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_bpe_splits_every_ascii_character_as_the_library_does():
    from tokenizers import Tokenizer

    spec = stages.word_bpe_spec()
    tk, w = Tokenizer.from_str(spec), bpe.Words(spec)
    for c in map(chr, range(128)):
        for t in (c, f"a{c}b", f"ab{c}cd x{c} {c}y{c}{c}"):
            assert [i for x in w.split(t) for i in w.ids(x)] == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_bpe_splits_every_code_point_as_the_library_does():
    """Of all planes, unassigned ones too: between letters, between signs, before a digit and with a combining mark. Planes that hold none but private or unassigned ones are met by every 64th."""
    from tokenizers import Tokenizer

    spec = stages.word_bpe_spec()
    tk, w = Tokenizer.from_str(spec), bpe.Words(spec)
    tk.no_truncation()
    tk.no_padding()
    for at in range(0, 0x110000, 512):
        step = 64 if 0x40000 <= at < 0xE0000 or at >= 0xE1000 else 1
        texts = [f"a{c}b !{c}! {c}1{c}\u0307{c}\u0323 X{c}" for c in map(chr, range(at, at + 512, step)) if not 0xD800 <= ord(c) < 0xE000]
        norm = [tk.pre_tokenizer.pre_tokenize_str(tk.normalizer.normalize_str(t)) for t in texts]
        for t, pieces in zip(texts, norm):
            assert [p for x in w.split(t) for p, _ in w.bytes.pre_tokenize_str(x)] == [p for p, _ in pieces], repr(t)
    assert not bpe.unsure(spec)[[ord(c) for c in "plain ascii, éàüß Σ 日本語 \u0301\u0327 ÀÉ"]].any()


def test_mixing(docs):
    rows, df = docs
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(words(t)) for _, t in rows)
    assert all(r.taken == r.copies * r.size <= 2 * r.size for r in got)
    if len(rows) == 60:
        total = sum(r.size for r in got)
        assert abs(sum(r.taken for r in got) - 1.5 * total) <= max(r.size for r in got)
        targets = {r.source: r.target for r in got}
        assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
        for source, target in targets.items():
            assert abs(sum(r.taken for r in got if r.source == source) - target) <= 2 * max(r.size for r in got)


def test_mixing_stage_by_row(spark):
    """Rows that share a doc_id, or have none, get the copies that the mix gives each of them, however rows are dealt."""
    rows = [(7, " ".join(f"b{i}" for i in range(n)), "b") for n in (1, 3, 9, 20, 33, 50, 77, 101, 140, 177, 200)] + [(100 + i, " ".join(["a"] * (10 + i)), "a") for i in range(10)]
    rows += [(None, "x y z " * k, "c") for k in range(1, 12)] + [(None, "x y z", "c")] * 3 + [(5, "x y z", None), (5, "x y z w", None)]
    df = spark.createDataFrame([(i, t, s, k) for k, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string, copies int")
    want = None
    for n in (1, 4, 7):
        got = sorted(map(str, stages.mixing(spark, df.repartition(n), "").select("doc_id", "text", "source", "copies").collect()))
        assert want in (None, got)
        want = got
    by = {}
    for r in mixing.mix(df, apart=F.sha2("text", 256)).collect():
        by.setdefault((r.doc_id, r.source, r.apart), []).append(r.copies)
    out = {}
    for r in stages.mixing(spark, df, "").collect():
        out.setdefault((r.doc_id, r.source, sha(r.text)), []).append(r.copies)
    assert {k: len(v) for k, v in out.items()} == {k: sum(v) for k, v in by.items() if sum(v)}
    assert sum(r.taken for r in mixing.mix(df, apart=F.sha2("text", 256)).collect()) == sum(len(words(r.text)) for r in stages.mixing(spark, df, "").collect())


def test_targets_are_filled_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 900)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2).collect()}
    # 3015 by 5:2:1:5 (null comes last and takes the fourth place); a and c fill up, b and null share the rest 2:5, null fills up at 1800
    assert got == {"a": 200.0, "c": 20.0, None: 1800.0, "b": 995.0}


CHAT = "conv_id long, turn long, role string, text string, segments string, turns int"


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>\n### user\n"), (2, 0, "system", None), (2, 1, "user", "\\"), (2, 2, "assistant", "\\l\\b<#>\\"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, None, None, None), (4, 1, "ro\nle", "été"), (4, 0, "user", "")],
    ],
)
def test_chat_format(spark, rows):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], CHAT)
    done = chat_format.format_chats(df).withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("learned", chat_format.learned_text(F.col("segments"))).collect()
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert {r.conv_id for r in done} == set(convs)
    for r in done:
        turns = sorted(convs[r.conv_id])
        assert [(t.role, t.text) for t in r.back] == [(role, text) for _, role, text in turns]
        assert r.learned == "".join(text for _, role, text in turns if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.valid == (r.conv_id in (1, 2))


def test_chat_format_takes_other_templates(spark):
    template = chat_format.TEMPLATE | {"head": "[INST:", "open": "] ", "close": "[/INST]", "loss_roles": ["user"]}
    texts = ["", "[/INST]", "[INST:user] x", "\\b\\c[", "a] [/INST", None]
    df = spark.createDataFrame([(1, i, "us] er" if i % 2 else "user", t, "s", 1) for i, t in enumerate(texts)], CHAT)
    r = chat_format.format_chats(df, template).select(chat_format.read_back(F.col("formatted"), template).alias("back"), chat_format.learned_text(F.col("segments"), template).alias("learned"), "formatted").first()
    assert [(t.role, t.text) for t in r.back] == [("us] er" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert r.formatted.count("[/INST]") == len(texts) and r.learned == "".join(t or "" for t in texts[::2])
    for bad in ({"close": ""}, {"close": "#x"} | {"head": "a#"}, {"head": "\\a"}):
        with pytest.raises(ValueError):
            chat_format.format_chats(df, chat_format.TEMPLATE | bad)


def test_language_shares_are_those_of_exact_sets(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang").collect()]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {}
    for _, t, lang in rows:
        c = "".join(x.lower()[0] if x.isalpha() else " " for x in " " + t + " ")
        c = re.sub(" +", " ", c)
        for j in range(len(c) - 2):
            if c[j + 1] != " ":
                own = counts.setdefault(lang, {})
                own[c[j : j + 3]] = own.get(c[j : j + 3], 0) + 1
    part = {lang: {g: n / sum(own.values()) for g, n in own.items()} for lang, own in counts.items()}
    sets = {lang: {g for g, n in own.items() if n >= langid.MIN_COUNT and part[lang][g] * langid.RATIO >= max(p.get(g, 0) for p in part.values())} for lang, own in counts.items()}
    assert model.langs == sorted(sets)
    for _, t, _ in rows[:60]:
        c = re.sub(" +", " ", "".join(x.lower()[0] if x.isalpha() else " " for x in " " + t + " "))
        g = [c[j : j + 3] for j in range(len(c) - 2) if c[j + 1] != " "]
        shares, n = model.shares(t)
        assert n == len(g)
        for lang, share in zip(model.langs, shares):
            assert abs(share - sum(x in sets[lang] for x in g) / len(g)) < 0.01


def test_language_id(spark, docs):
    rows, df = docs
    model = langid.fit(df.withColumn("lang", F.lit("en")))
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
    blank = {i for i, t in rows if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == ({i for i, _ in rows} if not model.langs else blank)


def test_language_id_is_right_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d, langid.fit(d.where(~stages.held_out())), keep=("lang",)).where(stages.held_out() & F.col("lang").isNotNull())
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert right / n > 0.98


def test_filters_hold_more_than_64_languages(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}zq " * 30, f"l{i:03d}") for i in range(80)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=1 << 14)
    assert model.table.shape[1] == 2
    assert all(model.decide(t)[0] == lang for _, t, lang in rows)


def test_toxicity(spark, docs):
    rows, df = docs
    labels = spark.createDataFrame([(i, i % 2, 9) for i, _ in rows if i is not None] + [(None, 1, 9), (1, None, 9)], "doc_id long, toxic int, text int")
    net = toxicity.fit(df, labels, max_docs=(20, 20), epochs=1)
    got = toxicity.score(df, net).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (1, 2, 3) and len(rows) == len(EDGE))
    assert toxicity.fit(df, labels.limit(0)) is None


def test_toxicity_scores_every_window():
    r = random.Random(3)
    net = toxicity.Network(3)
    net.p = {k: v + np.random.default_rng(5).standard_normal(v.shape).astype(v.dtype) * 0.3 for k, v in net.p.items()}
    texts = [" ".join(r.choices(WORDS, k=n)) for n in (1, 5, 31, 32, 33, 57, 80, 200, 1000)] + [""]
    got = net.score_texts(texts, {})
    for t, score in zip(texts, got):
        w = t.split()
        each = [net.score_texts([" ".join(w[s : s + toxicity.WIDTH])], {})[0] for s in toxicity.windows(len(w))]
        assert abs(score - max(each, default=0.0)) < 1e-4
        covered = {i for s in toxicity.windows(len(w)) for i in range(s, min(len(w), s + toxicity.WIDTH))}
        assert covered == set(range(len(w)))


def test_a_cluster_must_name_its_folder(monkeypatch):
    from pluvia.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()

    with pytest.raises(ValueError):
        common.shared_folder(Session())


def test_toxicity_gradients():
    net = toxicity.Network(3)
    for k in ("words", "chars"):
        net.p[k] = np.random.default_rng(1).standard_normal(net.p[k].shape)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    w = [b"abc", b"hello", b"x", b"idiot!!"]
    ids, size, y = r.integers(0, 4, (5, 6)), np.array([6, 6, 3, 6, 1]), np.array([1, 0, 1, 0, 1.0])

    def loss():
        z = net.forward(net.inputs(w)[0].astype(np.float64) @ net.p["in"] + net.p["bias"], ids, size).astype(np.float64)
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    g = net.gradient(w, ids, size, y)
    for k in ("out", "att", "att_v", "uf", "ub", "in", "bias", "out_b"):
        i = tuple(int(r.integers(0, s)) for s in net.p[k].shape)
        kept, e = net.p[k][i], 1e-3
        net.p[k][i] = kept + e
        up = loss()
        net.p[k][i] = kept - e
        down = loss()
        net.p[k][i] = kept
        assert abs((up - down) / 2 / e - g[k][i]) < 1e-4 + 0.02 * abs(g[k][i]), k


def test_toxicity_finds_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    net = toxicity.fit(docs, labels.where(~stages.held_out()))
    held = docs.join(labels.where(stages.held_out()).select("doc_id", "toxic"), "doc_id")
    got = toxicity.score(held, net).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    caught = [r.score >= 0.3 for r in got if r.toxic == 1]
    wrong = [r.score >= 0.3 for r in got if r.toxic == 0]
    assert np.mean(caught) > 0.85 and np.mean(wrong) < 0.03


def test_stages_keep_what_they_should(spark, docs):
    rows, df = docs
    columns = df.columns
    out = stages.language_id(spark, df, "")
    model = langid.fit(df.where(~stages.held_out()))
    unknown = lambda t: bool(model.langs) and model.decide(t)[2] < (stages.LEAST_COVERAGE if sum(map(len, langid.grams(t))) >= stages.FEW else 1e-12)
    assert out.columns == columns and {r.text for r in out.collect()} == {t for _, t in rows if any(c.isalpha() for c in t or "") and not unknown(t)}
    out = stages.exact(spark, df, "")
    assert out.columns == columns
    assert sorted(lower(r.text) for r in out.collect()) == sorted({lower(t) for _, t in rows})
    near = stages.near(spark, df, "")
    assert near.columns == columns
    classes = {(r.component_id if r.component_id is not None else ("null", r.fp)) for r in simhash.near_duplicates(df).collect()}
    assert near.count() == len(classes)
    mixed = stages.mixing(spark, df, "")
    assert mixed.columns == columns
    assert mixed.count() == sum(r.copies for r in mixing.mix(df).collect())
    assert stages.encoding(spark, df, "").count() == len(rows)


def shingle_sets(texts):
    out = []
    for t in texts:
        w = words(lower(t))
        out.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_likeness(sets):
    """Pairs of sets whose Jaccard likeness is 0.8 or more, through the sets that share an element."""
    by = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in by.values() for n, a in enumerate(ks) for b in ks[n + 1 :]}
    return {(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def check_near(spark, rows):
    """Near copies against brute force; every row's text differs, so rows are known by it."""
    sets = shingle_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    pairs = brute_likeness(sets)
    for a, b in pairs:
        root[find(a)] = find(b)
    least = {}
    for k, row in enumerate(rows):
        least[find(k)] = min(least.get(find(k), row), row)
    assert sorted((r.doc_id, r.text) for r in stages.near(spark, frame(spark, rows).repartition(4), "").collect()) == sorted(least.values())
    return pairs, sets


def test_near_joins_all_pairs_of_four_fifths(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for size in (8, 30, 60, 200, 900):
        for _ in range(12):
            base = r.choices(vocabulary, k=size)
            rows.append((len(rows), " ".join(base)))
            for _ in range(9):
                other = list(base)
                for _ in range(r.randint(0, max(1, size // 50))):
                    other[r.randrange(size)] = r.choice(vocabulary)
                rows.append((len(rows), " ".join(other) + " " + r.choice(vocabulary)))
    # a chain, and many variants of one text that aren't all alike
    chain = r.choices(vocabulary, k=260)
    rows += [(len(rows) + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(40)]
    rows += [(len(rows) + i, " ".join(w if r.random() < 0.985 else r.choice(vocabulary) for w in chain)) for i in range(150)]
    pairs, sets = check_near(spark, rows)
    assert sum(len(sets[a] & sets[b]) < 0.9 * len(sets[a] | sets[b]) for a, b in pairs) > 300
    for a, b in pairs:
        (fa, ka, ma), (fb, kb, mb) = near.signature(rows[a][1]), near.signature(rows[b][1])
        assert (ka == kb).any() and (fa ^ fb).bit_count() <= near.RADIUS and (ma == mb).sum() >= near.EQUAL


def test_near_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    once = {lower(t): (i, t) for i, t in docs}
    pairs, _ = check_near(spark, sorted(once.values()))
    assert pairs


def test_rows_that_share_a_doc_id_are_judged_by_their_texts(spark):
    base, other = [f"w{i}" for i in range(60)], " ".join(f"x{i}" for i in range(60))
    a, b = " ".join(base), " ".join([*base[:-1], "end"])
    kept = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, frame(spark, rows).repartition(3), "").collect()), key=str)
    assert [i for i, _ in kept(stages.exact, [(7, "Hello"), (7, "hello")])] == [7]
    assert [i for i, _ in kept(stages.exact, [(None, "Hello"), (None, "hello")])] == [None]
    assert [i for i, _ in kept(stages.near, [(7, a), (7, b)])] == [7]
    assert kept(stages.near, [(3, a), (7, b), (7, other)]) == [(3, a), (7, other)]
    got = simhash.near_duplicates(frame(spark, [(3, a), (7, a), (7, other)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (7, 3), (7, 7)]


def test_pipeline_runs_its_stages_in_order(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()
    got = corpus_pipeline.run(spark, d).collect()
    texts = {r.doc_id: r.text for r in docs}
    kept = {}
    for i, t in texts.items():
        kept[lower(t)] = max(i, kept.get(lower(t), -1))
    from tokenizers import Tokenizer

    tk = Tokenizer.from_str(stages.word_bpe_spec())
    assert {r.doc_id for r in got} <= set(kept.values())
    for r in got:
        ids = tk.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(" ".join(map(str, ids)))


def test_later_copies_send_no_windows(spark, monkeypatch):
    """Of a text's copies the first alone goes to the shards, with what else repeats it; rows that share an identifier and a text are no repeats."""
    r = random.Random(15)
    text = " ".join(f"word{r.randrange(10**6)}" for _ in range(300))
    other = " ".join(f"word{r.randrange(10**6)}" for _ in range(300))
    sent = []
    plain = repeats._segments
    monkeypatch.setattr(repeats, "_segments", lambda *a: sent.append((got := plain(*a)).select("oid").distinct().count()) or got)
    rows = [(i, text) for i in range(40)] + [(50, other), (50, other), (60, " ".join(text.split()[:150] + other.split()[::-1]))]
    for dedup in (suffix_arrays.dedup, recompression.dedup):
        sent.clear()
        got = dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sent[0] < 10 and sorted(x.doc_id for x in got if not x.n_removed) == [0, 50, 50]


def test_segments_without_a_repeat_enter_no_suffix_array(monkeypatch):
    """Segments with one anchor mostly share no window; only those that do are sorted. The classes are the same."""
    r = random.Random(16)
    letters = lambda n: bytes(r.choices(b"abcdefghij ", k=n))
    sizes = []
    plain = suffix_arrays.suffix_array
    monkeypatch.setattr(suffix_arrays, "suffix_array", lambda t, *a: sizes.append(len(t)) or plain(t, *a))
    groups = []
    for _ in range(40):
        gram, passage = letters(16), letters(55)
        groups.append([(i, letters(30) + gram + letters(30)) for i in range(4)] + [(i, letters(r.randint(0, 9)) + passage + letters(9)) for i in (9, 5)])
    apart = [[(1, groups[0][4][1])], [(0, groups[0][4][1])], [(3, letters(49))]]  # one window in two groups is no repeat
    assert suffix_arrays.compare(groups + apart) == [brute_classes(g, 50) for g in groups + apart]
    assert sum(sizes) < 40 * 2 * 80 < sum(len(s) for g in groups for _, s in g) / 2
    assert suffix_arrays.compare([[(1, b"a" * 50), (2, b"b" * 50)], [(3, b"c" * 20)]]) == [[[], []], [[]]]


@pytest.mark.parametrize("size", [1, 7, 8, 13, 16, 50])
def test_hashes_name_strings(size):
    raw = np.random.default_rng(2).integers(0, 3, 2000).astype(np.uint8)
    names = suffix_arrays._hashes(raw, size).tolist()
    strings = [raw[i : i + size].tobytes() for i in range(2000 - size + 1)]
    assert len(names) == len(strings) and len(set(zip(names, strings))) == len(set(names)) == len(set(strings))


@pytest.mark.parametrize("batch", [1, 5])
def test_shards_are_cut_between_anchors(spark, monkeypatch, batch):
    """Rows of a shard are compared a few anchors at a time, however the batches fall."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 200)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        rows = made(17, 40)
        rows += [(0, rows[8][1]), (40, rows[5][1] + " end"), (40, rows[5][1] + " fin"), (None, rows[5][1] * 2)]
        for dedup, split, join in ((suffix_arrays.dedup, lambda t: (t or "").encode(), bytes), (recompression.dedup, lambda t: (t or "").encode().split(), b" ".join)):
            got = dedup(frame(spark, rows).coalesce(1)).collect()
            assert sorted((-1 if x.doc_id is None else x.doc_id, x[1], x.n_removed, x.kept_sha256) for x in got) == brute_repeats(rows, split, join, 50)
    finally:
        spark.conf.set(name, before)


def test_shared_anchors_take_several_filters(spark, monkeypatch):
    """However many anchors are shared, a filter takes so many of them, documents aren't joined to them, and results don't depend on where a task asks the filters."""
    sizes, plans = [], []
    plain, cut = repeats._bloom, repeats._segments
    monkeypatch.setattr(repeats, "_bloom", lambda values, n: (sizes.append(values.count()) if values.columns == ["anchor"] else None) or plain(values, n))
    monkeypatch.setattr(repeats, "_segments", lambda *a: plans.append((got := cut(*a))._jdf.queryExecution().toString()) or got)
    for name, value in (("FILTER_VALUES", 15), ("HELD_ANCHORS", 40), ("HELD_TEXT", 3000)):
        monkeypatch.setattr(repeats, name, value, raising=False)
    rows = made(18, 50) + [(None, "go " * 900), (50, "go " * 700)]
    for dedup, split, join in ((suffix_arrays.dedup, lambda t: (t or "").encode(), bytes), (recompression.dedup, lambda t: (t or "").encode().split(), b" ".join)):
        sizes.clear()
        got = dedup(frame(spark, rows)).collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x[1], x.n_removed, x.kept_sha256) for x in got) == brute_repeats(rows, split, join, 50)
        assert max(sizes) < 40 and (dedup is not suffix_arrays.dedup or len(sizes) > 3)
    assert not any("Join" in p for p in plans)


def test_segments_of_a_frequent_anchor_send_few_rows(spark, monkeypatch):
    """Around a passage that very many texts have, only the passage goes on, once for all texts but the first; no other step deals the segments anew."""
    r = random.Random(19)
    passage = "all rights are reserved by those who have written this down, and by nobody else at all"
    rows = [(i, f"{r.random()} {r.random()} {passage} {r.random()} {r.random()}") for i in range(300)] + [(7, passage * 3), (None, "é" * 90 + passage), (301, "x" * 500), (302, "x" * 400)]
    sent, hot = [], []
    plain, cut = repeats._not_first, repeats._segments
    monkeypatch.setattr(repeats, "_not_first", lambda df, name: (sent.append(df.count()) if name == "w" else None) or plain(df, name))
    monkeypatch.setattr(repeats, "_segments", lambda *a: hot.append(got := cut(*a)) or got)
    got = suffix_arrays.dedup(frame(spark, rows), most_segments=100).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in got) == brute_repeats(rows, lambda t: t.encode(), bytes, 50)
    assert sent and sum(sent) < 7000  # a row a window: 21,567
    assert "Join" not in hot[0]._jdf.queryExecution().toString()
