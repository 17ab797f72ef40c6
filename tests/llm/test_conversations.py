"""op13: faults by plain loops, and the cheapest edits by searching all of them in the order of their cost."""

import hashlib
import heapq
import random
import zlib

import pytest

from pluvia.llm import conversations as co
from pluvia.llm import queries

SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """rows: (role, text, fault). All edit sequences, cheapest first, then least audit."""
    heap = [(0, "", 0, "")]
    seen = set()
    while True:
        cost, audit, i, roles = heapq.heappop(heap)
        if (i, roles[-1:], roles[:1] == "s", len(audit) and i) in seen:
            continue
        if i == len(rows) and (not roles or roles[-1] == "a"):
            return cost, audit
        seen.add((i, roles[-1:], roles[:1] == "s", len(audit) and i))

        def go(more, letter, j, role):
            new = roles + role
            legal = all(x + y in ("su", "ua", "au") for x, y in zip(new, new[1:])) and new[:1] in ("", "s", "u")
            if legal:
                heapq.heappush(heap, (cost + more, audit + letter, j, new))

        for role in "ua":
            go(3, "I", i, role)
        if i < len(rows):
            role, _, fault = rows[i]
            go(4, "D", i + 1, "")
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a") and role:
                    go(more, "K", i + 1, role[0])
                for r in "ua":
                    go(3 + more, "R", i + 1, r)


def expected(rows):
    """rows of one conversation: (turn, role, text), before faults are found."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    judged, seen = [], set()
    for _, _, r, x in rows:
        bare = x.rstrip(SPACES)
        fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((r, x))
        judged.append((r, x, fault))
    cost, audit = cheapest(judged)
    out, left, s = [], iter(judged), False
    for e in audit:
        r, x, _ = ("", "", None) if e == "I" else next(left)
        if e == "D":
            continue
        if e != "K":
            r = "user" if (len(out) - s) % 2 == 0 else "assistant"
        elif not out and r[:1] == "s":
            s = True
        out.append(f"{r}:{x}")
    turns = [t for there, t, _, _ in rows if there]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = {k: sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")}
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def talk(r, n):
    texts = ["Yes.", "No", "Why?", "", " \n", "I see!", " ", "ok.  ", "é. "]
    return [(r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice([*texts, None])) for _ in range(n)]


def test_repair_is_the_cheapest(spark):
    r = random.Random(3)
    convs = {k: talk(r, r.randint(1, 7)) for k in range(150)} | {None: talk(r, 5), 1000: [(i, "user", f"{i}.") for i in range(5)], 1001: [(i, "assistant", f"{i}") for i in range(5)]}
    rows = [(c, t, role, x, "clash") for c, some in convs.items() for t, role, x in some]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string").repartition(5)
    found = {x["conv_id"]: tuple(x)[1:] for x in co.repair(df).collect()}
    assert found == {c: expected(some) for c, some in convs.items()}
    turns = co.edited_turns(df).orderBy("nth").collect()
    for c, some in convs.items():
        mine = [x for x in turns if x["conv_id"] == c]
        assert "".join(x["edit"] for x in mine) == found[c][6]
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in mine if x["edit"] != "D").encode()).hexdigest() == found[c][7]


def test_runs_are_stepped_by_powers():
    """A run of 100,000 rows takes 17 products, and the same cost as row by row."""
    p = co.Repair()
    p.power(0 * 4 + 1, 17)
    runs = [(1, 100_001), (2, 3), (8, 40_000), (6, 5)]
    bounds = p.costs(runs)
    slow = p.last
    for symbol, n in reversed(runs):
        for _ in range(n):
            slow = co.times(p.power(symbol, 0), slow[:, None])[:, 0]
    assert (bounds[0] == slow).all()
    assert max(k for _, k in p.powers) == 17
    cost, audit = p.audit(runs)
    assert cost == bounds[0][0] and sum(e != "I" for e in audit) == sum(n for _, n in runs)


def test_long_conversations_wait_in_a_file(spark, monkeypatch):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * 1000 + f"{i}.") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = co.repair(df).collect()[0]
    assert whole["audit"] == "K" * 200 and whole["cost"] == 0
    batch = co._in_order(df, None).toArrow().to_batches()
    monkeypatch.setattr(co, "HELD", 1000)
    assert [tuple(x.values()) for b in co._repaired(batch, False) for x in b.to_pylist()] == [tuple(whole)]


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert co.repair(empty).count() == 0
    got = co.repair(empty, spark.createDataFrame([(5,), (5,), (None,)], "conv_id long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (5, None)], key=str)


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "made"])
def test_op13_query(spark, tmp_path, table):
    if table == "made":
        r = random.Random(9)
        rows = [(c, i if r.random() > 0.1 else None, r.choice(["user", "assistant", None]), r.choice(["Hi.", "Well", None, "So? Yes! No."])) for c in [*range(40), None] for i in range(r.randint(1, 6))]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
        table = str(tmp_path)
    convs = {}
    for x in spark.read.parquet(f"{table}/conversations.parquet").collect():
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (x["conv_id"], x["turn"])).encode()) % 20
        role, text = (" " if v is None else v for v in (x["role"], x["text"]))
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        convs.setdefault(x["conv_id"], []).extend([(x["turn"], role, text)] * {0: 0, 3: 2}.get(kind, 1))
    got = {x["conv_id"]: tuple(x)[1:] for x in queries.op13_conversation_repair(spark, table).collect()}
    assert got == {c: expected(some) for c, some in convs.items()}
