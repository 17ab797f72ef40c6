"""Repair of conversation structure: faults of turns, and the cheapest edits that give a legal order of roles, by a run-length min-plus program."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.common import small_batches

#: Costs of edits; UNFINISHED is added for a truncated turn that stays.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: Symbols of a row: the initial of its role, and what its fault asks for. GONE has to go, whatever its role.
ROLES, FINE, TRUNCATED, GONE = "sua?", 0, 4, 8
#: States: nothing yet, after the system's turn, after a user's, after an assistant's. The first and the last may end.
STATES, ENDS = 4, (0, 3)
_NEVER = np.int64(1) << 60
#: Bytes of a conversation that are held in memory until its edits are known; longer ones wait in a file of the task.
HELD = 16 << 20


def step(state: int, symbol: int, edit: str) -> tuple[int, int] | None:
    """Next state and cost of an edit; None if it isn't allowed. symbol: of the row at hand (any for an insertion)."""
    asked = {0: 2, 1: 2, 2: 3, 3: 2}[state]  # the state that the next user's or assistant's turn gives
    more = UNFINISHED if symbol & TRUNCATED else 0
    if edit == "I":
        return asked, INSERT
    if edit == "D":
        return state, DELETE
    if symbol >= GONE:
        return None
    if edit == "R":
        return asked, REROLE + more
    role = ROLES[symbol % 4]
    if role == "s" and state == 0:
        return 1, more
    return (asked, more) if role == "ua"[asked - 2] else None


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _NEVER)


class Repair:
    """Cheapest edits of a row of symbols. Powers of a symbol's transition are kept from one conversation to the next."""

    def __init__(self) -> None:
        once = np.full((STATES, STATES), _NEVER)
        for s in range(STATES):
            to, cost = step(s, FINE, "I")
            once[s, to] = cost
        kept = np.where(np.eye(STATES, dtype=bool), np.int64(0), once)
        self.inserts = times(times(kept, kept), kept)  # any number of insertions: more than three never pay
        self.last = times(self.inserts, np.array([[0 if s in ENDS else _NEVER] for s in range(STATES)], np.int64))[:, 0]
        self.powers: dict[tuple[int, int], np.ndarray] = {}

    def power(self, symbol: int, k: int) -> np.ndarray:
        """The transition over 2 ** k rows of the symbol, insertions before them included."""
        if (symbol, k) not in self.powers:
            if k:
                half = self.power(symbol, k - 1)
                self.powers[symbol, k] = times(half, half)
            else:
                row = np.full((STATES, STATES), _NEVER)
                for s in range(STATES):
                    for edit in "DKR":
                        if got := step(s, symbol, edit):
                            row[s, got[0]] = min(row[s, got[0]], got[1])
                self.powers[symbol, k] = times(self.inserts, row)
        return self.powers[symbol, k]

    def costs(self, runs: list[tuple[int, int]]) -> list[np.ndarray]:
        """Cheapest cost from each state to the end, before each run and after the last: a run takes as many products as its length has bits."""
        after = [self.last]
        for symbol, n in reversed(runs):
            v, k = after[-1], 0
            while n:
                if n & 1:
                    v = times(self.power(symbol, k), v[:, None])[:, 0]
                n >>= 1
                k += 1
            after.append(v)
        return after[::-1]

    def audit(self, runs: list[tuple[int, int]]) -> tuple[int, str]:
        """Cost and the initials of the edits, of equally cheap ones the least: an edit is D, I, K or R, and leads to one state only."""
        bounds = self.costs(runs)
        state, out = 0, []
        for nth, (symbol, n) in enumerate(runs):
            inside = np.empty((n + 1, STATES), np.int64)  # costs behind the last row of the run, the one before, ...
            inside[0] = bounds[nth + 1]
            for left in range(1, n + 1):
                inside[left] = times(self.power(symbol, 0), inside[left - 1][:, None])[:, 0]
            for left in range(n, 0, -1):
                edit = ""
                while edit in ("", "I"):
                    for edit in "DIKR":
                        got = step(state, symbol, edit)
                        if got and got[1] + inside[left if edit == "I" else left - 1][got[0]] == inside[left][state]:
                            break
                    state = got[0]
                    out.append(edit)
        while self.last[state]:
            state = step(state, FINE, "I")[0]
            out.append("I")
        return int(bounds[0][0]), "".join(out)


def collapsed(symbols: bytes) -> list[tuple[int, int]]:
    """Runs of equal symbols."""
    x = np.frombuffer(symbols, np.uint8)
    if not len(x):
        return []
    cuts = np.flatnonzero(np.diff(x)) + 1
    return list(zip(x[np.r_[0, cuts]].tolist(), np.diff(np.r_[0, cuts, len(x)]).tolist()))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> the same with fault: blank (no word), duplicate (role and text came before in the conversation), truncated (doesn't end with . ! or ?)
    or null; of several the first counts. Rows of a turn are in the order of role and text, a null turn comes first; a null role or text is one space.

    Duplicates are found by digest within a conversation, so a long conversation is dealt to many tasks here.
    """
    said = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    same = F.sha2(F.concat(F.col("role"), F.lit("\n"), F.col("text")), 256)
    nth = F.row_number().over(Window.partitionBy("conv_id", "__same").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    said = said.withColumn("__same", same).withColumn("__nth", nth)
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(bare == "", "blank").when(F.col("__nth") > 1, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    return said.withColumn("fault", fault).drop("__same", "__nth")


_SUMMARY = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


class _Conversation:
    """What is held of one conversation: a symbol a row, and the rows themselves in memory up to HELD bytes."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.symbols, self.rows = conv_id, bytearray(), tempfile.SpooledTemporaryFile(HELD)
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.distinct, self.least, self.most, self.initial = 0, 0, None, None, None

    def add(self, turn, role: str, text: str, fault) -> None:
        initial = role[:1]
        if self.symbols and f"{self.initial}{initial}" not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.most:  # turns come in order
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.distinct += 1
        if fault:
            self.count[fault] += 1
        kind = GONE if fault in ("blank", "duplicate") else TRUNCATED if fault else FINE
        self.symbols.append(GONE if kind == GONE else kind + (ROLES.index(initial) if initial in ("s", "u", "a") else 3))
        for part in (role, text):
            raw = part.encode("utf-8", "surrogatepass")
            self.rows.write(len(raw).to_bytes(8, "little") + raw)

    def read(self) -> Iterator[tuple[str, str]]:
        self.rows.seek(0)
        for _ in self.symbols:
            yield tuple(self.rows.read(int.from_bytes(self.rows.read(8), "little")).decode("utf-8", "surrogatepass") for _ in range(2))

    def edits(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text; of a deleted turn what it was."""
        rows, state = self.read(), 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rows)
            if edit != "D":
                asked = 3 if state == 2 else 2
                if edit == "K" and role[:1] == "s":
                    state = 1
                else:
                    state = asked
                    if edit != "K":
                        role = "user" if asked == 2 else "assistant"
            yield edit, role, text


def _repaired(batches: Iterable[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of conversations and turns: a summary a conversation, or its edits one by one."""
    program = Repair()

    def close(c: _Conversation) -> Iterator[tuple]:
        cost, audit = program.audit(collapsed(bytes(c.symbols)))
        sha, between = hashlib.sha256(), b""
        for nth, (edit, role, text) in enumerate(c.edits(audit)):
            if turns:
                yield c.conv_id, nth, edit, role, text
            elif edit != "D":
                sha.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between = b"\n"
        c.rows.close()
        if not turns:
            gaps = c.most - c.least + 1 - c.distinct if c.distinct else 0
            yield c.conv_id, gaps, *c.count.values(), c.illegal, cost, audit, sha.hexdigest()

    schema = _TURNS if turns else _SUMMARY

    def rows() -> Iterator[tuple]:
        now = None
        for b in batches:
            for conv_id, turn, role, text, fault, there in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "there"))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield from close(now)
                    now = _Conversation(conv_id)
                if there:
                    now.add(turn, role, text, fault)
        if now is not None:
            yield from close(now)

    def packed(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)

    some, size = [], 0
    for row in rows():
        some.append(row)
        size += len(row[4]) if turns else len(row[7])
        if len(some) == 512 or size > 1 << 22:
            yield packed(some)
            some, size = [], 0
    if some:
        yield packed(some)


def _in_order(rows: DataFrame, also: DataFrame | None) -> DataFrame:
    small_batches(rows.sparkSession)
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    told = faults(rows.select(*[F.col(c).cast(t) for c, t in kinds.items()])).withColumn("there", F.lit(True))
    if also is not None:
        told = told.unionByName(also.select(F.col("conv_id").cast("long")).distinct().withColumn("there", F.lit(False)), allowMissingColumns=True)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").eqNullSafe("duplicate")]  # of a turn's equal rows the first is no duplicate
    return told.repartition("conv_id").sortWithinPartitions(*order)


def repair(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest repair and digest of each conversation of rows (conv_id, turn, role, text).

    Edits: keep a turn, give it the role user or assistant (3), delete it (4; blank and duplicate turns have to go), insert an empty turn of user or assistant anywhere (3);
    a truncated turn that stays adds 3. The roles' initials are to be nothing, or an optional s and then ua once or more; of equally cheap repairs the one whose audit (initials of the edits, in order)
    is least. Equal consecutive symbols (role and fault) are one step of the program, by binary powers of the symbol's transition.

    A conversation is audited by one task, since its audit is one value; rows stream through it in Spark's order, and wait in a file of the task beyond 16 MB.
    also: conversations to return even if they have no rows: zeros, an empty audit and the digest of the empty string. See faults() for nulls and ties;
    a null conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
    Returns conv_id, gaps (turns that are missing between the first and the last), blank, duplicate, truncated, illegal (neighbours not su, ua or au), cost, audit, repaired_sha256
    (of role:text of the repaired turns, joined by newlines).
    """
    return _in_order(rows, also).mapInArrow(lambda b: _repaired(b, False), "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def edited_turns(rows: DataFrame) -> DataFrame:
    """The repair turn by turn: conv_id, nth (from 0), edit (K, R, D or I), role and text (of a deleted turn what they were)."""
    return _in_order(rows, None).mapInArrow(lambda b: _repaired(b, True), "conv_id long, nth long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults by the CRC-32 of conv_id:turn modulo 20 (a null is one space there, and as a role or text): 0 drops the row, 1 empties its text, 2 takes . ! and ? out of it,
    3 repeats it, 4 makes it the user's."""
    def key(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn"))) % 20
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.regexp_replace(key("text"), "[.!?]", "")).otherwise(key("text"))
    role = F.when(F.col("__k") == 4, "user").otherwise(key("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("__k") == 3, 2).otherwise(1)))
    return rows.withColumn("__k", kind).where("__k != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__c")).drop("__c")
