"""Chat formatting from a declarative template, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States are the role last seen. A template names what stands around each turn, which roles are learned, and the turn orders allowed.
TEMPLATE = {
    "head": "### ",  # then the role
    "open": "\n",  # then the text
    "close": "</turn>\n",
    "loss_roles": ["assistant"],
    "start": "start",
    "accept": ["assistant"],
    "moves": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
}


def escapes(template: dict, role: bool = False) -> list[tuple[str, str]]:
    """Every character that begins a control string (in a role's name the one that ends it too), and its stand-in: a backslash and a letter.

    A backslash always precedes a stand-in's letter, so the order of undoing is free of clashes. So escaped, a text holds no control string and none
    can begin in it. Raises where a template can't be read back: empty control strings, ones that begin with a backslash, or one that may begin within another.
    """
    head, opens, close = template["head"], template["open"], template["close"]
    if not (head and opens and close) or any(c.startswith("\\") for c in (head, opens, close)):
        raise ValueError("head, open and close of a template must not be empty or begin with a backslash")
    for a, b in ((head, close), (opens, close), (head, opens)):
        if b in a or any(b.startswith(a[i:]) for i in range(len(a))):
            raise ValueError(f"{b!r} of the template may begin within {a!r}")
    first = dict.fromkeys([close[0], head[0], *([opens[0]] if role else [])])
    letters = [x for x in "bcdefghijklmnopqrstuvwxyz" if x not in first]
    return [("\\", "\\" + letters[0]), *((c, "\\" + x) for c, x in zip(first, letters[1:]))]


def escape(text: Column, marks: list[tuple[str, str]]) -> Column:
    for plain, code in marks:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, marks: list[tuple[str, str]]) -> Column:
    for plain, code in [*marks[1:], marks[0]]:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, turn, role, text -> one row a conversation: conv_id, n_turns, segments, formatted, valid, state.

    segments: array of (text, loss) in output order, whose texts concatenated are `formatted`; loss is true for the
    escaped text of a learned role alone. A finite-state machine walks over the roles: `state` is where it stops
    ("invalid" if a move is missing), `valid` is true where that accepts. Conversations that are not valid are formatted too.

    Turns go by (turn, role, text), nulls first; a null role or text is an empty one; conversations with a null conv_id are
    one conversation. A conversation is one record of the output, so it must fit a row, as its digest must be of its whole text.
    An empty table gives no rows; other columns are ignored. Templates that can't be read back raise (see escapes()).
    """
    in_text, in_role = escapes(template), escapes(template, role=True)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    moves = F.create_map(*[F.lit(x) for a, to in template["moves"].items() for b in to for x in (f"{a}>{b}", b)])
    state = F.aggregate("turns", F.lit(template["start"]), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), t["role"])), F.lit("invalid")))

    def parts(t: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        no = F.lit(False)
        head = F.concat(F.lit(template["head"]), escape(t["role"], in_role), F.lit(template["open"]))
        return F.array(segment(head, no), segment(escape(t["text"], in_text), t["role"].isin(template["loss_roles"])), segment(F.lit(template["close"]), no))

    return (
        chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", parts)).alias("segments"), state.alias("state"))
        .select("*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("state").isin(template["accept"]).alias("valid"))
    )


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    in_text, in_role = escapes(template), escapes(template, role=True)
    pieces = F.split(formatted, re.sub(r"([^0-9A-Za-z\s])", r"\\\1", template["close"]))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, template["open"], 1)
        role = F.substring(head, len(template["head"]) + 1, 2**31 - 1)
        text = F.substr(piece, F.char_length(head) + len(template["open"]) + 1)
        return F.struct(unescape(role, in_role).alias("role"), unescape(text, in_text).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def learned_text(segments: Column, template: dict = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    marks = escapes(template)
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], marks)), "")
