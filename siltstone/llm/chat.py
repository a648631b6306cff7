"""Chat formatting: a declarative template, a finite-state machine over roles, and segments with loss flags. DataFrame operations alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (mark that opens a turn, mark that closes it, whether its text is trained on). Roles not listed use OTHER.
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Opens a turn of any other role, parts the role's name from the text, closes the turn.
OTHER = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")

#: state -> role -> next state. A missing entry leads to "error", which nothing leaves.
TURN_ORDER = {
    "start": {"system": "briefed", "user": "asked"},
    "briefed": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
#: States in which a conversation may end.
COMPLETE = ("answered",)


def _marks(template: dict, other: tuple[str, str, str]) -> list[str]:
    marks = [m for o, c, _ in template.values() for m in (o, c)] + list(other)
    for m in marks:
        if len(m) < 2 or "\\" in m or any(m.startswith(m[i:]) for i in range(1, len(m))):
            raise ValueError(f"mark {m!r}: two characters or more, no backslash, no end that is also its beginning")
    if len(set(marks)) < len(marks):
        raise ValueError("marks must differ")
    for m in marks:
        for n in marks:
            if m != n and (n in m or any(n.startswith(m[i:]) for i in range(1, len(m)))):
                raise ValueError(f"marks {m!r} and {n!r} overlap: a text beside one could read as the other")
    return marks


def escape(text: Column, marks: list[str]) -> Column:
    """Doubles backslashes and puts one after the first character of each mark, so no mark is left; see unescape."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for m in marks:
        out = F.replace(out, F.lit(m), F.lit(m[0] + "\\" + m[1:]))
    return out


def unescape(text: Column) -> Column:
    """Undoes escape: every backslash goes and the character after it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_state(roles: Column, order: dict = TURN_ORDER) -> Column:
    """The state that the machine ends in, after reading an array of roles from "start"."""
    table = F.create_map(*[F.lit(x) for state, to in order.items() for role, end in to.items() for x in (f"{state} {role}", end)])
    step = lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(" "), role)), F.lit("error"))
    return F.aggregate(roles, F.lit("start"), step)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: dict = TEMPLATE, other: tuple[str, str, str] = OTHER, order: dict = TURN_ORDER, complete: tuple[str, ...] = COMPLETE) -> DataFrame:
    """One row for each conversation: its id, n_turns, end_state, valid, segments (array of text, loss), formatted.

    A turn becomes three segments: its opening mark, its escaped text, its closing mark; only the texts of trained roles
    carry the loss flag. formatted is all segments together. Conversations whose turn order the machine refuses, or that end
    in a state that isn't complete, are formatted too, with valid false.

    Turns are sorted by turn, then role, then text; null turns come first, null text and null role count as empty, and
    repeated rows stay. Rows without a conversation id are one conversation with a null id. An empty table gives no rows. The
    output has a whole conversation in one row, so a conversation's turns meet in one task; nothing else does.
    """
    marks = _marks(template, other)
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segment(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def segments(t: Column) -> Column:
        own = F.array(segment(F.concat(F.lit(other[0]), escape(t["role"], marks), F.lit(other[1])), False), segment(escape(t["text"], marks), False), segment(F.lit(other[2]), False))
        for role, (opens, closes, loss) in template.items():
            own = F.when(t["role"] == role, F.array(segment(F.lit(opens), False), segment(escape(t["text"], marks), loss), segment(F.lit(closes), False))).otherwise(own)
        return own

    state = turn_state(F.transform("turns", lambda t: t["role"]), order)
    return chats.select(
        F.col("conv").alias(conv_col),
        F.size("turns").cast("long").alias("n_turns"),
        state.alias("end_state"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).select(
        conv_col,
        "n_turns",
        "end_state",
        F.col("end_state").isin(*complete).alias("valid"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(chats: DataFrame, template: dict = TEMPLATE, other: tuple[str, str, str] = OTHER) -> DataFrame:
    """The output of format_chats with turns (array of role, text) and trained, the text under the loss flags; both are read from segments, whose texts joined are formatted."""
    closes = "|".join(re.escape(m) for m in [c for _, c, _ in template.values()] + [other[2]])

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(other[0]) + 1), F.char_length(piece))
        parts = F.split(body, re.escape(other[1]), 2)
        out = F.struct(unescape(parts[0]).alias("role"), unescape(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("text"))
        for role, (opens, _, _) in template.items():
            text = unescape(F.substring(piece, F.lit(len(opens) + 1), F.char_length(piece)))
            out = F.when(F.startswith(piece, F.lit(opens)), F.struct(F.lit(role).alias("role"), text.alias("text"))).otherwise(out)
        return out

    pieces = F.split(F.array_join(F.transform("segments", lambda s: s["text"]), ""), closes, -1)
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.withColumns({"turns": F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn), "trained": trained})
