"""Chat formatting: a finite-state machine over roles and a declarative template, by DataFrame functions only.

A conversation's turns, in order, become text segments with a loss flag each. Every turn is an opening mark,
the text, and a closing mark; marks never carry loss, texts do where the template says so. The machine
tells whether the order of roles is allowed; conversations that break it are formatted all the same, with
``valid`` false and the state where they broke.

Control strings inside a text are escaped by putting one more escape character behind their first
character, and unescaped by taking one away. No escaped text holds a control string, and since control
strings begin with a character that occurs nowhere else in them, none arises where texts and marks meet;
so the formatted string splits back into its turns exactly.

A conversation's formatted text is one value, so its turns do meet in one row.

Defined cases: null text is empty text; null role is the role ''; roles unknown to the template are written
with their name and carry no loss; turns that share a number are ordered by role, then text; repeated rows
are turns of their own; null turn numbers come first; a null conv_id is a conversation; an empty table gives
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BROKEN = "start", "broken"


@dataclass(frozen=True)
class Marks:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``roles``: marks by role. ``control``: the strings that texts may not hold unescaped, which make up all
    marks. ``other``: marks of further roles; the name stands between its ``open`` and ``named``.
    ``moves``: next state by (state, role). ``final``: states in which a conversation may end."""

    roles: dict[str, Marks]
    control: tuple[str, ...]
    other: Marks
    named: str
    moves: dict[tuple[str, str], str]
    final: frozenset[str]
    escape: str = field(default="\\")

    def __post_init__(self) -> None:
        for c in self.control:
            if len(c) < 2 or any(c[0] in d[1:] for d in self.control) or self.escape in c:
                raise ValueError(f"{c!r}: a control string's first character may occur nowhere else in one")
        opens = [m.open for m in (*self.roles.values(), self.other)]
        if any(not o.startswith(self.control) for o in opens) or len(set(opens)) < len(opens):
            raise ValueError("each opening mark begins with a control string of its own")
        if any(a != b and b.startswith(a) for a in opens for b in opens):
            raise ValueError("no opening mark may begin another")
        if not all(any(c in m.close for c in self.control) for m in (*self.roles.values(), self.other)):
            raise ValueError("each closing mark holds a control string")


INSTRUCT = Template(
    roles={
        "system": Marks("[SYS] ", " [/SYS]"),
        "user": Marks("[INST] ", " [/INST]"),
        "assistant": Marks("<s> ", " </s>", loss=True),
    },
    control=("[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "</s>"),
    other=Marks("[ROLE] ", " </s>"),
    named=" [/ROLE] ",
    moves={
        (START, "system"): "briefed", (START, "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    },
    final=frozenset({"answered"}),
)


def escaped(text: Column, t: Template = INSTRUCT) -> Column:
    """``text`` with one more escape character in each control string."""
    e = re.escape(t.escape)
    firsts = "|".join(f"{re.escape(c[0])}(?={e}*{re.escape(c[1:])})" for c in t.control)
    return F.regexp_replace(text, firsts, "$0" + re.sub(r"[\\$]", r"\\\g<0>", t.escape))


def unescaped(text: Column, t: Template = INSTRUCT) -> Column:
    """The reverse of ``escaped``."""
    e = re.escape(t.escape)
    rests: dict[str, list[str]] = {}
    for c in t.control:
        rests.setdefault(c[0], []).append(re.escape(c[1:]))
    marks = "|".join(f"(?<={re.escape(first)}){e}(?={e}*(?:{'|'.join(r)}))" for first, r in rests.items())
    return F.regexp_replace(text, marks, "")


def _by_role(t: Template, role: Column, value, other) -> Column:
    out = None
    for name, marks in t.roles.items():
        out = (F if out is None else out).when(role == name, value(marks))
    return out.otherwise(other)


def end_state(roles: Column, t: Template = INSTRUCT) -> Column:
    """State of the machine after ``roles`` (array): the state reached, or 'broken'."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state} {role}", to)])
    return F.aggregate(roles, F.lit(START), lambda s, r: F.coalesce(F.element_at(moves, F.concat(s, F.lit(" "), r)), F.lit(BROKEN)))


def format_chat(turns: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text).

    ``segments`` array of (text, loss), ``formatted`` their texts joined, ``state`` where the machine ended,
    ``valid`` whether it may end there.
    """
    turn = F.struct(turns["turn"].alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    ordered = turns.groupBy(turns["conv_id"].alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(x: Column) -> Column:
        named = F.concat(F.lit(t.other.open), escaped(x["role"], t), F.lit(t.named))
        plain = F.lit(False)
        return F.array(
            F.struct(_by_role(t, x["role"], lambda m: F.lit(m.open), named).alias("text"), plain.alias("loss")),
            F.struct(escaped(x["text"], t).alias("text"), _by_role(t, x["role"], lambda m: F.lit(m.loss), plain).alias("loss")),
            F.struct(_by_role(t, x["role"], lambda m: F.lit(m.close), F.lit(t.other.close)).alias("text"), plain.alias("loss")))

    made = ordered.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"),
                          end_state(F.transform("turns", lambda x: x["role"]), t).alias("state"))
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                       "state", F.col("state").isin(sorted(t.final)).alias("valid"))


def parse_chat(formatted: Column, t: Template = INSTRUCT) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    opens = [m.open for m in (*t.roles.values(), t.other)]
    pieces = F.split(formatted, "(?!^)(?=" + "|".join(re.escape(o) for o in opens) + ")")

    def turn(piece: Column) -> Column:
        out = None
        for role, m in t.roles.items():
            body = F.substring(piece, F.lit(len(m.open) + 1), F.length(piece) - (len(m.open) + len(m.close)))
            out = (F if out is None else out).when(F.startswith(piece, F.lit(m.open)), F.struct(F.lit(role).alias("role"), unescaped(body, t).alias("text")))
        rest = F.substring(piece, F.lit(len(t.other.open) + 1), F.length(piece) - (len(t.other.open) + len(t.other.close)))
        at = F.position(F.lit(t.named), rest)
        return out.otherwise(F.struct(unescaped(F.substring(rest, F.lit(1), at - 1), t).alias("role"),
                                      unescaped(F.substring(rest, at + len(t.named), F.length(rest)), t).alias("text")))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def loss_text(segments: Column, t: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
