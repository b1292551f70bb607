"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A template declares, for each role, the text before and after a turn and whether the turn's own text counts for the loss;
a transition table says which role may follow in which state. A conversation's turns, in order, run through the machine
(fold over the roles), which gives whether the order is valid and the first turn that is not. Each turn gives three text
segments (prefix, text, suffix) with loss flags; the formatted text is their concatenation.

Texts cannot forge control strings: inside a text an escape character is set behind the first character of every control
string and before every escape character, and unescape() takes exactly those away again, so parse() reads the same turns
back from the formatted text.

Cases: null text is empty text; a null or unknown role is written with the template's fallback markers, its name kept in
them, and makes the order invalid; turns sort by turn (null first), then role and text, and repeated rows stay; a
conversation without an id is one group of its own; an empty table gives an empty result; further columns are ignored. A
conversation is one row of the result, so it has to fit a task; conversations are never joined or collected together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A declarative chat template: markers and loss flag of each role, and the machine that orders them."""

    turns: dict[str, Turn]
    #: state -> role -> next state; a role that a state lacks is an error
    steps: dict[str, dict[str, str]]
    start: str
    final: tuple[str, ...]
    #: control strings that texts must not forge, beside the markers' own
    control: tuple[str, ...] = ()
    #: markers of any other role; the escaped role stands between the two parts of ``before``
    other: tuple[str, str, str] = ("<r>", "</r>", "</s>")

    def __post_init__(self) -> None:
        strings = self.controls()
        for a in strings:
            if not a or ESCAPE in a or len(a) < 2:
                raise ValueError(f"a control string needs two characters and no escape sign: {a!r}")
            for b in strings:
                if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))) and a != b:
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")
        for one in self.turns.values():
            if not any(one.before.startswith(c) for c in strings) or not any(one.after.startswith(c) for c in strings):
                raise ValueError("markers have to start with a control string")

    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.control, *self.other]))


#: User and system turns in [INST] brackets, answers closed by </s>; only answers count for the loss.
INSTRUCT = Template(
    turns={"system": Turn("<s>[SYS]", "[/SYS]"), "user": Turn("<s>[INST]", "[/INST]"), "assistant": Turn("<s>[OUT]", "</s>", loss=True)},
    steps={"start": {"system": "opened", "user": "asked"}, "opened": {"user": "asked"}, "asked": {"assistant": "answered"},
           "answered": {"user": "asked"}},
    start="start", final=("answered",),
    control=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]"))


def _java(text: str) -> str:
    """A pattern for the text itself; every sign that is neither letter nor digit is escaped."""
    return re.sub(r"([^\w])", r"\\\1", text)


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    """Double every escape sign, then set one behind the first character of each control string."""
    heads: dict[str, list[str]] = {}
    for c in template.controls():
        heads.setdefault(c[0], []).append(c[1:])
    starts = "|".join(f"{_java(h)}(?={'|'.join(map(_java, rest))})" for h, rest in heads.items())
    out = F.replace(text, F.lit(ESCAPE), F.lit(2 * ESCAPE))
    return F.regexp_replace(out, F.lit(f"({starts})"), F.lit("$1\\\\"))


def unescape(text: Column) -> Column:
    """Take every escape sign away that stands alone, and one of every two."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(rows: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, valid, bad_turn, segments, formatted), one row per conversation.

    segments: array of (text, loss) in order; their texts joined are ``formatted``. bad_turn is the place (from 0) of the
    first turn that the machine refuses; null if there is none (an unfinished conversation is invalid without one)."""
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = F.col("role").isin(*template.turns)
    a, b, c = template.other
    before, after, loss = F.concat(F.lit(a), escape(F.coalesce("role", F.lit("")), template), F.lit(b)), F.lit(c), F.lit(False)
    for role, t in template.turns.items():
        mine = F.col("role") == role
        before, after, loss = (F.when(mine, F.lit(x)).otherwise(y) for x, y in ((t.before, before), (t.after, after), (t.loss, loss)))
    turns = turns.select("conv_id", F.struct("turn", "role", F.col("text").alias("raw"), before.alias("before"),
                                             escape(F.col("text"), template).alias("text"), after.alias("after"), loss.alias("loss"),
                                             F.coalesce(known, F.lit(False)).alias("known")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    step = F.create_map(*(F.lit(x) for s, to in template.steps.items() for r, n in to.items() for x in (f"{s}\n{r}", n)))
    state = F.aggregate(
        F.transform("turns", lambda t: F.coalesce(t["role"], F.lit(""))),
        F.struct(F.lit(template.start).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad")),
        lambda s, r: F.struct(
            F.coalesce(step[F.concat(s["at"], F.lit("\n"), r)], F.lit("error")).alias("at"), (s["n"] + 1).alias("n"),
            F.coalesce(s["bad"], F.when(step[F.concat(s["at"], F.lit("\n"), r)].isNull(), s["n"])).alias("bad")))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(t["before"].alias("text"), F.lit(False).alias("loss")), F.struct(t["text"].alias("text"), t["loss"].alias("loss")),
        F.struct(t["after"].alias("text"), F.lit(False).alias("loss")))))
    return whole.withColumn("state", state).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        (F.col("state.bad").isNull() & F.col("state.at").isin(*template.final)).alias("valid"), F.col("state.bad").alias("bad_turn"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column, template: Template = INSTRUCT) -> Column:
    """Array of (role, text, loss), read back from a formatted text by the template's markers."""
    a, b, c = template.other
    starts = "|".join(_java(t.before) for t in template.turns.values())
    # a turn ends with the closing marker that the next opening marker or the end of the text follows
    opening = f"{starts}|{_java(a)}"
    cut = F.split(formatted, f"(?<={'|'.join(dict.fromkeys([*(_java(t.after) for t in template.turns.values()), _java(c)]))})(?={opening}|\\z)", -1)
    cut = F.filter(cut, lambda x: x != "")

    def read(turn: Column) -> Column:
        named = F.substring_index(F.substring(turn, F.lit(len(a) + 1), F.length(turn)), b, 1)
        out = F.struct(unescape(named).alias("role"),
                       unescape(F.substring(turn, F.lit(len(a) + len(b) + 1) + F.length(named),
                                            F.length(turn) - F.length(named) - len(a) - len(b) - len(c))).alias("text"), F.lit(False).alias("loss"))
        for role, t in template.turns.items():
            inner = F.substring(turn, F.lit(len(t.before) + 1), F.length(turn) - len(t.before) - len(t.after))
            mine = F.struct(F.lit(role).alias("role"), unescape(inner).alias("text"), F.lit(t.loss).alias("loss"))
            out = F.when(turn.startswith(t.before), mine).otherwise(out)
        return out

    return F.transform(cut, read)
