"""Chat formatting by a finite-state machine and a declarative template, in DataFrame operations.

A template says how each role opens and closes, which roles are trained on, and
which role may follow which.  The machine walks a conversation's turns; its states
are the roles and "start".  A turn that no transition allows is an error of the
conversation: the first one is reported, and the turns are formatted all the same.

Control strings inside texts and roles are escaped: the escape character and the
first character of every marker are replaced by two-character codes, so no marker
can occur inside a text, and unescaping gives the text back.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """`opens`, role, `then`, text, `closes` for each turn; `begins` and `ends` once. All markers start with `<`."""

    begins: str = "<s>"
    opens: str = "<|"
    then: str = "|>"
    closes: str = "<|end|>"
    ends: str = "</s>"
    trained: tuple[str, ...] = ("assistant",)
    follows: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    finals: tuple[str, ...] = ("assistant",)


DEFAULT = Template()
#: Escape codes: the escape character first, then what opens a marker, then what ends a role.
CODES = (("\\", "\\\\"), ("<", "\\l"), ("|", "\\p"))


def escaped(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Reads codes from the left: pairs of escape characters are parted from the rest first."""
    parts = F.split(text, re.escape("\\\\"), -1)

    def decoded(part: Column) -> Column:
        for plain, code in CODES[1:]:
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    return F.array_join(F.transform(parts, decoded), "\\")


def _walk(turns: Column, template: Template) -> Column:
    """Position of the first turn that the machine refuses, else -1, and the state it ends in."""
    allowed = F.array(*[F.lit(f"{a}\n{b}") for a, bs in template.follows.items() for b in bs])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("refused"))

    def step(m: Column, turn: Column) -> Column:
        ok = F.array_contains(allowed, F.concat(m["state"], F.lit("\n"), turn["role"]))
        return F.struct(turn["role"].alias("state"), (m["at"] + 1).alias("at"), F.when((m["refused"] < 0) & ~ok, m["at"]).otherwise(m["refused"]).alias("refused"))

    return F.aggregate(turns, start, step)


def formatted(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted, n_turns, refused_turn and valid.

    Turns stand in order of (turn, role, text), nulls first, so ties and repeated rows
    have one result.  A null role or text is an empty one; a role the template does
    not know is formatted, and makes the conversation invalid.  Rows with a null
    conversation form one conversation.  Other columns are ignored.  An empty table gives no rows.

    A conversation is one text in the end and so one row; its size is what a trainer reads at once.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    convs = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.opens), escaped(t["role"]), F.lit(template.then)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(t["text"]).alias("text"), t["role"].isin(list(template.trained)).alias("loss")),
                F.struct(F.lit(template.closes).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    edge = lambda s: F.array(F.struct(F.lit(s).alias("text"), F.lit(False).alias("loss")))
    out = convs.select("conv_id", F.concat(edge(template.begins), segments, edge(template.ends)).alias("segments"), _walk(F.col("turns"), template).alias("m"), F.size("turns").cast("long").alias("n_turns"))
    return out.select(
        "conv_id",
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        "n_turns",
        F.col("m.refused").alias("refused_turn"),
        ((F.col("m.refused") < 0) & F.col("m.state").isin(list(template.finals))).alias("valid"),
    )


def turns_of(text: Column, template: Template = DEFAULT) -> Column:
    """Reads a formatted conversation back: an array of (role, text)."""
    inner = F.substr(text, F.lit(len(template.begins) + 1), F.length(text) - len(template.begins) - len(template.ends))
    pieces = F.split(inner, re.escape(template.closes), -1)
    bodies = F.slice(pieces, 1, F.size(pieces) - 1)

    def parsed(p: Column) -> Column:
        cut = F.split(p, re.escape(template.then), 2)
        return F.struct(unescaped(F.substr(cut[0], F.lit(len(template.opens) + 1))).alias("role"), unescaped(cut[1]).alias("text"))

    return F.transform(bodies, parsed)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])))
