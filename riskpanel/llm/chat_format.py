"""Chat formatting: a finite-state machine over roles and a declarative template.

A turn is written as begin + role + newline + text + end; control strings inside roles and texts are
escaped with a backslash so that reading back is exact. Segments carry a loss flag; only the texts of
the template's loss roles have it.

Defined results: a null text is empty, a null role is the empty role (never allowed by the machine); turns are
ordered by turn, role, text with nulls first, and repeated rows are turns of their own; a conversation
that breaks the turn order is formatted all the same, with valid false and the place of its first bad
turn; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What marks turns, which roles carry loss, and the machine: allowed next roles by state, start being "^"."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    control: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"^": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(x: Column, t: Template) -> Column:
    """Backslashes are doubled, control strings broken by a backslash after their first character, and newlines of roles are not touched."""
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit(t.control), F.lit(t.control[0] + "\\" + t.control[1:]))


def unescape(x: Column, t: Template) -> Column:
    """The inverse of escape_role and escape: what stands between pairs of backslashes holds single ones only."""
    inner = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\" + t.control[1:]), F.lit(t.control[1:]))
    return F.array_join(F.transform(F.split(x, r"\\\\", -1), inner), "\\")


def format_conversations(turns: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, valid, first_bad_turn (null: none), segments (text, loss) and formatted."""
    t = template
    rows = turns.select(F.col(conv).alias(conv), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"))
    # collect_list drops nothing here: the struct is never null. sort_array puts null turns first.
    convs = rows.groupBy(conv).agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    moves = F.array(*[F.lit(f"{a}\n{b}") for a, bs in t.turns.items() for b in bs])

    def step(state: Column, x: Column) -> Column:
        ok = F.array_contains(moves, F.concat(state["role"], F.lit("\n"), x["role"]))
        bad = F.when(state["bad"].isNotNull(), state["bad"]).when(~ok, state["at"])
        return F.struct((state["at"] + 1).alias("at"), x["role"].alias("role"), bad.alias("bad"))

    start = F.struct(F.lit(0).alias("at"), F.lit("^").alias("role"), F.lit(None).cast("int").alias("bad"))
    walked = convs.withColumn("_s", F.aggregate("_t", start, step))

    def segments(x: Column) -> Column:
        name = F.replace(escape(x["role"], t), F.lit("\n"), F.lit("\\n"))
        head = F.concat(F.lit(t.begin), name, F.lit("\n"))
        piece = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(escape(x["text"], t), x["role"].isin(*t.loss_roles)), piece(F.lit(t.end), F.lit(False)))

    out = walked.withColumn("segments", F.flatten(F.transform("_t", segments)))
    return out.select(
        conv, (F.col("_s.bad").isNull() & F.col("_s.role").isin(*t.final)).alias("valid"), F.col("_s.bad").alias("first_bad_turn"), "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )


def read_back(formatted: DataFrame, template: Template = CHATML, conv: str = "conv_id") -> DataFrame:
    """What stands in the output: turns (role, text) parsed from the formatted text, and the loss text from the segments."""
    t = template
    quoted = "\\Q" + t.end + "\\E"
    parts = F.split("formatted", quoted, -1)
    body = lambda p: F.substring(p, F.lit(len(t.begin) + 1), F.length(p))

    def turn(p: Column) -> Column:
        at = F.instr(body(p), "\n")
        return F.struct(unescape(F.substring(body(p), F.lit(1), at - 1), t).alias("role"), unescape_text(F.substring(body(p), at + 1, F.length(p)), t).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape_text(s["text"], t))
    return formatted.select("*", F.transform(F.slice(parts, 1, F.size(parts) - 1), turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def unescape_text(x: Column, t: Template) -> Column:
    """The inverse of escape: in a text a backslash before n is never made by escape, so only the other two forms occur."""
    broken = "\\" + t.control[1:]
    return F.array_join(F.transform(F.split(x, r"\\\\", -1), lambda p: F.replace(p, F.lit(broken), F.lit(t.control[1:]))), "\\")
