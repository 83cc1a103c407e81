"""Chat formatting: a finite-state machine over roles, and a declarative template of text segments with loss flags.

Every conversation gives one row. Rows are ordered by turn (null first), then role, then text; repeated rows are
repeated turns. Null roles and texts are empty strings. A role that the template doesn't name is written with its
name. A conversation that breaks the turn order is formatted all the same and has valid = false. Null conv_id is a
conversation of its own. An empty table gives no rows. Other columns are ignored.

A conversation's text is one value, so its turns meet in one task; what is done per turn is done before that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (text before, text after, whether the turn's text bears loss); None: any other role, whose name is written.
TEMPLATE = {
    "system": ("<s>[SYS] ", " [/SYS]</s>", False),
    "user": ("<s>[INST] ", " [/INST]</s>", False),
    "assistant": ("<s>", "</s>", True),
    None: ("<s>[ROLE] ", "</s>", False),
}
ROLE_END = " [/ROLE] "
#: The control strings: what follows "<" and "[" in them.
CONTROLS = (("<", r"/?s>"), ("[", r"/?(?:INST|SYS|ROLE)\]"))
#: state and role -> the next state; what is missing is an error for good.
TRANSITIONS = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
ACCEPT = ("assistant",)


def escape(text: Column) -> Column:
    """One more backslash after the first character of each control string, escaped ones included: a bijection."""
    return reduce(lambda c, x: F.regexp_replace(c, rf"\{x[0]}(\\*)({x[1]})", rf"{x[0]}\\$1$2"), CONTROLS, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, x: F.regexp_replace(c, rf"\{x[0]}\\(\\*)({x[1]})", f"{x[0]}$1$2"), CONTROLS, text)


def turn_order(roles: Column, transitions=TRANSITIONS, accept=ACCEPT) -> Column:
    """Whether the machine accepts the roles."""
    arcs = F.create_map(*[F.lit(x) for (state, role), to in transitions.items() for x in (f"{state}>{role}", to)])
    last = F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(arcs, F.concat(s, F.lit(">"), r)), F.lit("error")))
    return last.isin(*accept)


def _segments(turn: Column, template: dict) -> Column:
    part = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    before, after, loss = template[None]
    out = F.array(part(F.concat(F.lit(before), escape(turn["role"]), F.lit(ROLE_END)), False), part(turn["text"], loss), part(F.lit(after), False))
    for role, (before, after, loss) in template.items():
        if role is not None:
            out = F.when(turn["role"] == role, F.array(part(F.lit(before), False), part(turn["text"], loss), part(F.lit(after), False))).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: dict = TEMPLATE, transitions=TRANSITIONS, accept=ACCEPT) -> DataFrame:
    """conv_id, n_turns, valid, segments array<struct<text, loss>>, formatted."""
    turns = rows.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t"))
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    one = one.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turn_order(F.transform("turns", lambda t: t["role"]), transitions, accept).alias("valid"), F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"))
    return one.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    ends = F.split(formatted, "</s>", -1)

    def turn(part: Column) -> Column:
        cut = lambda before, after: unescape(F.substring(part, F.lit(len(before) + 1), F.char_length(part) - len(before) - len(after)))
        row = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
        out = row(F.lit("assistant"), cut("<s>", ""))
        for role in ("system", "user"):
            before, after, _ = template[role]
            out = F.when(F.startswith(part, F.lit(before)), row(F.lit(role), cut(before, after.removesuffix("</s>")))).otherwise(out)
        named = template[None][0]
        head, end = F.instr(part, "[/ROLE]"), len("[/ROLE] ")
        role = unescape(F.substring(part, F.lit(len(named) + 1), head - 2 - len(named)))
        return F.when(F.startswith(part, F.lit(named)), row(role, unescape(F.substring(part, head + end, F.char_length(part))))).otherwise(out)

    return F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), turn)
