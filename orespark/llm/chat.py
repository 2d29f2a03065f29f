"""Chat formatting by a declarative template, and reading it back. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a turn looks like, the roles whose texts are learned from, and the automaton of roles: from each state the state
    that a role leads to. Control strings, which all begin with ``mark``, are escaped by ``escape`` inside the mark, and so is
    what ends a role, inside a role."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    mark: str = "<|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    states: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})

    def escaped(self, text: Column) -> Column:
        """No mark is left, and the way back is unique."""
        return F.replace(F.replace(text, F.lit(self.escape), F.lit(self.escape * 2)), F.lit(self.mark), F.lit(self.mark[0] + self.escape + self.mark[1:]))

    @property
    def ends_role(self) -> str:
        """What stands in a role for what would end it: no escaped text holds it."""
        return f"{self.mark[0]}{self.escape}n"

    def escaped_role(self, role: Column) -> Column:
        return F.replace(self.escaped(role), F.lit(self.after_role), F.lit(self.ends_role))

    def plain_role(self, role: Column) -> Column:
        return self.plain(F.replace(role, F.lit(self.ends_role), F.lit(self.after_role)))

    def plain(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit(self.mark[0] + self.escape + self.mark[1:]), F.lit(self.mark)), F.lit(self.escape * 2), F.lit(self.escape))


DEFAULT = Template()


def format_chat(turns: DataFrame, template: Template = DEFAULT, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segments (array of text, loss), formatted, loss_spans (array of start, length in code points), valid,
    n_turns: one row for each conversation.

    Turns stand by turn, then role and text, so ties have one order; repeated rows are turns of their own. A null text or role
    counts as empty, a null turn comes first, rows without an id are one conversation. valid tells whether the automaton of
    roles takes the turns; those it doesn't take are formatted all the same. An empty table gives an empty result. Other
    columns are not read. A conversation's turns meet in one row: it is one document of training.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(template.begin), template.escaped_role(F.col("role")), F.lit(template.after_role))).withColumn("body", template.escaped(F.col("text")))
    # where each turn begins: a running sum in the order that the turns then meet in
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = (F.length("head") + F.length("body") + F.lit(len(template.end))).cast("long")
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "head", "body"))).alias("t"))

    # a map from "state role" to the next state; what it lacks leads to the state "bad", from which nothing leads on
    step = F.create_map(*[F.lit(x) for state, to in template.states.items() for role, next_state in to.items() for x in (f"{state} {role}", next_state)])
    state = F.aggregate("t", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(step, F.concat_ws(" ", s, x["role"])), F.lit("bad")))

    def learned(x):
        return x["role"].isin(list(template.loss_roles))

    def segments(x):
        parts = ((x["head"], F.lit(False)), (x["body"], learned(x)), (F.lit(template.end), F.lit(False)))
        return F.array(*[F.struct(a.alias("text"), b.alias("loss")) for a, b in parts])

    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(template.end))), "")
    spans = F.transform(F.filter("t", learned), lambda x: F.struct((x["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length")))
    return whole.select("conv_id", F.flatten(F.transform("t", segments)).alias("segments"), formatted.alias("formatted"), spans.alias("loss_spans"), (state != "bad").alias("valid"), F.size("t").cast("long").alias("n_turns"))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """From conv_id, formatted, segments: turns (array of role, text), read from the formatted text, and loss_text, read from the
    segments that are learned from, both unescaped."""
    cut = F.filter(F.split("formatted", _quoted(template.begin), -1), lambda p: p != "")

    def turn(p):
        body = F.substring_index(p, template.end, 1)
        at = F.instr(body, template.after_role)
        return F.struct(template.plain_role(F.substring(body, F.lit(1), at - 1)).alias("role"), template.plain(F.substring(body, at + len(template.after_role), F.length(body))).alias("text"))

    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.plain(s["text"]))
    return formatted.withColumn("turns", F.transform(cut, turn)).withColumn("loss_text", F.array_join(learned, ""))


def _quoted(text: str) -> str:
    return reduce(lambda x, c: x.replace(c, "\\" + c), "\\|<>[](){}.*+?^$", text)


def chat_digests(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, read back from the formatted text."""
    back = read_back(format_chat(turns, template), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
