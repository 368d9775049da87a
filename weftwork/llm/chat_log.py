"""Chat logs to training text; DataFrame functions only.

A log is a table of events. Those of a conversation, in order of their sequence, are

- ``message``: a turn begins, or begins anew, with a role and a text,
- ``delta``: a piece of text that is streamed to the end of a turn,
- ``edit``: the text of a turn is replaced,
- ``regenerate``: the text of a turn is emptied, for new deltas.

All but deltas also take away every later turn: what followed the old text is not part of the
conversation any more. A turn is final if no earlier turn has been set after it was set for the last
time itself, and its text is what that event and the deltas after it say. So the fold needs, for each
turn, its last setting event, and a running maximum over the turns before it; nothing is replayed.

Events are shuffled once, by conversation, those of one conversation being put together in each task
before that; all later steps, from sorting to the checksums, find them in place, as rows that Spark
can spill. Only a rendered conversation is one cell, as it is one document.

A template marks turns. Control strings inside roles and texts are told apart by one backslash more
after their first character than they have, which can be undone: ``</s>`` becomes ``<\\/s>``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "delta", "edit", "regenerate")


@dataclass(frozen=True)
class Template:
    """A turn is ``open``, the role, ``middle``, the text, ``close``. Roles in ``learned`` are under the loss mask. No text
    contains a string of ``control`` once it is escaped; the marks hold them."""

    open: str = "<s>[INST] "
    middle: str = " [/INST]"
    close: str = "</s>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = (self.open, self.middle, self.close)
        if any(len(c) < 2 or c[1] == "\\" for c in self.control):
            raise ValueError("control strings have two characters or more, of which the second isn't a backslash")
        if any(d.startswith(c[i:]) or c[i:].startswith(d) for c in self.control for d in self.control for i in range(1, len(c) - 1)):
            raise ValueError("no control string begins inside another one")
        if any(not any(c in mark for c in self.control) for mark in marks):
            raise ValueError("each mark holds a control string")
        if any(mark.startswith(mark[i:]) for mark in marks for i in range(1, len(mark))):
            raise ValueError("no mark ends as it begins")

    def _pattern(self, slashes: str) -> str:
        return "|".join(rf"(?<={re.escape(c[0])}){slashes}(?=\\*{re.escape(c[1:])})" for c in self.control)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(""), r"\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\"), "")


LLAMA = Template()


def fold(log: DataFrame) -> DataFrame:
    """``log(conv_id, seq, kind, turn, role, text, ...)`` -> ``(conv_id, turn, role, text)``, the final turns.

    ``seq`` and ``turn`` may be of any type that has an order; turns follow one another in theirs. Among
    events of one seq of a turn, setting ones come first, then texts in their order. A role is that of the last setting
    event that has one, and null if none has. A null kind is a delta, a null text empty; a null conv_id is a
    conversation like any other; a null turn or seq comes before others. Deltas of a turn that was never set, or has been
    taken away, are ignored, and so are events of other kinds than the four. An empty log gives an empty result; extra columns don't matter.
    """
    kind = F.coalesce("kind", F.lit("delta"))
    event = F.struct("turn", "seq", (kind == "delta").alias("added"), "role", F.coalesce("text", F.lit("")).alias("text"))
    mine = log.where(kind.isin(*KINDS)).select("conv_id", event.alias("e")).groupBy("conv_id").agg(F.collect_list("e").alias("events"))
    e = mine.select("conv_id", F.inline("events")).withColumn("at", F.struct("seq", "added"))
    set_by = ~F.col("added")
    turns = e.groupBy("conv_id", "turn").agg(
        F.max(F.when(set_by, F.struct("seq"))).alias("set_at"),
        F.max_by("role", F.when(set_by & F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.collect_list(F.struct("at", "text", "added")).alias("parts"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.where("set_at is not null").withColumn("cut", F.max("set_at").over(before)).where("cut is null or set_at >= cut")
    parts = F.array_sort(F.filter("parts", lambda p: F.struct(p["at"]["seq"]) >= F.col("set_at")))
    # Of several setting events of the last seq the last text counts.
    last = F.filter(parts, lambda p: ~p["added"])
    text = F.concat(F.element_at(last, -1)["text"], F.array_join(F.transform(F.filter(parts, lambda p: p["added"]), lambda p: p["text"]), ""))
    return turns.select("conv_id", "turn", "role", text.alias("text"))


def render(turns: DataFrame, template: Template = LLAMA) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``(conv_id, formatted, loss)``, one row for each conversation.

    ``loss`` lists (turn, start, end): the ranges of code points of the formatted text, from 0, that are to be learned,
    which are the escaped texts of the learned roles, and the places of their turns, from 0. Null roles and texts are
    empty. Equal turns follow one another in order of role and text.
    """
    t = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.middle))
    t = t.withColumn("head", head).withColumn("body", template.escape(F.col("text")))
    size = F.length("head") + F.length("body") + len(template.close)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("end", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(template.close)).withColumn("place", F.row_number().over(order) - 1)
    piece = F.struct("place", F.concat("head", "body", F.lit(template.close)).alias("piece"))
    span = F.struct("place", (F.col("end") - F.length("body")).alias("start"), "end")
    whole = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("role").isin(*template.learned), span))).alias("loss"),
    )
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), F.transform("loss", lambda s: F.struct(s["place"].alias("turn"), s["start"], s["end"])).alias("loss"))


def read(rendered: DataFrame, template: Template = LLAMA) -> DataFrame:
    """``(conv_id, formatted, loss)`` -> ``(conv_id, place, role, text, learned, chars)``: the turns that the marks tell apart, from
    place 0, with what lies under the mask in each (null if nothing does), all without escapes, and the turn's code points in the formatted text."""
    close, middle = template.close, template.middle
    none = lambda kind: F.lit(None).cast(kind)
    pieces = F.transform(F.split("formatted", re.escape(close)), lambda x, i: F.struct(i.cast("long").alias("place"), x.alias("piece"), none("long").alias("start"), none("long").alias("end")))
    spans = F.transform("loss", lambda s: F.struct(s["turn"].cast("long").alias("place"), none("string").alias("piece"), s["start"].alias("start"), s["end"].alias("end")))
    both = rendered.select("conv_id", F.inline(F.concat(pieces, spans)))
    turns = both.groupBy("conv_id", "place").agg(F.max("piece").alias("piece"), F.max("start").alias("start"), F.max("end").alias("end"))
    # Behind the last mark there is nothing.
    turns = turns.where(F.length("piece") > 0).withColumn("chars", (F.length("piece") + len(close)).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("from", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    at = F.instr("piece", middle)
    role = F.substring("piece", F.lit(len(template.open) + 1), at - 1 - len(template.open))
    text = F.substring("piece", at + len(middle), F.length("piece"))
    learned = F.substring("piece", (F.col("start") - F.col("from") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return turns.select("conv_id", "place", *[template.unescape(c).alias(n) for c, n in ((role, "role"), (text, "text"), (learned, "learned"))], "chars")


def digest(turns: DataFrame) -> DataFrame:
    """What ``read`` gives -> ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``."""
    line = F.struct("place", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("t"), F.coalesce("learned", F.lit("")).alias("l"))
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(line)).alias("lines"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join(F.transform("lines", lambda x: x["t"]), "")
    loss = F.array_join(F.transform("lines", lambda x: x["l"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def _event(n: Column, kind: str, text: Column, role: Column | None = None) -> Column:
    return F.struct(n.cast("int").alias("n"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))


def log_of(conversations: DataFrame, piece: int = 512) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as the log of their making: users and others begin with a draft and then edit
    it, assistants stream their text in pieces, after a first try that is generated anew. Rows of one turn are turns that follow one
    another by role and the MD5 of their texts; a null turn comes first, null roles and texts are empty. Folding gives each row once."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", role.alias("role"), F.md5(F.encode(text, "UTF-8")).alias("text"), F.monotonically_increasing_id().alias("row")).alias("at"), role.alias("role"), text.alias("text"))
    draft = F.substring("text", 1, 16)
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / piece).cast("int") - 1, F.lit(0)))
    deltas = F.transform(pieces, lambda k: _event(k + 3, "delta", F.substring("text", k * piece + 1, F.lit(piece))))
    streamed = F.concat(F.array(_event(F.lit(0), "message", F.lit(""), F.col("role")), _event(F.lit(1), "delta", draft), _event(F.lit(2), "regenerate", F.lit(""))), deltas)
    written = F.array(_event(F.lit(0), "message", draft, F.col("role")), _event(F.lit(1), "edit", F.col("text")))
    e = rows.select("conv_id", "at", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(written)).alias("e"))
    return e.select("conv_id", F.struct("at", "e.n").alias("seq"), "e.kind", F.col("at").alias("turn"), "e.role", "e.text")


def format_conversations(conversations: DataFrame, template: Template = LLAMA) -> DataFrame:
    """``conversations(conv_id, turn, role, text, ...)`` -> ``(conv_id, formatted, loss)``, by the log of their making."""
    return render(fold(log_of(conversations)), template)
