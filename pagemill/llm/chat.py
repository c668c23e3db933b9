"""Conversations as training windows within a token budget, in DataFrame functions alone.

A conversation is cut at turns. Prefix sums of turn tokens deal its turns into windows; each window repeats
the system turn and as much of the preceding turns as the history budget holds. Only assistant texts that
appear for the first time are under the loss mask, so each is learned once.

A turn is written ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Inside texts and roles a backslash is
doubled and ``<|`` becomes ``<\\|``; in roles a newline becomes ``<\\n|``. So no text holds a control string,
and reading back is exact.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


class Budget(NamedTuple):
    """In tokens, counted as one for each four bytes of a written turn, rounded up. A window is larger only
    if its system turn or one of its turns is longer than half the room for new turns."""

    window: int = 2048
    history: int = 512
    system: int = 256

    @property
    def stride(self) -> int:
        return max(1, (self.window - self.history - self.system) // 2)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """After doubling, a lone backslash stands only between ``<`` and ``|``, so this order is exact."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def chat_windows(turns: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(conv_id, window, n_tokens, n_repeated, loss_spans, formatted) for rows (conv_id, turn, role, text).

    ``n_repeated`` turns at the front were in an earlier window; ``loss_spans`` are code point ranges
    [start, end) of ``formatted``. The system turn is a first turn with the role ``system``. Null roles and
    texts are empty; a null conv_id is a conversation of its own; turns without or with one number are ordered
    by role and text, nulls first, and repeated rows are repeated turns. Other columns are left out.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("body", escape(F.col("text")))
    tail = F.lit(END + "\n")
    rows = rows.withColumn("tokens", F.ceil(F.octet_length(F.concat("head", "body", tail)) / 4))
    order = ["turn", "role", "text"]
    talk = Window.partitionBy("conv_id").orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(talk))
    rows = rows.withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))
    counted = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    before = talk.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(counted).over(before), F.lit(0)))
    history = F.lit(budget.history)
    slot = lambda tokens: F.floor(tokens / F.lit(budget.stride))
    rows = rows.withColumn("own", slot(F.col("before")))
    rows = rows.withColumn("last", F.max("own").over(Window.partitionBy("conv_id")))
    reach = F.when(F.col("system"), F.col("last")).otherwise(F.least(F.col("last"), slot(F.col("before") + history)))
    rows = rows.withColumn("window", F.explode(F.sequence("own", reach)))
    rows = rows.withColumn("first", F.col("own") == F.col("window"))
    window = Window.partitionBy("conv_id", "window")
    rows = rows.withColumn("begins", F.min(F.when(F.col("first"), F.col("before"))).over(window))
    near = F.col("before") >= F.col("begins") - history
    rows = rows.where(F.col("begins").isNotNull() & (F.col("first") | F.col("system") | near))
    upto = window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END) + 1
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(upto), F.lit(0)) + F.length("head"))
    loss = F.when(F.col("first") & (F.col("role") == "assistant"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    written = F.struct("place", F.concat("head", "body", tail).alias("t"))
    spans = F.struct("place", loss.alias("s"))
    return (
        rows.groupBy("conv_id", "window")
        .agg(
            F.sum("tokens").alias("n_tokens"),
            F.count(F.when(~F.col("first"), 1)).alias("n_repeated"),
            F.array_sort(F.collect_list(spans)).alias("spans"),
            F.array_sort(F.collect_list(written)).alias("written"),
        )
        .select(
            "conv_id",
            "window",
            "n_tokens",
            "n_repeated",
            F.filter("spans.s", lambda s: s.isNotNull()).alias("loss_spans"),
            F.array_join("written.t", "").alias("formatted"),
        )
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns array<struct<role, text>>, loss_text, size): the turns that are new in each window, and
    what the loss mask covers, both unescaped, from the written text alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    fresh = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated").cast("int"), F.lit(0)))
    role = lambda t: F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)
    text = lambda t: F.substr(t, F.instr(t, "\n") + 1)
    parsed = F.transform(fresh, lambda t: F.struct(unescape_role(role(t)).alias("role"), unescape(text(t)).alias("text")))
    learned = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.select(
        "conv_id", "window", parsed.alias("turns"), F.array_join(learned, "").alias("loss_text"), F.length("formatted").cast("long").alias("size")
    )


def digests(windows: DataFrame) -> DataFrame:
    """One row of counts and SHA-256 digests for each conversation, read back from its windows. The digest of a
    conversation needs its text in one row, so one conversation is bounded by what a row can hold."""
    back = read_back(windows)
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = F.struct("window", F.size("turns").alias("n"), written.alias("turns"), F.col("loss_text").alias("loss"), F.col("size").alias("size"))
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list(parts)).alias("w"))
    loss = F.array_join("w.loss", "")
    total = lambda name: F.aggregate(f"w.{name}", F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        total("size").alias("formatted_chars"),
    )
