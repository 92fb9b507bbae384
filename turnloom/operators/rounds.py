"""Rounds of a session: segmentation, running context size, leading instructions, the current round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_length

#: Lengths of an empty request and of a message's wrapper in canonical JSON.
REQUEST_CHARS, MESSAGE_CHARS = 44, 70
#: Starts of user messages that a harness writes itself.
SYNTHETIC_PREFIXES = ("<environment_context>", "<turn_aborted>")
SYNTHETIC_TRIMMED = "<user_interrupt>"


def is_user_prompt(role: Column, text: Column) -> Column:
    """A user's own words: neither blank nor written by the harness."""
    own = (role == "user") & (F.length(F.trim(text)) > 0)
    for p in SYNTHETIC_PREFIXES:
        own = own & ~F.startswith(text, F.lit(p))
    return F.coalesce(own & ~F.startswith(F.trim(text), F.lit(SYNTHETIC_TRIMMED)), F.lit(False))


def segment_rounds(events: DataFrame, session: str, order: str, starts: Column) -> DataFrame:
    """Adds `round`: 0 before the first start, then one more at each."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("round", F.sum(starts.cast("long")).over(w))


def baseline_tokens(items: DataFrame, session: str, order: str, role: str, text: str, starts: Column) -> DataFrame:
    """Of each round's first item, the tokens of a request that holds everything so far: (session, round, items, tokens)."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = json_length(text) + F.length(role) + MESSAGE_CHARS
    run = segment_rounds(items, session, order, starts).withColumn("items", F.count("*").over(w)).withColumn("_chars", F.sum(size).over(w))
    tokens = F.ceil((REQUEST_CHARS + F.col("_chars") + F.col("items") - 1) / 4).cast("long")
    return run.where(starts).select(session, "round", order, "items", tokens.alias("tokens"))


def compaction_epochs(events: DataFrame, session: str, order: str, compacted: Column) -> DataFrame:
    """Adds `epoch`: history restarts at each compaction, from the prefix (round 0) and what replaces the rest."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("epoch", F.sum(compacted.cast("long")).over(w))


def compacted_tokens(items: DataFrame, session: str, order: str, role: str, text: str, starts: Column, compacted: Column) -> DataFrame:
    """As baseline_tokens, where a compaction cuts the history back to the prefix (round 0) and its own text, as one message,
    from the next item on. Adds `compactions`, how many came before."""
    run = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    size = json_length(text) + F.length(role) + MESSAGE_CHARS
    e = segment_rounds(items, session, order, starts).withColumns({"_size": size, "_c": compacted & (F.col("round") > 0)})
    e = e.withColumns({"compactions": F.coalesce(F.sum(F.col("_c").cast("long")).over(before), F.lit(0)), "_put": F.last(F.when(F.col("_c"), F.col("_size")), ignorenulls=True).over(before)})
    prefix = F.col("round") == 0
    e = e.withColumns({"_lead": F.sum(F.when(prefix, F.col("_size"))).over(run), "_leads": F.sum(prefix.cast("long")).over(run)})
    within = Window.partitionBy(session, "compactions").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumns({"_own": F.sum(F.when(~prefix, F.col("_size"))).over(within), "_owns": F.sum((~prefix).cast("long")).over(within)})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    items_ = zero("_leads") + zero("_owns") + F.when(F.col("compactions") > 0, 1).otherwise(0)
    tokens = F.ceil((REQUEST_CHARS + zero("_lead") + zero("_own") + F.when(F.col("compactions") > 0, zero("_put")).otherwise(0) + items_ - 1) / 4)
    return e.where(starts).select(session, "round", "compactions", items_.cast("long").alias("items"), tokens.cast("long").alias("tokens"))


def leading_instructions(items: DataFrame, session: str, order: str, instruction: Column) -> DataFrame:
    """The unbroken run of instructions at a session's start."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("_all", F.bool_and(instruction).over(w)).where("_all").drop("_all")


def current_round_tail(items: DataFrame, session: str, order: str, user: Column) -> DataFrame:
    """From a session's last user message on; everything if it has none."""
    last = F.max(F.when(user, F.col(order))).over(Window.partitionBy(session))
    return items.withColumn("_last", last).where(F.col("_last").isNull() | (F.col(order) >= F.col("_last"))).drop("_last")


def derived_prompt(items: DataFrame, session: str, order: str, instruction: Column, user: Column) -> DataFrame:
    """Adds `kept`: whether an item is a leading instruction or of the current round; the rest is what memory stands for."""
    part = Window.partitionBy(session)
    run = part.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(user, F.col(order))).over(part)
    lead = F.bool_and(instruction).over(run)
    return items.withColumn("_l", last).withColumn("kept", lead | F.col("_l").isNull() | (F.col(order) >= F.col("_l"))).drop("_l")
