"""Turns of observed event streams: from a start to the next completion, per thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def observed_turns(events: DataFrame, thread: str, order: list[str], start: Column, end: Column) -> DataFrame:
    """Events of completed turns with `turn`, counted from 1 in each thread.

    A start resets what was open; events without an open turn, and turns that don't complete, are left out.
    """
    w = Window.partitionBy(thread).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = events.withColumn("_start", start).withColumn("_end", end).withColumn("_n", F.sum(F.col("_start").cast("long")).over(run))
    inside = Window.partitionBy(thread, "_n").orderBy(*order)
    e = e.where("_n > 0").withColumn("_ends", F.sum(F.col("_end").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Up to and with the first end after the start.
    e = e.where((F.col("_ends") == 0) | ((F.col("_ends") == 1) & F.col("_end")))
    e = e.withColumn("_done", F.max("_ends").over(Window.partitionBy(thread, "_n"))).where("_done = 1")
    e = e.withColumn("turn", F.dense_rank().over(Window.partitionBy(thread).orderBy("_n")).cast("long"))
    return e.drop("_start", "_end", "_n", "_ends", "_done")


def item_counts(items: DataFrame, thread: str, kind: str, tool: str) -> DataFrame:
    """Of each thread: events, calls and outputs of tools, and the sorted names of the tools in them."""
    of = lambda k: F.sum((F.col(kind) == k).cast("long"))
    named = F.when(F.col(kind).isin("function_call", "function_call_output"), F.col(tool))
    return items.groupBy(thread).agg(F.count("*").alias("events"), of("function_call").alias("calls"), of("function_call_output").alias("outputs"), F.array_sort(F.collect_set(named)).alias("tools"))


def turn_counts(events: DataFrame, scope: list[str], payload: str) -> DataFrame:
    """(scope, kind, name, n) of log envelopes (VARIANT): how many there are by envelope type, by type of event message, by type of
    response item, and by role of its messages. Counts of one kind are a row a name."""
    get = lambda p: F.try_variant_get(F.col(payload), p, "string")
    type_, inner = get("$.type"), get("$.payload.type")
    pairs = F.array(
        F.struct(F.lit("envelope").alias("kind"), type_.alias("name")), F.struct(F.lit("event").alias("kind"), F.when(type_ == "event_msg", inner).alias("name")),
        F.struct(F.lit("item").alias("kind"), F.when(type_ == "response_item", inner).alias("name")), F.struct(F.lit("role").alias("kind"), F.when((type_ == "response_item") & (inner == "message"), get("$.payload.role")).alias("name")),
    )
    return events.select(*scope, F.explode(pairs).alias("_x")).where("_x.name is not null").groupBy(*scope, F.col("_x.kind").alias("kind"), F.col("_x.name").alias("name")).agg(F.count("*").alias("n"))


def tool_results(counts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, results): outputs of tools among a turn's counted items."""
    out = (F.col("kind") == "item") & F.col("name").endswith("_output")
    return counts.groupBy(*scope).agg(F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).alias("results"))
