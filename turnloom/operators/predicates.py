"""Filters, validations and choices on items, routes, responses and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens left for an answer; windows of the small and the large model.
RESERVE, SMALL_WINDOW, LARGE_WINDOW = 4096, 400_000, 1_047_576
#: Statuses worth another try, besides 500 and above.
RETRYABLE = (408, 409, 425, 429)


def synthetic_memory(role: Column, text: Column, mark: str = "[memory]") -> Column:
    """A developer message that carries a rendered memory block."""
    return F.coalesce((role == "developer") & F.contains(text, F.lit(mark)), F.lit(False))


def chunkable(kind: Column, tool: Column, own_tools: tuple[str, ...] = ("recall",)) -> Column:
    """Sources that are split: neither a user's nor a call, nor output of the engine's own tools."""
    return ~kind.isin("user", "tool_call") & ~F.coalesce(tool.isin(*own_tools), F.lit(False))


def retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRYABLE) | (status >= 500), F.lit(False))


def fits(tokens: Column, window: int = LARGE_WINDOW) -> Column:
    return tokens <= window - RESERVE


def model_for(purpose: Column, tokens: Column) -> Column:
    """The large model for chunking and for what the small one can't hold; null for what neither can."""
    large = F.when(fits(tokens), "large")
    return F.when(purpose == "source_chunk_batch", large).when(fits(tokens, SMALL_WINDOW), "small").otherwise(large)


def coerced_route(kind: Column, relative: Column) -> Column:
    """(kind, index): unknown routes stay with the task; a revival needs an index below 0 (none given: the newest)."""
    at = F.coalesce(relative.try_cast("double").try_cast("int"), F.lit(-1))
    out = F.when(kind.isin("new_task", "more_archived_tasks"), kind).when((kind == "revive_task") & (at < 0), kind).otherwise(F.lit("same_task"))
    return F.struct(out.alias("kind"), F.when(out == "revive_task", at).alias("index"))


def expected(said: Column, want: Column) -> Column:
    """Whether an answer is the one expected: letter for letter, or but for case, a label before it, quotes and a stop."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(F.trim(c)), r"^(answer|result|value)\s*[:=]\s*|[`\"'.]+", ""))
    return F.coalesce((said == want) | (bare(said) == bare(want)), F.lit(False))


def is_event_stream(content_type: Column, body: Column) -> Column:
    told = F.coalesce(F.contains(F.lower(content_type), F.lit("text/event-stream")), F.lit(False))
    return told | F.startswith(body, F.lit("event:")) | F.startswith(body, F.lit("data:")) | F.contains(body, F.lit("\ndata:"))


def with_missing(items: DataFrame, results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every item with its result; `status` says where the response left it out."""
    r = results.select(*keys, F.col(value).alias("_v"), F.lit(True).alias("_there"))
    out = items.join(r, keys, "left")
    return out.select(*items.columns, F.col("_v").alias(value), F.when(F.col("_there"), "answered").otherwise("missing_from_response").alias("status"))


def unfinished(planned: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(finished.select(*keys), keys, "left_anti")


def zipped(left: DataFrame, right: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """Rows of `left` with the value of the row of `right` at the same place within the part."""
    n = F.row_number().over(Window.partitionBy(part).orderBy(order))
    r = right.select(part, n.alias("_n"), F.col(value).alias(value))
    return left.withColumn("_n", n).join(r, [part, "_n"], "left").drop("_n")


def named_outputs(items: DataFrame, session: str, call: str, order: str, name: str, is_output: str) -> DataFrame:
    """Outputs with their own name, else that of the last call with the same id."""
    calls = items.where(~F.col(is_output)).groupBy(session, call).agg(F.max_by(name, order).alias("_called"))
    return items.where(is_output).join(calls, [session, call], "left").withColumn("tool", F.coalesce(name, "_called")).drop("_called")
