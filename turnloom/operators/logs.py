"""Metrics of run logs: batches, throughput, usage estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_progress(lines: DataFrame, log: str, order: str, line: str, expected: Column, completed: Column) -> DataFrame:
    """Of each log its latest batch: when it began, seconds so far, how many are done, an hour's throughput, hours left.

    A line starts with its time. What stands before the last `batch_start` doesn't count. The count is that of the last
    completion or heartbeat line, else of `done [` lines.
    """
    stamp = F.try_to_timestamp(F.get(F.split(F.col(line), " "), F.lit(0)))
    rows = lines.withColumn("_ts", stamp).withColumn("_start", F.contains(F.col(line), F.lit(" batch_start ")) & stamp.isNotNull())
    last = rows.groupBy(log).agg(F.max(F.when(F.col("_start"), F.col(order))).alias("_from"))
    now = rows.join(last, log).where((F.col(order) >= F.col("_from")) & ~(F.col("_start") & (F.col(order) > F.col("_from"))))
    told = F.regexp_extract(F.col(line), r"completed_this_run=(\d+)", 1).try_cast("long")
    tells = (F.contains(F.col(line), F.lit(" batch_complete ")) | F.contains(F.col(line), F.lit(" heartbeat "))) & told.isNotNull()
    out = now.groupBy(log).agg(
        F.min_by("_ts", order).alias("started"), F.max("_ts").alias("ended"), F.sum(F.contains(F.col(line), F.lit(" done [")).cast("long")).alias("_done"), F.max_by(F.when(tells, told), F.when(tells, F.col(order))).alias("_told")
    )
    out = out.withColumn("seconds", F.greatest(F.lit(0), F.unix_timestamp("ended") - F.unix_timestamp("started"))).withColumn("finished", F.coalesce("_told", "_done"))
    rate = F.when((F.col("seconds") > 0) & (F.col("finished") > 0), F.bround(3600.0 * F.col("finished") / F.col("seconds"), 2))
    out = out.withColumn("per_hour", rate)
    return out.withColumn("hours_left", F.bround(F.greatest(F.lit(0), expected - completed) / F.nullif("per_hour", F.lit(0.0)), 2)).drop("_done", "_told")


def usage_with_estimates(calls: DataFrame, actual: str, parts: list[Column]) -> DataFrame:
    """Adds `estimated` tokens of a call's texts together, and how far the actual count is above it."""
    chars = parts[0]
    for p in parts[1:]:
        chars = chars + p
    return calls.withColumn("estimated", F.ceil(chars / 4).cast("long")).withColumn("delta", F.col(actual) - F.col("estimated"))


def recalled(log: DataFrame, session: str, sources: str, size: str) -> DataFrame:
    """Bytes that a session recalled and the different sources among them."""
    e = log.select(session, size, F.explode_outer(sources).alias("_s"))
    return log.groupBy(session).agg(F.sum(size).alias("bytes"), F.count("*").alias("calls")).join(e.groupBy(session).agg(F.count_distinct("_s").alias("sources")), session)


def latest_batch(rows: DataFrame, part: str, order: str, start: Column) -> DataFrame:
    """Rows from each part's last start on."""
    last = F.max(F.when(start, F.col(order))).over(Window.partitionBy(part))
    return rows.withColumn("_l", last).where(F.col(order) >= F.col("_l")).drop("_l")
