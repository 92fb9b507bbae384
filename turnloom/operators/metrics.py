"""Aggregates over turns, sessions and corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import written


def half_up(c: Column) -> Column:
    """Rounded to a whole number, halves up."""
    return F.floor(c + 0.5).cast("long")


def series(value: str, prefix: str) -> list[Column]:
    """Least, mean (halves up), largest and sum of a column."""
    return [F.min(value).alias(f"{prefix}_min"), half_up(F.avg(value)).alias(f"{prefix}_avg"), F.max(value).alias(f"{prefix}_max"), F.sum(value).cast("long").alias(f"{prefix}_total")]


def trace_stats(turns: DataFrame, session: str | list[str], before: str, after: str, compactions: str | None = None) -> DataFrame:
    """Of each session: rounds, compactions (if counted up to each round), both series, and what was saved on average and at the peak."""
    keys = [session] if isinstance(session, str) else session
    out = turns.groupBy(*keys).agg(F.count("*").alias("rounds"), *([F.max(compactions).alias("compactions")] if compactions else []), *series(before, "baseline"), *series(after, "rewritten"))
    return out.withColumn("savings_avg", F.col("baseline_avg") - F.col("rewritten_avg")).withColumn("savings_max", F.col("baseline_max") - F.col("rewritten_max"))


#: Distinct values of a scope that one task takes, and buckets into which a refinement cuts a scope's values.
DISTINCT, BUCKETS = 65_536, 4096


def percentiles(values: DataFrame, scope: list[str], value: str, n: str, q: float = 0.5, most: int = DISTINCT) -> DataFrame:
    """(scope, percentile): exact, with interpolation, of values that occur n times each; nulls don't count, a scope of nulls has none.

    A scope of up to `most` distinct values is settled in one aggregate. Beyond, the two values around the rank are found by refinement: each
    pass counts a scope's values in BUCKETS equal parts of the bracket that holds the rank, and the part that holds it, from its least to its
    greatest value, is the next bracket. A bracket's ends always fall into different parts, so it ends at one value. No task has more
    than `most` distinct values or BUCKETS parts of a scope, however many there are.
    """
    v = written(values.where(F.col(value).isNotNull()).groupBy(*scope, F.col(value).cast("double").alias("_v")).agg(F.sum(n).alias("_n")), "percentile-values")
    sizes = v.groupBy(*scope).agg(F.count("*").alias("_d"), F.sum("_n").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if (sizes.agg(F.max("_d")).first()[0] or 0) <= most:
        return v.groupBy(*scope).agg(F.percentile("_v", q, F.col("_n")).alias("percentile"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in scope], F.lit(True))
    at = (F.col("_all") - 1) * F.lit(float(q))
    ends = F.array(F.struct(F.lit(0).alias("_e"), F.floor(at).alias("_rank")), F.struct(F.lit(1).alias("_e"), F.ceil(at).alias("_rank")))
    open_ = written(sizes.select(*scope, (at - F.floor(at)).alias("_part"), "_lo", "_hi", F.explode(ends).alias("x")).select(*scope, "_part", "_lo", "_hi", "x._e", "x._rank"), "percentile-brackets")
    done = []
    while True:
        done.append(open_.where("_lo = _hi").select(*scope, "_part", "_e", F.col("_lo").alias("_found")))
        open_ = open_.where("_lo < _hi")
        if open_.isEmpty():
            break
        o = open_.alias("o")
        inside = v.join(o, same(v, open_) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).select(*[v[c] for c in scope], "_v", "_n", "_part", "_lo", "_hi", "_e", "_rank")
        share = F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
        bucket = F.when(F.col("_v") == F.col("_hi"), BUCKETS).otherwise(F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)))
        parts = inside.withColumn("_b", bucket).groupBy(*scope, "_part", "_e", "_rank", "_b").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*scope, "_e").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        held = parts.withColumn("_upto", upto).where("_rank < _upto and _rank >= _upto - _n")
        open_ = written(held.select(*scope, "_part", "_lo", "_hi", "_e", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank")), "percentile-brackets")
    found = reduce(DataFrame.unionByName, done).groupBy(*scope, "_part").agg(F.max(F.when(F.col("_e") == 0, F.col("_found"))).alias("a"), F.max(F.when(F.col("_e") == 1, F.col("_found"))).alias("b"))
    # The two ends are weighed as the aggregate weighs them.
    return found.select(*scope, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("_part")) * F.col("a") + F.col("_part") * F.col("b")).alias("percentile"))


def corpus_reduction(stats: DataFrame) -> DataFrame:
    """One row over all sessions, each of the same weight; reductions leave out sessions whose baseline is 0."""
    share = lambda a, b: F.when(F.col(a) > 0, 100.0 * (F.col(a) - F.col(b)) / F.col(a))
    s = written(stats.withColumn("_a", share("baseline_avg", "rewritten_avg")).withColumn("_p", share("baseline_max", "rewritten_max")), "corpus-stats")
    means = [half_up(F.avg(f"{k}_{m}")).alias(f"{k}_{m}") for k in ("baseline", "rewritten") for m in ("min", "avg", "max")]
    rate = lambda c: (F.floor(1000.0 * F.avg((F.col(c) > 0).cast("double")) + 0.5) / 10).alias(f"{c}_positive")
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10
    total = lambda m: tenth(F.try_divide(100.0 * (F.avg(f"baseline_{m}") - F.avg(f"rewritten_{m}")), F.avg(f"baseline_{m}")))
    each = s.select(F.explode(F.array(F.struct(F.lit("a").alias("k"), F.col("_a").alias("v")), F.struct(F.lit("p").alias("k"), F.col("_p").alias("v")))).alias("x")).select("x.k", "x.v", F.lit(1).alias("n"))
    middle = {r["k"]: r["percentile"] for r in percentiles(each, ["k"], "v", "n").collect()}  # two rows at most
    return s.agg(
        F.count("*").alias("traces"), F.sum("rounds").cast("long").alias("rounds"), *means, half_up(F.avg("savings_avg")).alias("savings_avg"), half_up(F.avg("savings_max")).alias("savings_max"),
        rate("savings_avg"), rate("savings_max"), total("avg").alias("avg_reduction"), total("max").alias("peak_reduction"),
        tenth(F.avg("_a")).alias("mean_reduction"), tenth(F.avg("_p")).alias("mean_peak_reduction"), *[tenth(F.lit(middle.get(k)).cast("double")).alias(c) for k, c in (("a", "median_reduction"), ("p", "median_peak_reduction"))],
    )


def pooled_summary(turns: DataFrame, session: str, value: str) -> DataFrame:
    """Count, least, mean, median, largest and sum, of each session and (session null) of all turns.

    Both come from one table of how often each session has each value.
    """
    v = written(turns.groupBy(session, F.col(value).alias("_v")).agg(F.count("*").alias("_n")), "pooled-values")
    own = v.select(session, F.lit(False).alias("_all"), "_v", "_n")
    every = v.groupBy("_v").agg(F.sum("_n").alias("_n")).select(F.lit(None).cast(turns.schema[session].dataType).alias(session), F.lit(True).alias("_all"), "_v", "_n")
    both = own.unionByName(every)
    cols = [F.sum("_n").alias("turns"), F.min("_v").alias("least"), half_up(F.sum(F.col("_v") * F.col("_n")) / F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))).alias("mean"), F.max("_v").alias("most"), F.sum(F.col("_v") * F.col("_n")).cast("long").alias("total")]
    flat = both.groupBy(session, "_all").agg(*cols)
    middle = percentiles(both, [session, "_all"], "_v", "_n").select(F.col(session).alias("_s"), F.col("_all").alias("_a"), F.col("percentile").alias("median"))
    return flat.join(middle, F.col(session).eqNullSafe(F.col("_s")) & (F.col("_all") == F.col("_a")), "left").select(session, "turns", "least", "mean", "median", "most", "total")


def usage_rollup(usage: DataFrame, session: str, kind: str, value: str) -> DataFrame:
    """Calls and sums by session and kind, with each session's total (kind null)."""
    return usage.rollup(session, kind).agg(F.count("*").alias("calls"), F.sum(value).alias("total")).where(F.col(session).isNotNull())


def running_totals(usage: DataFrame, session: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return usage.withColumn("calls", F.count("*").over(w)).withColumn("running", F.sum(value).over(w))


def recorded_usage(records: DataFrame, session: str) -> DataFrame:
    """Of each round's usage records: largest input, all output, largest cached."""
    return records.groupBy(session, "round").agg(F.max("input").alias("input"), F.sum("output").alias("output"), F.max("cached").alias("cached"))


def top_two_ways(stats: DataFrame, first: str, second: str, name: str, n: int = 10) -> DataFrame:
    """The n largest by one measure, then the n largest of the rest by another: (name, pick, place). TopK, no full sort."""
    a = stats.orderBy(F.desc(first), name).limit(n)
    b = stats.join(a.select(name), name, "left_anti").orderBy(F.desc(second), name).limit(n)
    row = lambda d, how, by: d.select(name, F.lit(how).alias("pick"), F.row_number().over(Window.orderBy(F.desc(by), name)).cast("long").alias("place"))
    return row(a, first, first).unionByName(row(b, second, second))


def running_sums(rows: DataFrame, session: str, order: str, values: list[str]) -> DataFrame:
    """Each value replaced by its sum up to the row."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.sum(c).over(w) for c in values})


def suite_totals(runs: DataFrame, suite: str, passed: str, value: str) -> DataFrame:
    """One row over all runs: suites, runs, how many passed and failed, and a value's sum over all and over those that failed."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    failed = F.when(~F.col(passed), F.col(value)).otherwise(0)
    return runs.agg(F.count_distinct(suite).alias("suites"), F.count("*").alias("runs"), n(F.col(passed)).alias("passed"), n(~F.col(passed)).alias("failed"), F.sum(value).cast("long").alias("chars"), F.sum(failed).cast("long").alias("failed_chars"))


def first_of_each(rows: DataFrame, part: str, order: str, n: int) -> DataFrame:
    """(part, tail): the first n of each part in order. Ranks are cut in each map task, so no list holds them all."""
    r = F.row_number().over(Window.partitionBy(part).orderBy(order))
    return rows.select(part, order).withColumn("_r", r).where(F.col("_r") <= n).groupBy(part).agg(F.array_sort(F.collect_list(order)).alias("tail"))
