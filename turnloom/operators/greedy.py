"""Greedy choices in order, a row a step."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def greedy(rows: DataFrame, scope: list[str], order: list[Column], size: str, budget: Column, taken: str = "kept") -> DataFrame:
    """Adds `taken` and `used`: in order, each row of a scope that still fits its budget; one that doesn't is skipped and the next is tried.

    What fits depends on all choices before, so rows are dealt by scope and sorted, and a task goes through them once with one number in
    hand. used is that number after the row: what has been taken.
    """
    cols = rows.withColumn("_size", F.col(size).cast("long")).withColumn("_budget", budget.cast("long"))
    schema = StructType([*rows.schema.fields, StructField(taken, BooleanType()), StructField("used", LongType())])
    arrow, names = to_arrow_schema(schema), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        for b in batches:
            flags, sums = [], []
            for *key, n, most in zip(*(b.column(c).to_pylist() for c in (*scope, "_size", "_budget")), strict=True):
                if key != now:
                    now, used = key, 0
                fits = used + n <= most
                used += n * fits
                flags.append(fits)
                sums.append(used)
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(arrow.field(c).type) for c in names), pa.array(flags, pa.bool_()), pa.array(sums, pa.int64())], schema=arrow)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cols.repartition(parts, *scope).sortWithinPartitions(*scope, *order).mapInArrow(run, schema)
