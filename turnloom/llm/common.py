"""What several operators share: tables, written intermediates, exact distributed ranks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of every contract here: space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Folder of each local application that names none.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset, a local session (as in tests) gets a
    folder of its own and any other an error, as its executors would not see each other's files."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        # The setting is fixed once a session runs, so the folder is kept here.
        d = _OWN.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="turnloom-")
        _OWN[spark.sparkContext.applicationId] = d
    return d.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/turnloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, part: list[str], sub: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of `value` over `order` within `part`, with no task holding a whole `part`.

    Rows are ordered by (sub, order). `sub` splits each part into sub-groups that one task can hold; their
    totals, one row a sub-group, give each sub-group's offset. Nulls in `part` or `order` form values of their own.
    """
    df = df.withColumn("_sub", sub).withColumn("_v", value.cast("long"))
    keys = [*part, "_sub"]
    totals = df.groupBy(*keys).agg(F.sum("_v").alias("_t"))
    w = Window.partitionBy(*part).orderBy("_sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], (F.sum("_t").over(w) - F.col("_t")).alias("_off"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumn("_in", F.sum("_v").over(inner) - F.col("_v"))
    return ranked.join(offsets, cond).withColumn(out, F.col("_off") + F.col("_in")).drop("_sub", "_v", "_t", "_in", "_off", *[f"_o{i}" for i in range(len(keys))])


def pieces(n: int, per: int = 50_000, least: int = 64) -> int:
    """Into how many sub-groups to split so that each has about `per` of n rows at most."""
    return max(least, -(-n // per))
