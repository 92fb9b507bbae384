"""Tables that change by commits: immutable Parquet folders, and one manifest a version, created once or not at all.

A manifest names all folders of its version, the schema, and the last batch of each stream that is in it. A reader takes the newest
manifest, so it sees a version whole or not at all; of two writers who build on one version the second finds its manifest taken.
"""

from __future__ import annotations

import json
import os
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders that a version's rows are dealt into by the hash of a table's key, unless its first commit says otherwise.
BUCKETS = 16
BUCKET, PART = "_bucket", "_part"


class Conflict(RuntimeError):
    """Another writer has committed the version; nothing of this one is visible."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create_once(spark: SparkSession, path: str, text: str, link: bool = True) -> bool:
    """Write a small file whole unless it exists: it is written beside and then takes its name, which fails if the name is taken.

    A local folder has hard links for that; other file systems rename without overwriting.
    """
    jvm = spark._jvm
    fs, target = _fs(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if link and fs.getUri().getScheme() == "file":
            with suppress(FileExistsError):
                os.link(beside.toUri().getPath(), target.toUri().getPath())
                return True
            return False
        options = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(target), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        fs.delete(beside, False)


def versions(spark: SparkSession, table: str) -> list[int]:
    fs, log = _fs(spark, f"{table}/_log")
    if not fs.exists(log):
        return []
    return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(log)) if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, table: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default the newest; None for a table without any."""
    if version is None:
        there = versions(spark, table)
        if not there:
            return None
        version = there[-1]
    fs, path = _fs(spark, f"{table}/_log/{version:020d}.json")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def has(head: dict | None, batch: tuple[str, int] | None) -> bool:
    """Whether a stream's batch (query, batch id) is in a version."""
    return bool(head and batch and head["batches"].get(batch[0], -1) >= batch[1])


def before(spark: SparkSession, table: str, batch: tuple[str, int]) -> dict | None:
    """The newest version without a stream's batch."""
    for v in reversed(versions(spark, table)):
        m = manifest(spark, table, v)
        if not has(m, batch):
            return m
    return None


def commit(spark: SparkSession, table: str, rows: DataFrame, base: dict | None, key: str | None = None, replace: bool = False, batch: tuple[str, int] | None = None, buckets: int = BUCKETS) -> dict:
    """Add rows to the version `base` (None: a table without any), or put them in its place, as the next version.

    A batch that is in the base already changes nothing. If the next version exists, this writer's folder goes and a Conflict is raised. With a key,
    rows are dealt into folders by its hash, so that a read of some keys skips the others; large folders are split by adaptive execution.
    """
    if has(base, batch):
        return base
    buckets, key = (base["buckets"], base["key"]) if base else (buckets, key)
    part = f"data/{PART}={uuid.uuid4().hex}"
    if key:
        rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{table}/{part}")
    else:
        rows.write.parquet(f"{table}/{part}")
    new = {
        "version": base["version"] + 1 if base else 0, "parts": [*(base["parts"] if base and not replace else []), part], "schema": rows.schema.json(), "key": key, "buckets": buckets,
        "batches": {**(base["batches"] if base else {}), **({batch[0]: batch[1]} if batch else {})},
    }
    if not create_once(spark, f"{table}/_log/{new['version']:020d}.json", json.dumps(new)):
        fs, path = _fs(spark, f"{table}/{part}")
        fs.delete(path, True)
        raise Conflict(f"version {new['version']} of {table} was committed by another writer")
    return new


def read(spark: SparkSession, table: str, schema: StructType | str | None = None, head: dict | None = None, keys: list | None = None) -> DataFrame:
    """The rows of a version, by default the newest; of some keys only, if given. A table without a version has none, and needs a schema."""
    head = head or manifest(spark, table)
    if head is None:
        if schema is None:
            raise ValueError(f"{table} has no version, and no schema was given")
        return spark.createDataFrame([], schema)
    own = StructType.fromJson(json.loads(head["schema"]))
    own = own.add(BUCKET, "integer") if head["key"] else own
    out = spark.read.schema(own.add(PART, "string")).option("basePath", f"{table}/data").parquet(*[f"{table}/{p}" for p in head["parts"]])
    if keys is not None and head["key"]:
        dealt = spark.range(len(keys)).select(F.pmod(F.xxhash64(F.get(F.array(*[F.lit(str(k)) for k in keys]), F.col("id").cast("int"))), F.lit(head["buckets"])).cast("int").alias("b")) if keys else None
        out = out.where(F.col(BUCKET).isin([r["b"] for r in dealt.collect()] if keys else [])).where(F.col(head["key"]).isin(keys))
    return out.drop(BUCKET, PART)


def retried(spark: SparkSession, table: str, change, tries: int = 8) -> dict:
    """Commit change(base) until no other writer comes between; change gives (rows, replace) for a base version."""
    for left in reversed(range(tries)):
        base = manifest(spark, table)
        try:
            return change(base)
        except Conflict:
            if not left:
                raise
    raise AssertionError
