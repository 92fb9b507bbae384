"""Sharding: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, running


def lpt(classes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, int]]:
    """LPT over (size, how many jobs of it): rows (size, shard, first, end), ranks of that size given to the shard.

    Largest first, each job to the least-loaded shard (ties: smaller shard) through a heap. Of a size with many
    jobs, those that a greedy run would surely place are placed at once: jobs of size s start at
    load + m * s, so the c earliest starts are counted by bisection and only the last few go through the heap.
    """
    load, out = [0] * n_shards, []
    for size, count in sorted(classes, reverse=True):
        given = [0] * n_shards
        if count > 4 * n_shards and size > 0:
            lo, hi = min(load) - 1, max(load) + size * (count // n_shards + 1)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if sum((mid - x) // size + 1 for x in load if x <= mid) <= count:
                    lo = mid
                else:
                    hi = mid - 1
            given = [(lo - x) // size + 1 if x <= lo else 0 for x in load]
        heap = [(x + g * size, j) for j, (x, g) in enumerate(zip(load, given, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(given)):
            x, j = heap[0]
            heapq.heapreplace(heap, (x + size, j))
            given[j] += 1
        first = 0
        for j, g in enumerate(given):
            if g:
                out.append((size, j, first, first + g))
                load[j] += g * size
                first += g
    return out


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Deal documents (doc_id, text) into shards of near-equal bytes; equal texts stay together.

    Size: UTF-8 bytes plus 8. Null texts form one group of their own (8 bytes a row, CRC 0), empty texts another.
    Repeated rows stay apart as rows and together as a group. An empty table gives no rows. Other columns are ignored.

    Only (size, number of groups) goes to the driver: distinct sizes d have d(d+1)/2 <= all bytes, so at most
    sqrt(2 * bytes) pairs (14 million at 100 TB). Ranks within a size and slots within a shard are exact
    two-level running counts, so that neither a common size nor a shard meets in one task.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("_group"),
    )
    base = materialize(base, "shard-rows")
    groups = materialize(base.groupBy("_group").agg(F.sum("size").alias("_size"), F.count("*").alias("_rows")), "shard-groups")
    classes = groups.groupBy("_size").agg(F.count("*").alias("n"), F.sum("_rows").alias("r")).collect()
    n_groups, n_rows = sum(c["n"] for c in classes), sum(c["r"] for c in classes)
    plan = spark.createDataFrame(lpt([(c["_size"], c["n"]) for c in classes], n_shards), "_psize long, shard int, _first long, _end long")
    ranked = running(groups.select("_group", "_size"), ["_size"], F.pmod(F.xxhash64("_group"), F.lit(pieces(n_groups))), ["_group"], F.lit(1), "_rank")
    dealt = ranked.join(plan, (F.col("_size") == F.col("_psize")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    dealt = materialize(dealt.select("_group", "shard"), "shard-dealt")
    rows = materialize(base.join(dealt, "_group"), "shard-joined")
    slots = running(rows, ["shard"], F.pmod(F.xxhash64("doc_id"), F.lit(pieces(n_rows // n_shards))), ["doc_id", "_group"], F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
