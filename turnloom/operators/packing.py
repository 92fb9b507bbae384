"""Pieces into batches under a token limit: greedy choices by one step a row, next-fit by prefix sums and pointer doubling."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.observed import shared_folder
from .fold import BATCH_TOKENS, PIECE_CHARS, REQUEST_CHARS, SINGLE_TOKENS
from .greedy import greedy


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: what is used again is made once, and outlives an executor."""
    path = f"{shared_folder(df.sparkSession)}/turnloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def next_fit(rows: DataFrame, scope: list[str], order: str, cost: str, room: str) -> DataFrame:
    """Adds `starts`: whether a row begins a batch, where batches are filled in order and the first row that doesn't fit begins the next.

    Every row's cost is positive and at most its scope's `room`. With running sums, the batch that would begin at a row ends before the first
    row whose sum exceeds what comes before it by more than the room: found by sorting both kinds of sums together. Of those
    pointers, the ones reached from a scope's first row are the starts: pointers are doubled until none leads anywhere, and
    then followed from the longest to the shortest, each from all rows reached so far. So it takes as many joins as the number of batches has
    bits, by (scope, row), whatever the length of a scope; only keys and sums are moved.
    """
    w = Window.partitionBy(*scope).orderBy(order)
    base = written(rows.select(*scope, order, F.col(cost).cast("long").alias("_c"), F.col(room).cast("long").alias("_room")).withColumn("_i", F.row_number().over(w).cast("long")).withColumn("_sum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))), "packing-sums")
    ends = base.select(*scope, F.col("_sum").alias("_v"), F.lit(0).alias("_asks"), "_i")
    asks = base.select(*scope, (F.col("_sum") - F.col("_c") + F.col("_room")).alias("_v"), F.lit(1).alias("_asks"), "_i")
    over = Window.partitionBy(*scope).orderBy(F.desc("_v"), F.desc("_asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ends.unionByName(asks).withColumn("_to", F.min(F.when(F.col("_asks") == 0, F.col("_i"))).over(over)).where("_asks = 1 and _to is not null")
    jumps = [written(found.select(*scope, "_i", "_to"), "packing-jumps")]
    while not jumps[-1].isEmpty():
        j = jumps[-1]
        jumps.append(written(j.join(j.select(*scope, F.col("_i").alias("_to"), F.col("_to").alias("_far")), [*scope, "_to"]).select(*scope, "_i", F.col("_far").alias("_to")), "packing-jumps"))
    reached = base.where("_i = 1").select(*scope, "_i")
    for j in reversed(jumps[:-1]):
        reached = written(reached.unionByName(reached.join(j, [*scope, "_i"]).select(*scope, F.col("_to").alias("_i"))), "packing-reached")
    starts = base.join(reached.withColumn("starts", F.lit(True)), [*scope, "_i"], "left").select(*scope, order, F.coalesce("starts", F.lit(False)).alias("starts"))
    return rows.join(starts, [*scope, order])


def prune_batches(pieces: DataFrame, session: str, order: str, limit: int = BATCH_TOKENS, single: int = SINGLE_TOKENS) -> DataFrame:
    """(session, order, batch): the batches in which a session's pieces (kind, size, rendered, latest) are evaluated, from 0.

    The rules are those of fold.batches: a manifest of all pieces, the latest user pieces and as many user pieces as fit (newest
    first) go with every batch; if not all fit, only user pieces are evaluated; a piece too large to share goes alone, one too large for
    any is not evaluated. Here they run over tables, for sessions of any length.
    """
    p = pieces.select(session, order, "kind", "rendered", (F.col("size") + PIECE_CHARS).cast("long").alias("cost"), "latest")
    fixed = p.groupBy(session).agg((F.lit(REQUEST_CHARS) + PIECE_CHARS * F.count("*") + F.coalesce(F.sum(F.when(F.col("latest"), F.col("cost"))), F.lit(0))).cast("long").alias("fixed"))
    p = p.join(fixed, session)
    users = greedy(p.where("kind = 'user' and rendered"), [session], [F.desc(order)], "cost", 4 * F.lit(limit) - F.col("fixed"))
    shared = users.groupBy(session).agg(F.max("used").alias("_used"), F.bool_and("kept").alias("_all"))
    p = p.join(shared, session, "left").withColumn("shared", F.col("fixed") + F.coalesce("_used", F.lit(0))).withColumn("_all", F.coalesce("_all", F.lit(True)))
    alone = F.ceil((F.col("shared") + F.col("cost")) / 4)
    asked = p.where("rendered").where(F.col("_all") | (F.col("kind") == "user")).where(alone <= single).withColumn("big", alone > limit)
    upto = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = written(asked.withColumn("stretch", F.sum(F.col("big").cast("int")).over(upto)).withColumn("room", 4 * F.lit(limit) - F.col("shared")).select(session, order, "stretch", "big", "cost", "room"), "packing-asked")
    fitted = next_fit(asked.where("not big"), [session, "stretch"], order, "cost", "room").select(session, order, "starts")
    every = reduce(DataFrame.unionByName, [fitted, asked.where("big").select(session, order, F.lit(True).alias("starts"))])
    return every.withColumn("batch", F.sum(F.col("starts").cast("long")).over(upto) - 1).select(session, order, "batch")


def batch_requests(pieces: DataFrame, batches: DataFrame, session: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The manifests (session, pieces, bytes, manifest) and the requests (session, batch, evaluated, bytes) of batched pieces.

    A session's manifest names all its pieces, an object with id, kind and bytes each, and goes with every request; so it is made once a
    session and not once a batch. A request has the ids that it asks about, in order.
    """
    by_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), c.alias("x")))), lambda y: y["x"])
    entry = F.to_json(F.struct(F.col(order).alias("id"), "kind", F.col("size").alias("bytes")))
    manifests = pieces.groupBy(session).agg(F.count("*").alias("pieces"), F.sum("size").alias("bytes"), F.concat(F.lit("["), F.array_join(by_order(entry), ","), F.lit("]")).alias("manifest"))
    asked = batches.join(pieces.select(session, order, "size"), [session, order])
    return manifests, asked.groupBy(session, "batch").agg(by_order(F.col(order)).alias("evaluated"), F.sum("size").alias("bytes"))
