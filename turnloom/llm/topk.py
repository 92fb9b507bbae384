"""Exact top-k search by inner product: branch and bound over dimension blocks in a vertical layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAST, MOST = -(2**63), 2**63 - 1


def whole(x: np.ndarray, times: int) -> np.ndarray:
    """floor(times * x) as int64; what a long can't hold takes its nearest bound."""
    with np.errstate(over="ignore"):
        v = np.floor(np.asarray(x, np.float64) * times)
    out = np.clip(v, -(2.0**63), 2.0**62).astype(np.int64)
    big = v > 2.0**62
    if big.any():
        out[big] = [min(int(y), MOST) if np.isfinite(y) else MOST for y in v[big]]
    return out


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """Rows with an id and a vector that holds neither nulls nor non-finite components."""
    ok = vectors.where(f"vec_id is not null and {name} is not null")
    return ok.where(F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def masses(v: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms of what is left of each column's vector before each block, rounded up; v is one row a dimension."""
    sq = v.astype(np.float64) ** 2
    left = [np.sqrt(sq[e:].sum(axis=0)) for e in edges]
    return np.stack([*left, np.zeros(v.shape[1])]) * (1 + 1e-9)


class Asked:
    """Queries of one length: ids and one row of whole numbers each, in the order of dimensions of the index."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, width: int):
        self.ids, self.v, self.edges = ids, v, list(range(0, v.shape[1], width)) or [0]
        self.width, self.mass = width, masses(v.T, self.edges)


def reachable(lim: np.ndarray) -> np.ndarray:
    """Limits of scores that end at a long's bounds: beyond either all scores are one."""
    return np.where(lim <= -(2.0**63) * (1 - 1e-12), -np.inf, np.minimum(lim, 2.0**63 * (1 - 1e-12)))


def search(tile: list[np.ndarray], vid: np.ndarray, mass: np.ndarray, ask: Asked, s: slice, lim: np.ndarray, k: int, dense: float = 0.05) -> tuple[np.ndarray, np.ndarray, list]:
    """Candidates (query, row, score) of a tile that can be among the first k of the queries s.

    After each block, a pair's score so far plus the product of the masses left bounds its score. Pairs below the query's k-th
    best so far go; when few are left, only those go on.
    """
    q, qm = ask.v[s], ask.mass[:, s]
    exact = float(qm[0].max(initial=0)) * float(mass[0].max(initial=0)) < 2.0**52
    q = q.astype(np.float64) if exact else q.astype(object)
    cols = [c.astype(np.float64) if exact else c.astype(object) for c in tile]
    acc = np.zeros((len(q), len(vid)), np.float64 if exact else object)
    alive = ask.ids[s, None] != vid
    lim = lim if exact else reachable(lim)
    fresh = acc.shape[1] > k and not np.isfinite(lim).all()
    at, slack = 0, 0.0 if exact else 1e-9 * float(qm[0].max()) * float(mass[0].max())
    while at < len(cols):
        acc += q[:, at * ask.width : (at + 1) * ask.width] @ cols[at]
        at += 1
        bound = qm[at][:, None] * mass[at] + slack
        if fresh:
            # The first tile has no k-th best yet: it comes from lower bounds, which rise with every block.
            low = np.where(alive, (acc - bound).astype(np.float64), -np.inf)
            lim = np.maximum(lim, np.partition(low, len(vid) - k, axis=1)[:, len(vid) - k])
            lim = lim if exact else reachable(lim)
        alive &= acc + bound >= lim[:, None]
        if at < len(cols) and alive.mean() < dense:
            break
    a, b = np.nonzero(alive)
    score = acc[a, b]
    for j in range(at, len(cols)):
        # What is left is compact: its pairs alone gather their dimensions.
        for d in range(len(cols[j])):
            score = score + q[a, j * ask.width + d] * cols[j][d][b]
        keep = score + (qm[j + 1][a] * mass[j + 1][b] + slack) >= lim[a]
        a, b, score = a[keep], b[keep], score[keep]
    return a, b, score if exact else np.array([min(max(int(x), LEAST), MOST) for x in score], np.int64)


def first(q: np.ndarray, score: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest of each query, ties to the smaller id."""
    o = np.lexsort((v, ~score, q))
    q, score, v = q[o], score[o], v[o]
    start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return q[rank < k], score[rank < k], v[rank < k]


def scan(batches: Iterator[pa.RecordBatch], ask: Asked, k: int, span: int = 64) -> Iterator[pa.RecordBatch]:
    """All queries against the tiles of a partition: k rows a query at most."""
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lim = np.full(len(ask.ids), -np.inf)
    for batch in batches:
        for t in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
            vid, mass = np.frombuffer(t["ids"], np.int64), np.frombuffer(t["mass"], np.float64).reshape(-1, t["rows"])
            tile = [np.frombuffer(c, f"i{t['bytes']}").reshape(-1, t["rows"]) for c in t["blocks"]]
            found = [best]
            for f in range(0, len(ask.ids), span):
                s = slice(f, f + span)
                a, b, score = search(tile, vid, mass, ask, s, lim[s], k)
                # At once k a query: a tile's ties, of all queries together, are more than memory holds.
                found.append(first(a + f, score.astype(np.int64), vid[b], k))
            best = first(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
            held = np.bincount(best[0], minlength=len(ask.ids)) >= k
            worst = np.full(len(ask.ids), np.inf)
            # Longs as doubles may round up; a bound must not.
            np.minimum.at(worst, best[0], np.where(np.abs(best[1]) < 2**53, best[1], best[1] - np.abs(best[1]) * 1e-15))
            lim = np.where(held, np.maximum(lim, worst), lim)
    yield pa.RecordBatch.from_arrays([pa.array(ask.ids[best[0]]), pa.array(best[2]), pa.array(best[1])], names=["query_id", "vec_id", "score"])


def layout(ok: DataFrame, dim: int, times: int, width: int, order: list[int]) -> DataFrame:
    """The index: tiles of rows, each block of dimensions one vertical array (a row a dimension), with ids and masses."""
    rows = min(4096, max(64, (1 << 20) // max(dim, 1)))
    edges = list(range(0, dim, width)) or [0]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(part: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            ids, v = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])[:, order].T
            most = np.abs(v.astype(np.float64)).max(initial=0)
            size = 2 if most < 2**15 else 4 if most < 2**31 else 8
            blocks = [np.ascontiguousarray(v[e : e + width], f"i{size}").tobytes() for e in edges] if dim else []
            return pa.RecordBatch.from_pylist([{"rows": len(ids), "bytes": size, "ids": ids.tobytes(), "mass": masses(v, edges).tobytes(), "blocks": blocks}], pa.schema([("rows", pa.int32()), ("bytes", pa.int32()), ("ids", pa.binary()), ("mass", pa.binary()), ("blocks", pa.list_(pa.binary()))]))

        for b in batches:
            for at in range(0, len(b), rows):
                part = b.slice(at, rows)
                held.append((part.column(0).to_numpy(), whole(matrix(part.column(1), dim), times)))
                n += len(part)
                if n >= rows:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    return ok.select("vec_id", "embedding").mapInArrow(tiles, "rows int, bytes int, ids binary, mass binary, blocks array<binary>")


def by_energy(ok: DataFrame, dim: int, times: int) -> list[int]:
    """Dimensions by falling sum of squares over all rows: what is left after a block is then small early."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for b in batches:
            total += (whole(matrix(b.column(0), dim), times).astype(np.float64) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total)], names=["d", "e"])

    return [r["d"] for r in ok.select("embedding").mapInArrow(sums, "d int, e double").groupBy("d").agg(F.sum("e").alias("e")).orderBy(F.desc("e"), "d").collect()]


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, times: int = 256, width: int = 8, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k other rows of highest inner product.

    Components become floor(times * x), as longs (what a long can't hold takes its nearest bound), and the score is the exact integer inner product,
    held to a long's bounds in the same way; ties go to the smaller vec_id. An inner product exists between vectors of one length, so each length is
    searched by itself; vectors without components score 0. Rows take no part without vec_id, or where the vector is null or holds a null or non-finite
    component. Repeated rows are candidates of their own; a repeated query is asked once, by its smallest vector, and rows of its
    own id are not its candidates. An empty table gives no rows; other columns are ignored.

    Queries go out in blocks (block * dimension * 8 bytes), each collected, broadcast, searched over the whole index and written
    before the next one, so that neither the driver nor a task holds more than one. A task returns k rows a query at most.
    """
    spark = vectors.sparkSession
    ok = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    counts = {r["d"]: r["n"] for r in ok.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = None
    for dim in sorted(counts):
        part = _top(ok.where(F.size("embedding") == dim), dim, counts[dim], k, every, times, width, block)
        for p in part:
            found = p if found is None else found.unionByName(p)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(ok: DataFrame, dim: int, n: int, k: int, every: int, times: int, width: int, block: int) -> Iterator[DataFrame]:
    spark = ok.sparkSession
    asked = ok.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = -(-asked.count() // block)
    if not blocks:
        return
    order = by_energy(ok, dim, times) if dim else []
    # The work is rows times queries, so rows are dealt evenly however few files they come in.
    index = materialize(layout(ok.repartition(max(spark.sparkContext.defaultParallelism, n * max(dim, 64) >> 23)), dim, times, width, order), "topk-index")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        if rows:
            v = whole(np.array([r["embedding"] for r in rows]).reshape(len(rows), dim), times)[:, order]
            sent = spark.sparkContext.broadcast(Asked(np.array([r["vec_id"] for r in rows]), v, width))
            yield materialize(index.mapInArrow(lambda it, a=sent: scan(it, a.value, k), "query_id long, vec_id long, score long"), "topk-found")
            sent.destroy()


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
