"""Approximate nearest neighbours: randomly rotated one-bit codes with error bounds, then exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


#: Bits that a query's coordinates are rounded to.
PLANES = 4


class Rotation:
    """A centre and a random rotation; codes are the signs of the rotated, centred, unit vectors."""

    def __init__(self, centre: np.ndarray, seed: int = 7):
        self.dim = len(centre)
        self.bits = max(64, -(-self.dim // 64) * 64)
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, self.bits)))
        self.turn = (q * np.sign(np.diag(r)))[: self.dim]
        self.centre = centre

    def unit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = x - self.centre
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.linalg.norm(r, axis=1)
            return np.nan_to_num((r / np.maximum(norm, 1e-300)[:, None]) @ self.turn), norm

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed bits, norms, and the inner product of each unit vector with its code: the correction scalar."""
        u, norm = self.unit(x)
        return np.packbits(u > 0, axis=1), norm, np.abs(u).sum(axis=1) / np.sqrt(self.bits)

    def asked(self, x: np.ndarray) -> Asked:
        return Asked(self, x)


class Asked:
    """Queries with their rotated coordinates rounded to PLANES bits, a packed word of each bit."""

    def __init__(self, rot: Rotation, x: np.ndarray):
        u, self.norm = rot.unit(x)
        self.x, self.bits = x, rot.bits
        self.low = u.min(axis=1)
        self.step = np.maximum((u.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-12)
        level = np.rint((u - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = self.low * rot.bits + self.step * level.sum(axis=1)
        self.plane = [np.packbits(level >> j & 1, axis=1).view(np.uint64) for j in range(PLANES)]

    def products(self, rows: slice, code: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of queries and codes, by counting bits that a query's planes share with a code."""
        shared = np.zeros((len(self.low[rows]), len(code)), np.int32)
        for j, plane in enumerate(self.plane):
            for w in range(code.shape[1]):
                shared += np.bitwise_count(plane[rows, w, None] & code[None, :, w]).astype(np.int32) << j
        held = self.step[rows, None] * shared + self.low[rows, None] * ones
        return (2 * held - self.total[rows, None]) / np.sqrt(self.bits)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        d = x - y
        return np.sqrt((d * d).sum(axis=1))


def best(q: np.ndarray, d: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query: smallest distance, ties to the smaller id."""
    o = np.lexsort((v, d, q))
    q, d, v = q[o], d[o], v[o]
    start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return q[rank < k], d[rank < k], v[rank < k]


def scan(batches: Iterator[pd.DataFrame], qid: np.ndarray, ask: Asked, k: int, eps: float, rows: int = 2048, width: int = 64) -> Iterator[pd.DataFrame]:
    """Every query against every code of a partition; the exact distance only where the bound allows a place in the first k."""
    lim = np.full(len(qid), np.inf)
    keep = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            part = pdf.iloc[at : at + rows]
            x, vid = np.stack(part["embedding"].to_numpy()), part["vec_id"].to_numpy()
            code = np.frombuffer(b"".join(part["code"]), np.uint64).reshape(len(part), -1)
            ones = np.bitwise_count(code).sum(axis=1)
            norm, ip = part["norm"].to_numpy(), np.maximum(part["ip"].to_numpy(), 1e-6)
            spread = np.maximum(0, 1 - ip * ip) / (ip * ip) / (ask.bits - 1)
            found = [keep]
            for f in range(0, len(qid), width):
                s = slice(f, f + width)
                qn = ask.norm[s, None]
                with np.errstate(over="ignore", invalid="ignore"):
                    scale = 2 * qn * norm
                    mid = qn**2 + norm**2 - scale * (ask.products(s, code, ones) / ip)
                    # The code's part and the rounded query's, each by standard errors.
                    err = scale * eps * np.sqrt(spread + ask.step[s, None] ** 2 / (3 * ip * ip))
                    own = qid[s, None] == vid
                    high = np.where(own | ~(mid + err < np.inf), np.inf, mid + err)
                    if high.shape[1] > k:
                        lim[s] = np.minimum(lim[s], np.partition(high, k - 1, axis=1)[:, k - 1])
                    slack = 1e-9 * (qn + norm) ** 2
                    # What overflows is no bound: it is reranked.
                    qi, ri = np.nonzero(~(mid - err - slack > lim[s, None]) & ~own)
                for c in range(0, len(qi), 100_000):
                    a, b = qi[c : c + 100_000], ri[c : c + 100_000]
                    found.append((a + f, exact(ask.x[a + f], x[b]), vid[b]))
            keep = best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
            q, d, _ = keep
            full = np.bincount(q, minlength=len(qid)) >= k
            worst = np.full(len(qid), -np.inf)
            with np.errstate(over="ignore"):
                np.maximum.at(worst, q, d * d)
            lim = np.where(full, np.minimum(lim, worst * (1 + 1e-9)), lim)
    yield pd.DataFrame({"query_id": qid[keep[0]], "vec_id": keep[2], "score": keep[1]})


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, eps: float = 3.0, sample: int = 4096, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k nearest other rows.

    Nearness is Euclidean distance in double precision, ties to the smaller vec_id; a distance exists between vectors
    of one length, so each length is searched by itself. Vectors that are null, empty or zero, or hold a null or non-finite
    component, take no part, nor do rows without vec_id. Repeated rows are candidates of their own; a repeated query
    is asked once. An empty table gives no rows; other columns are ignored.

    The centre is the mean of `sample` rows (the smallest hashes of vec_id); every row is indexed. Queries go out in
    blocks of `block` (a bound in bytes: block * dimension * 9), each collected, broadcast, scanned against all codes and written before the
    next; each task returns k rows a query at most. A bound of `eps` standard errors decides what is reranked.
    """
    spark = vectors.sparkSession
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    ok = ok.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    found = [p for r in ok.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect() for p in _nearest(ok.where(F.size("embedding") == r["d"]), k, every, eps, sample, block)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(ok: DataFrame, k: int, every: int, eps: float, sample: int, block: int) -> Iterator[DataFrame]:
    """Candidates (query_id, vec_id, score) among vectors of one length, a frame for each block of queries."""
    spark = ok.sparkSession
    asked = ok.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = asked.count()
    if not n:
        return
    fit = ok.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    scale = max(1.0, max(abs(v) for r in fit for v in r["embedding"]))
    rot = Rotation(np.mean([np.array(r["embedding"]) / scale for r in fit], axis=0) * scale)
    shared = spark.sparkContext.broadcast(rot)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                code, norm, ip = shared.value.encode(np.stack(pdf["embedding"].to_numpy()))
                yield pdf.assign(code=[c.tobytes() for c in code], norm=norm, ip=ip)

    index = materialize(ok.mapInPandas(encode, "vec_id long, embedding array<double>, code binary, norm double, ip double"), "ann-index")
    n_blocks = -(-n // block)
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).orderBy("vec_id").collect()
        if rows:
            asking = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows]), rot.asked(np.array([r["embedding"] for r in rows]))))
            # Written before the next block is collected: the driver and the executors hold one block at a time.
            yield materialize(index.mapInPandas(lambda it, a=asking: scan(it, *a.value, k, eps), "query_id long, vec_id long, score double"), "ann-found")
            asking.destroy()
