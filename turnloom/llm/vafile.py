"""Vector code compression: product codes, each part's nearest entry found by VA-file filtering of the codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .topk import MOST, matrix, usable, whole

#: Bits of a cell: each coordinate of an entry lies in one of 2 ** BITS cells of its dimension.
BITS = 3


class Codebook:
    """Entries of one part (a row each, whole numbers) and their approximation: the cell of each coordinate.

    Cells of a dimension are bounded by quantiles of its entries' coordinates, so that each holds about as many.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.n, self.dim = entries.shape
        self.size = float(np.abs(entries.astype(np.float64)).max(initial=0))
        cells = 1 << BITS
        ordered = np.sort(entries, axis=0)
        at = np.minimum(np.arange(1, cells) * self.n // cells, self.n - 1)
        inner = ordered[at]
        self.cell = (entries[None] >= inner[:, None]).sum(axis=0) if self.dim else np.zeros((self.n, 0), np.int64)
        # The least and the greatest coordinate that lie in each cell: tighter than its bounds.
        self.low, self.high = np.empty((self.dim, cells)), np.empty((self.dim, cells))
        for d in range(self.dim):
            for c in range(cells):
                inside = entries[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = (inside.min(), inside.max()) if len(inside) else (0, 0)
        # An entry's cells as one row of zeros and ones, by which a table's looked-up values are summed.
        self.which = np.zeros((self.dim * cells, self.n))
        for d in range(self.dim):
            self.which[d * cells + self.cell[:, d], np.arange(self.n)] = 1

    def nearest(self, x: np.ndarray, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry by exact squared distance (ties to the lower index), and that distance."""
        if not self.dim or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if (2 * max(self.size, float(np.abs(x.astype(np.float64)).max()))) ** 2 * self.dim >= 2.0**52:
            return self.nearest_of_large(x)
        found = [self.filtered(x[at : at + rows].astype(np.float64)) for at in range(0, len(x), rows)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def filtered(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's tables hold the least and the greatest squared difference to every cell. Their sums over an entry's cells bound its
        distance; entries whose lower bound is at most the least upper bound are measured exactly, in whole numbers."""
        q = x[:, :, None]
        near = np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2
        far = np.maximum(np.abs(q - self.low), np.abs(q - self.high)) ** 2
        least = near.reshape(len(x), -1) @ self.which
        most = (far.reshape(len(x), -1) @ self.which).min(axis=1)
        a, e = np.nonzero(least <= most[:, None])
        diff = x[a].astype(np.int64) - self.entries[e]
        d = np.einsum("ij,ij->i", diff, diff)
        # Rows come in order and each has its entries by index, so the first of the smallest is the lowest.
        start = np.searchsorted(a, np.arange(len(x)))
        best = np.minimum.reduceat(d, start)
        hit = np.flatnonzero(d == best[a])
        _, one = np.unique(a[hit], return_index=True)
        return e[hit[one]], best

    def nearest_of_large(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for coordinates whose squares a double can't hold: bounds as doubles, made wider by their error, distances as Python's integers."""
        own, index, dist = self.entries.astype(object), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i, row in enumerate(x):
            q = row.astype(np.float64)[:, None]
            near = np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2
            far = np.maximum(np.abs(q - self.low), np.abs(q - self.high)) ** 2
            wide = 1e-9 * (self.size + np.abs(q).max()) ** 2 * self.dim
            least, most = near.reshape(-1) @ self.which, (far.reshape(-1) @ self.which).min()
            d, j = min((sum(v * v for v in (row.astype(object) - own[j])), j) for j in np.flatnonzero(least <= most + wide))
            index[i], dist[i] = j, min(d, MOST)
        return index, dist


def split_parts(v: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x width; a length that parts can't divide is filled up with zeros."""
    width = -(-v.shape[1] // parts)
    return np.pad(v, ((0, 0), (0, width * parts - v.shape[1]))).reshape(len(v), parts, width)


def tuned(ok: DataFrame, dim: int, entries: int, parts: int, rounds: int, times: int) -> list[Codebook]:
    """Codebooks of one length after the given rounds of assignment and floored means.

    A task gives a row a part and entry at most (a count and sums by position), which the JVM adds up before and after the shuffle;
    the driver holds the codebooks alone (entries x dimension).
    """
    spark = ok.sparkSession
    first = ok.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").limit(entries).collect()
    v = split_parts(whole(np.array([r["embedding"] for r in sorted(first, key=lambda r: r["vec_id"])]).reshape(len(first), dim), times), parts)
    books = [Codebook(v[:, p]) for p in range(parts)]
    width = v.shape[2]
    for _ in range(rounds if width else 0):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            books = sent.value
            count = np.zeros((parts, len(first)), np.int64)
            total = np.zeros((parts, len(first), width), np.int64)
            large: dict[tuple[int, int, int], int] = {}
            for b in batches:
                x = split_parts(whole(matrix(b.column(0), dim), times), parts)
                for p in range(parts):
                    near = books[p].nearest(x[:, p])[0]
                    count[p] += np.bincount(near, minlength=len(first))
                    if np.abs(x[:, p].astype(np.float64)).max(initial=0) < 2.0**30:
                        # Sums of a batch are exact as doubles; those of a task fit a long for 2 ** 32 rows.
                        for j in range(width):
                            total[p, :, j] += np.bincount(near, weights=x[:, p, j].astype(np.float64), minlength=len(first)).astype(np.int64)
                    else:
                        for i, e in enumerate(near):
                            for j in range(width):
                                large[p, int(e), j] = large.get((p, int(e), j), 0) + int(x[i, p, j])
            for p in range(parts):
                used = np.flatnonzero(count[p])
                own = [[int(total[p, e, j]) + large.get((p, int(e), j), 0) for j in range(width)] for e in used]
                rows = {"p": [p] * len(used), "e": used.tolist(), "n": count[p][used].tolist()} | {f"s{j}": [str(o[j]) for o in own] for j in range(width)}
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("p", pa.int32()), ("e", pa.int32()), ("n", pa.int64()), *((f"s{j}", pa.string()) for j in range(width))]))

        got = ok.select("embedding").mapInArrow(sums, "p int, e int, n long" + "".join(f", s{j} string" for j in range(width)))
        got = got.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{j}").cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]).collect()
        sent.destroy()
        new = [b.entries.copy() for b in books]
        for r in got:
            new[r["p"]][r["e"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
        books = [Codebook(e) for e in new]
    return books


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b.entries.tolist() for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, times: int = 1024) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256): each vector as `parts` indexes into codebooks, and its squared error.

    Components become floor(times * x), as longs (what a long can't hold takes its nearest bound). Vectors are cut into equal consecutive parts; a
    codebook starts as that part of the vectors of the smallest ids and takes `rounds` rounds of nearest-entry assignment and
    floored means; unused entries stay. Every row takes part in every round; sums are exact.

    Rows go without vec_id or where the vector is null or holds a null or non-finite component. Vectors of one length share
    codebooks, each length has its own, and a length that can't be cut equally is filled up with zeros. An id that several rows have starts one entry, with
    its smallest vector; fewer ids than entries give fewer entries. Repeated rows are coded alike and count each. Errors beyond a long take its greatest
    value. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = [c for c in vectors.columns if c == "label"]
    ok = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *([F.col("label").cast("string").alias("label")] if kept else [F.lit(None).cast("string").alias("label")])))
    counts = {r["d"]: r["n"] for r in ok.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    out, schema = None, "vec_id long, label string, code string, error long, codebooks_sha256 string"
    for dim in sorted(counts):
        own = ok.where(F.size("embedding") == dim).repartition(max(spark.sparkContext.defaultParallelism, counts[dim] >> 17))
        own = materialize(own, "codes-vectors")
        books = tuned(own, dim, entries, parts, rounds, times)
        sent, sha = spark.sparkContext.broadcast(books), digest(books)

        def code(batches: Iterator[pa.RecordBatch], dim=dim, sent=sent, sha=sha) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = split_parts(whole(matrix(b.column(2), dim), times), parts)
                near = [sent.value[p].nearest(x[:, p]) for p in range(parts)]
                total = sum((d.astype(object) for _, d in near), np.zeros(len(b), object))
                text = ["".join(f"{int(i):02x}" for i in row) for row in zip(*(i for i, _ in near), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([min(int(t), MOST) for t in total], pa.int64()), pa.array([sha] * len(b), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

        coded = own.select("vec_id", "label", "embedding").mapInArrow(code, schema)
        out = coded if out is None else out.unionByName(coded)
    return spark.createDataFrame([], schema) if out is None else out


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of errors over rows of an equal label (nulls together; at most a long's greatest value).

    Labels are totalled before they meet the rows; the rows of a frequent label don't meet in one task unless the totals are too many to
    broadcast, and then adaptive execution splits them.
    """
    coded = materialize(coded, "codes")
    totals = coded.groupBy(F.col("label").alias("_l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_l"))).drop("_l")


def oracle(parts: int = 4, rounds: int = 4) -> str:
    """SQL for vectors of one length that the parts divide."""
    near = "(SELECT id, p, min_by(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {b} b ON x.p = b.p) GROUP BY id, p)"
    steps = ""
    for r in range(rounds):
        steps += f"""a{r} AS MATERIALIZED {near.format(b=f"b{r}")},
m{r} AS MATERIALIZED (SELECT p, e, list(s ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(x.v[i])::DOUBLE / count(*))::BIGINT AS s FROM a{r} JOIN x USING (id, p), (SELECT unnest(range(1, (SELECT max(len(v)) + 1 FROM x))) AS i) GROUP BY p, e, i) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e),
"""
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT id, vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM k, (SELECT unnest(range({parts})) AS p)),
f AS (SELECT vec_id, min(v) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k GROUP BY vec_id ORDER BY vec_id LIMIT 256),
b0 AS MATERIALIZED (SELECT p, e, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM f, (SELECT unnest(range({parts})) AS p)),
{steps}z AS MATERIALIZED {near.format(b=f"b{rounds}")},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT id, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM z GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (id), h
"""
