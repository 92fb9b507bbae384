"""Suffix-array dedup: bytes covered by a string of fixed length that also starts anywhere else.

Anchors (window minima of a rolling hash) bring together the places where a repeated string can be; around them the
sorted order of suffixes and their common prefixes are built column by column, one symbol of each context a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A symbol that equals no other, beyond a text's ends.
ABSENT = 256
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_SEGMENT = 900_000
_POS = 20


class Powers:
    """Powers of a rolling hash's base and of its inverse mod 2 ** 64, up to a segment's length."""

    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls.held or len(cls.held[base][0]) < n:
            size = max(n, 1 << 16)
            cls.held[base] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up, down = cls.held[base]
        return up[:n], down[:n]


def _sums(c: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Of symbols c their sums up to each place, weighed by powers of the base, and the powers that undo a place's weight."""
    up, down = Powers.of(len(c) + 1, base)
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(c * up[:-1], out=total[1:])
    return total, down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_minima(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values: of a block's rest and the next block's start."""
    n = len(v)
    pad = np.full(-n % w, v.max(initial=0), v.dtype)
    rows = np.concatenate([v, pad]).reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    rest = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(rest[: n - w + 1], head[w - 1 : n])


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and (two independent) context hashes of a text's anchors.

    An anchor is the gram with the least hash (the last of several) of all grams in some string of `length`; so
    two equal strings have an anchor at the same place. Its context is every byte of a string that holds the gram.
    """
    n, side = len(text), length - gram
    pos, grams, one, two = ([np.zeros(0, t)] for t in (np.int64, np.uint64, np.uint64, np.uint64))
    for s in range(0, max(0, n - length + 1), _SEGMENT):
        lo, hi = max(0, s - side), min(n, s + _SEGMENT + 2 * length)
        c = np.frombuffer(text, np.uint8, hi - lo, lo).astype(np.uint64) + np.uint64(1)
        total, down = _sums(c, _BASE)
        g = _mix((total[gram:] - total[:-gram]) * down[: len(c) - gram + 1])
        first = s - lo
        last = min(s + _SEGMENT, n - length + 1) - lo + side  # grams of strings that start in this segment
        code = (g[first:last] & ~np.uint64((1 << _POS) - 1)) | np.arange(last - first, dtype=np.uint64)[::-1]
        low = sliding_minima(code, side + 1)
        low = low[np.r_[True, low[1:] != low[:-1]]]
        at = last - 1 - (low & np.uint64((1 << _POS) - 1)).astype(np.int64)
        a, b = np.maximum(at - side, 0), np.minimum(at + length, len(c))
        shape = (at - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (b - at).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        other, back = _sums(c, _OTHER)
        pos.append(at + lo)
        grams.append(g[at])
        one.append(_mix((total[b] - total[a]) * down[a] + shape))
        two.append(_mix((other[b] - other[a]) * back[a] + shape))
    # An anchor of two segments has the same hashes in both.
    where, once = np.unique(np.concatenate(pos), return_index=True)
    return where, *(np.concatenate(x)[once].view(np.int64) for x in (grams, one, two))


def repeated_starts(group: np.ndarray, columns: np.ndarray, length: int) -> np.ndarray:
    """Of aligned contexts (a row each, ABSENT beyond a text's ends), where a string starts that another row of the same group has at the same column.

    Column-wise construction from the right: each round takes one symbol of every row, moves the rows to the order of
    their suffixes from there (stable by the symbol, as inserting into the collection's Burrows-Wheeler transform
    does), and updates the common prefixes of neighbours: one more than the least between their former places.
    Rows are given by rising group. Only a round's order and prefixes are kept.
    """
    m, width = columns.shape
    out = np.zeros((m, max(0, width - length + 1)), bool)
    order = np.arange(m)
    lcp = np.zeros(m + 1, np.int32)  # of a place and the one before
    key = group.astype(np.int64) * (ABSENT + 1)
    for c in range(width - 1, -1, -1):
        symbol = columns[order, c]
        k = key[order] + symbol
        move = np.argsort(k, kind="stable")
        same = (k[move][1:] == k[move][:-1]) & (symbol[move][1:] != ABSENT)
        p, q = move[:-1][same] + 1, move[1:][same] + 1
        fresh = np.zeros(m + 1, np.int32)
        if len(p):
            fresh[1:m][same] = 1 + np.minimum.reduceat(lcp, np.stack([p, q], axis=1).ravel())[::2]
        order, lcp = order[move], fresh
        if c < out.shape[1]:
            twin = lcp[1:m] >= length
            out[order[1:][twin], c] = True
            out[order[:-1][twin], c] = True
    return out


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by strings that start at these (rising) places, as runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _solve(part: pd.DataFrame, length: int, gram: int) -> pd.DataFrame:
    """Repeated runs of the contexts of whole groups, relative to the anchor."""
    side, width = length - gram, 2 * length - gram
    columns = np.full((len(part), width), ABSENT, np.int16)
    for i, (ctx, left) in enumerate(zip(part["ctx"], part["left"], strict=True)):
        columns[i, side - left : side - left + len(ctx)] = np.frombuffer(ctx, np.uint8)
    group = np.cumsum(np.r_[0, part["a"].to_numpy()[1:] != part["a"].to_numpy()[:-1]])
    hit = repeated_starts(group, columns, length)
    rows = [(a, h, g, s - side, e - side) for a, h, g, x in zip(part["a"], part["h"], part["g"], hit, strict=True) for s, e in _runs(np.flatnonzero(x), length)]
    return pd.DataFrame(rows, columns=["a", "h", "g", "s", "e"])


def repeats(docs: DataFrame, length: int = 200, gram: int = 32, together: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts are rows (doc_id, key, text); spans (key, spans) has the repeated bytes of each key's text.

    key stands for equal texts (MD5); a context is known by its anchor's hash and two hashes of its own, 192 bits in
    all. What all places of an anchor have in common needs no text: if a context occurs twice, all its strings
    repeat. Only contexts that differ from others at the same anchor are fetched and compared, each different one
    once; anchors with more than `together` of those, which no task should hold, count their strings by
    hash (BLAKE2, 128 bits) instead, in a shuffle. Aggregates that a join needs are written first, so that adaptive
    execution can split a hot anchor's or text's rows.
    """
    side = length - gram
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("key", F.unhex(F.md5("text")))
    ctx = ["a", "h", "g"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                got = [(k, *anchors(t, length, gram)) for k, t in zip(pdf["key"][at : at + 500], pdf["text"][at : at + 500], strict=True) if len(t) >= length]
                if got:
                    keys = np.repeat(np.array([x[0] for x in got], object), [len(x[1]) for x in got])
                    yield pd.DataFrame({**{c: np.concatenate([x[i] for x in got]) for i, c in ((2, "a"), (3, "h"), (4, "g"))}, "key": keys, "pos": np.concatenate([x[1] for x in got])})

    rows = materialize(src.select("key", "text").mapInPandas(find, "a long, h long, g long, key binary, pos long"), "suffix-anchors")
    kinds = F.struct("h", "g")
    busy = rows.groupBy("a").agg(F.count("*").alias("n"), F.min(kinds).alias("c0"), F.max(kinds).alias("c1")).where("n > 1").select("a", (F.col("c0") != F.col("c1")).alias("differ"))
    busy = materialize(busy, "suffix-frequent")
    rows = materialize(rows.join(busy, "a"), "suffix-busy")
    # Contexts that occur twice are repeated as a whole; others of the same anchor are compared.
    seen = rows.where("differ").groupBy(*ctx).agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("at"))
    seen = materialize(seen.select(*ctx, "n", "at.key", "at.pos"), "suffix-contexts")
    need = materialize(seen.groupBy("a").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("least = 1").select("a", "kinds"), "suffix-compared")
    wanted = seen.join(need, "a").groupBy("key").agg(F.collect_list(F.struct(*ctx, "pos", "kinds")).alias("asked"))
    wanted = materialize(wanted, "suffix-wanted")
    context = "a long, h long, g long, kinds long, left int, ctx binary"

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, asked in zip(pdf["text"], pdf["asked"], strict=True):
                for r in asked:
                    left = min(side, r["pos"])
                    out.append((r["a"], r["h"], r["g"], r["kinds"], left, bytes(text[r["pos"] - left : r["pos"] + length])))
            yield pd.DataFrame(out, columns=["a", "h", "g", "kinds", "left", "ctx"])

    contexts = materialize(src.select("key", "text").join(wanted, "key").mapInPandas(fetch, context), "suffix-texts")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            if not len(pdf):
                continue
            whole = int(np.searchsorted(pdf["a"].to_numpy(), pdf["a"].iloc[-1]))  # the last group may go on
            held.append(pdf.iloc[:whole])
            n += whole
            if n >= 10_000:
                yield _solve(pd.concat(held).drop_duplicates(ctx), length, gram)
                held, n = [], 0
            held.append(pdf.iloc[whole:])
        if held:
            last = pd.concat(held).sort_values("a", kind="stable").drop_duplicates(ctx)
            if len(last):
                yield _solve(last, length, gram)

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = contexts.where(F.col("kinds") <= together).drop("kinds").repartition(parts, "a").sortWithinPartitions("a").mapInPandas(solve, "a long, h long, g long, s int, e int")

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, h, g, left, ctx in zip(pdf["a"], pdf["h"], pdf["g"], pdf["left"], pdf["ctx"], strict=True):
                n = len(ctx) - length + 1
                yield pd.DataFrame({"a": a, "h": h, "g": g, "s": np.arange(n) - left, "x": [hashlib.blake2b(ctx[i : i + length], digest_size=16).digest() for i in range(n)]})

    many = contexts.where(F.col("kinds") > together).drop("kinds").dropDuplicates(ctx).mapInPandas(strings, "a long, h long, g long, s int, x binary")
    twice = many.groupBy("a", "s", "x").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    many = many.join(twice, ["a", "s", "x"], "left_semi").select(*ctx, "s", (F.col("s") + length).cast("int").alias("e"))
    own = materialize(few.unionByName(many), "suffix-own")

    whole = rows.where("not differ").select("key", "pos", F.lit(-side).alias("s"), F.lit(length).alias("e"))
    twice = rows.where("differ").join(seen.where("n > 1").select(*ctx), ctx, "left_semi").select("key", "pos", F.lit(-side).alias("s"), F.lit(length).alias("e"))
    once = seen.where("n = 1").join(own, ctx).select("key", "pos", "s", "e")
    every = whole.unionByName(twice).unionByName(once).select("key", (F.col("pos") + F.col("s")).alias("s"), (F.col("pos") + F.col("e")).alias("e"))
    return src, every.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def dedup(docs: DataFrame, length: int = 200, gram: int = 32) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of all documents (doc_id, text).

    Removed is each UTF-8 byte covered by a string of `length` bytes that also starts anywhere else, in the same
    document too. Null and empty texts have no bytes. Repeated rows repeat each other's text, so they lose it if it is
    long enough. An empty table gives no rows; other columns are ignored.
    """
    texts, spans = repeats(docs, length, gram)
    spans = materialize(spans, "suffix-spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, t, s in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
                runs = merged([(max(0, x["s"]), min(len(t), x["e"])) for x in s] if s is not None else [])
                # A context cut short by the text's end may be shorter than a string.
                runs = [(a, b) for a, b in runs if b - a >= length]
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(t[at:a])
                    at = b
                kept.update(t[at:])
                out.append((d, len(t), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = texts.join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT r, i, md5_number(substr(h, (2 * i + 1)::BIGINT, 400)) AS k FROM (SELECT r, h, unnest(range(0, greatest(0, n - 199))) AS i FROM d)),
s AS (SELECT r, i FROM w JOIN (SELECT k FROM w GROUP BY 1 HAVING count(*) > 1) USING (k)),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM s),
p AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS q FROM g) GROUP BY r, q),
k AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, (2 * prev + 1)::BIGINT, (2 * (a - prev))::BIGINT), '' ORDER BY a) AS kept, max(b) AS e
  FROM (SELECT p.*, d.h, coalesce(lag(b) OVER (PARTITION BY p.r ORDER BY a), 0) AS prev FROM p JOIN d USING (r)) GROUP BY r)
SELECT d.doc_id, d.n AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN k.r IS NULL THEN d.h ELSE k.kept || substr(d.h, (2 * k.e + 1)::BIGINT) END)) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
