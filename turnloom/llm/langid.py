"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties, then calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashed n-grams (1 to 3 characters) have this many buckets.
BUCKETS = 1 << 17
ORDERS = (1, 2, 3)
SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Each code point as itself if a letter, else a space."""
    return np.array([c if chr(c).isalpha() else SPACE for c in range(0x110000)], np.uint32)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, two spaces before and after each, and where each text starts."""
    parts = [t.lower() for t in texts]
    raw = np.frombuffer(("  " + "  ".join(parts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 2
    start = np.r_[0, np.cumsum(size)] + 1
    return _letters()[raw], start


def ngrams(cp: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram at each place; BUCKETS where it has two spaces in a row or is a space."""
    space = cp == SPACE
    h = cp * np.uint32(0x9E3779B1)
    bad = space
    for n in ORDERS:
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + cp[n - 1 :] * np.uint32(0xC2B2AE35)
            pair = space[n - 2 : -1] & space[n - 1 :]
            bad = pair if n == 2 else bad[:-1] | pair
        yield np.where(bad, BUCKETS, (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - 17)).astype(np.int32)


def _batches(pdf: pd.DataFrame, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Runs of rows of about so many characters."""
    run = (pdf["text"].str.len().fillna(0).to_numpy().cumsum() // chars).astype(np.int64)
    for _, part in pdf.groupby(run, sort=False):
        yield part


def document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one partition: how many texts hold each bucket."""
    df, flag, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS + 1, bool), 0
    for pdf in batches:
        for part in _batches(pdf):
            texts = part["text"].fillna("").tolist()
            n += len(texts)
            cp, start = codes(texts)
            grams = list(ngrams(cp))
            for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                for g in grams:
                    flag[g[a - 1 : b - 1]] = True
                flag[BUCKETS] = False
                hit = np.flatnonzero(flag)
                df[hit] += 1
                flag[hit] = False
    hit = np.flatnonzero(df)
    yield pd.DataFrame({"bucket": np.r_[hit, -1], "n": np.r_[df[hit], n]})


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its buckets and term frequencies."""
    cp, start = codes(texts)
    grams = list(ngrams(cp))
    out = []
    for a, b in zip(start[:-1], start[1:], strict=True):
        ids, n = np.unique(np.concatenate([g[a - 1 : b - 1] for g in grams]), return_counts=True)
        ok = ids < BUCKETS
        ids, n = ids[ok], n[ok]
        out.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


class Ftrl:
    """FTRL-proximal for the softmax loss; l1 and l2 make the elastic net."""

    def __init__(self, classes: list[str], alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-4):
        self.classes, self.alpha, self.beta, self.l1, self.l2 = classes, alpha, beta, l1, l2
        self.z = np.zeros((BUCKETS, len(classes)))
        self.n = np.zeros((BUCKETS, len(classes)))

    def weights(self, ids: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, ids: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(ids)
        g = x[:, None] * (softmax(x @ w) - (np.arange(len(self.classes)) == y))
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least held-back log loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, g = -6.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    """IDF times weights by bucket, a row of zeros for what is no n-gram, and the temperature."""

    def __init__(self, classes: list[str], table: np.ndarray, temp: float):
        self.classes, self.table, self.temp = classes, np.vstack([table, np.zeros((1, len(classes)))]).astype(np.float32), temp

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        cp, start = codes(texts)
        total, n = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        for g in ngrams(cp):
            at = np.minimum(start[:-1] - 1, len(g) - 1)
            end = int(start[-1] - 1)
            total += np.add.reduceat(self.table[g[:end]], at, axis=0, dtype=np.float64)
            n += np.add.reduceat((g[:end] < BUCKETS).astype(np.int64), at)
        p = softmax(total / np.maximum(n, 1)[:, None] / self.temp)
        best = p.argmax(axis=1)
        some = n > 0
        return [self.classes[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, p.max(axis=1), 0.0)


def fit(train: DataFrame, sample: int = 512, epochs: int = 4) -> Model | None:
    """A model from rows (doc_id, text, lang), lang not null; None without any.

    Document frequencies are those of all rows. The weights are fitted on `sample` rows of each language at most (the
    smallest hashes of doc_id, ties by the text's), so a rare language keeps its class; a fifth are kept for the temperature.
    """
    counts = train.select("text").mapInPandas(document_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = int(counts.loc[counts["bucket"] < 0, "n"].sum())
    if not total:
        return None
    df = np.zeros(BUCKETS)
    seen = counts[counts["bucket"] >= 0]
    df[seen["bucket"]] = seen["n"]
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                f = features(pdf["text"].fillna("").tolist())
                yield pd.DataFrame({"h": pdf["h"], "doc_id": pdf["doc_id"], "lang": pdf["lang"], "ids": [i.tobytes() for i, _ in f], "tf": [x.tobytes() for _, x in f]})

    hashed = train.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("g"), "doc_id", "lang", "text")
    # Each map task keeps its first `sample` a language, so no language meets in one task.
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "g"))
    last = {r["lang"]: r["x"] for r in hashed.select("h", "g", "lang").withColumn("n", first).where(F.col("n") <= sample).groupBy("lang").agg(F.max(F.struct("h", "g")).alias("x")).collect()}
    chosen = F.lit(False)
    for lang, x in sorted(last.items()):
        chosen = chosen | (F.col("lang") == lang) & ((F.col("h") < x["h"]) | (F.col("h") == x["h"]) & (F.col("g") <= x["g"]))
    # Rows that repeat a doc_id and a text are beyond the rank and go before anything is collected.
    again = F.row_number().over(Window.partitionBy("lang").orderBy("h", "ids", "tf"))
    found = hashed.where(chosen).select("h", "doc_id", "lang", "text").mapInPandas(sparse, "h long, doc_id long, lang string, ids binary, tf binary").withColumn("n", again).where(F.col("n") <= sample)
    rows = sorted(found.collect(), key=lambda r: (r["h"], r["lang"], r["ids"], r["tf"]))
    classes, data = sorted(last), []
    for r in rows:
        ids = np.frombuffer(r["ids"], np.int32)
        if len(ids):
            data.append((ids, np.frombuffer(r["tf"], np.float32) * idf[ids], classes.index(r["lang"])))
    ftrl = Ftrl(classes)
    kept = data[::5] if len(data) >= 50 else []
    used = [x for i, x in enumerate(data) if i % 5] if kept else data
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            ftrl.learn(*used[i])
    w = ftrl.weights(slice(None))
    temp = temperature(np.array([x @ w[ids] for ids, x, _ in kept]), np.array([y for *_, y in kept])) if kept else 1.0
    return Model(classes, idf[:, None] * w, temp)


def held_out(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n == 0


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score): score is the calibrated probability; `und`, 0 for texts without letters or no model.

    Null and empty texts have no letters. Repeated rows give repeated results, an empty table none; only doc_id and
    text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _batches(pdf):
                texts = part["text"].fillna("").tolist()
                lang, score = shared.value.predict(texts) if shared.value else (["und"] * len(texts), np.zeros(len(texts)))
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": lang, "score": score})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language a model learnt from the table's own labels names with a probability of `least` or more.

    Null and empty texts and those without letters go; whole texts are read, however long. Without labels there is no
    model, and all rows with letters stay. Repeated rows stay or go alike, of two equally likely languages the first by
    name counts, an empty table stays empty, and other columns pass through, whatever their names.
    """
    model = fit(docs.where(F.col("lang").isNotNull() & ~held_out(5)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def named(text: pd.Series) -> pd.Series:
        out = []
        for part in _batches(pd.DataFrame({"text": text})):
            texts = part["text"].fillna("").tolist()
            if shared.value is None:
                out += [any(c.isalpha() for c in t) for t in texts]
            else:
                lang, score = shared.value.predict(texts)
                out += [x != "und" and s >= least for x, s in zip(lang, score, strict=True)]
        return pd.Series(out, dtype=bool)

    return docs.where(named("text"))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents, learnt from the labelled ones that are not held out.

    Whole texts are read, in pieces of about a million characters at a time where rows allow. Equally likely languages:
    the first by name. Nulls, repeated rows and empty tables as in `identify`.
    """
    model = fit(docs.where(F.col("lang").isNotNull() & ~held_out(5)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score")
