"""Toxicity: class-conditional Kneser-Ney models of words, by themselves and after the word before, with shared backoff counts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .langid import held_out

#: ASCII letters lowered, other ASCII but digits to spaces; bytes of other characters stay.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: A word backs off to its first bytes.
PREFIX = 5
#: A count that exceeds the expected e by no more than Z * (sqrt(e) + 1) is left to the shared counts.
Z = 3.0
#: The same for words after words, of which there are many more to be surprised by.
Z_AFTER = 5.0
#: Different labelled texts of a class from which on copies count once and a fifth of the texts calibrates.
ENOUGH = 20


def line(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def words(text: str | None) -> set[bytes]:
    """The text's different words: a repeated line says a thing once."""
    return set(line(text))


def after(w: list[bytes]) -> set[tuple[bytes, bytes]]:
    """The different words with the word before each."""
    return set(zip(w, w[1:], strict=False))


class Ratios:
    """Log-likelihood ratios, toxic to ordinary: of known words, of known prefixes (for other words), of all the rest."""

    def __init__(self, known: dict[bytes, float], prefixes: dict[bytes, float], rest: float):
        self.known, self.prefixes, self.rest = known, prefixes, rest

    def mean(self, text: str | None) -> tuple[float, int]:
        """The length-normalised difference of the two log-likelihoods, and the length in different words."""
        return self.mean_of(words(text))

    def mean_of(self, w: set[bytes]) -> tuple[float, int]:
        own = w & self.known.keys()
        by_prefix = [x[:PREFIX] for x in w if x[:PREFIX] in self.prefixes]
        total = self.rest * (len(w) - len(by_prefix)) + sum(self.prefixes[x] for x in by_prefix)
        total += sum(self.known[x] - self.prefixes.get(x[:PREFIX], self.rest) for x in sorted(own))
        return total / max(1, len(w)), len(w)


class Histories:
    """Log-likelihood ratios of words after a word: of those that say something, and of all others after the same word."""

    def __init__(self, told: dict[bytes, tuple[float, dict[bytes, float]]]):
        self.told = told

    def mean_of(self, pairs: set[tuple[bytes, bytes]]) -> tuple[float, int]:
        found = (self.told[h][1].get(w, self.told[h][0]) for h, w in pairs if h in self.told)
        # Rounded once, so that the order of a set is not seen.
        return math.fsum(found) / max(1, len(pairs)), len(pairs)


def histories(rows: list[tuple[bytes, bytes, float, float, float, float, float]]) -> Histories:
    """Ratios from rows (history, word, kept share of each class, backed-off mass of each class after it, share of the word in continuations).

    p_c(w | h) = kept_c(h w) / N_c(h) + lambda_c(h) * s(w), where s(w) is the share of w in the different pairs of both classes.
    """
    told: dict[bytes, tuple[float, dict[bytes, float]]] = {}
    for h, w, k0, k1, l0, l1, s in rows:
        told.setdefault(h, (math.log(l1 / l0), {}))[1][w] = math.log((k1 + l1 * s) / (k0 + l0 * s))
    return Histories(told)


def discounted(c: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept counts over class totals, the backed-off mass of each class, and shared probabilities, for counts c of two classes.

    Absolute discounting as in Kneser-Ney, with the discount D = e + Z * sqrt(e) + Z growing with the count e
    that the shared model expects: a rare expression has no weight but its shared backoff.
    """
    s = c.sum(axis=1) / max(1.0, total.sum())
    e = s[:, None] * total
    kept = np.maximum(c - e - Z * np.sqrt(e) - Z, 0) / np.maximum(total, 1)
    return kept, np.maximum(1 - kept.sum(axis=0), 1e-6), s


def kneser_ney(counts: pd.DataFrame, types: pd.DataFrame, total: np.ndarray, type_total: np.ndarray) -> Ratios:
    """Ratios from word counts and prefix counts (columns w, c0, c1; class 1 is toxic).

    p_c(w) = kept_c(w) / N_c + lambda_c * s(w) * q_c(prefix) / r(prefix)
    q_c(prefix) = kept_c(prefix) / T_c + mu_c * r(prefix)

    Word counts are of documents, prefix counts of different words (continuation counts). s and r are the shared
    backoff: the counts of both classes together. Rows whose counts are all within the discount may be left out.
    """
    kept, mu, r = discounted(types[["c0", "c1"]].to_numpy(float), type_total)
    q = kept / np.maximum(r, 1e-12)[:, None] + mu
    prefixes = {w: q[i] for i, w in enumerate(types["w"]) if kept[i].any()}
    kept, lam, s = discounted(counts[["c0", "c1"]].to_numpy(float), total)
    known = {}
    for i, w in enumerate(counts["w"]):
        if kept[i].any():
            p = kept[i] + lam * s[i] * prefixes.get(w[:PREFIX], mu)
            known[w] = float(np.log(p[1] / p[0]))
    log = lambda x: float(np.log(lam[1] * x[1] / (lam[0] * x[0])))
    return Ratios(known, {w: log(x) for w, x in prefixes.items()}, log(mu))


def evidence(mean: np.ndarray, n: np.ndarray, rest: float, mean2: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """What the score depends on: the normalised differences, of words beyond that of plain words and of words after words, and their weights by length."""
    return np.stack([mean - rest, (mean - rest) * np.sqrt(n), mean2, mean2 * np.sqrt(n2)], axis=-1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (the last is the intercept) and scales of a logistic regression, by Newton's method."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + l2 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return w, scale


class Model:
    def __init__(self, ratios: Ratios, pairs: Histories, coef: np.ndarray, scale: np.ndarray):
        self.ratios, self.pairs, self.coef, self.scale = ratios, pairs, coef, scale

    def means(self, text: str | None) -> tuple[float, int, float, int]:
        w = line(text)
        return (*self.ratios.mean_of(set(w)), *self.pairs.mean_of(after(w)))

    def score(self, text: str | None) -> float:
        m, n, m2, n2 = self.means(text)
        z = float(evidence(np.array(m), np.array(n), self.ratios.rest, np.array(m2), np.array(n2)) / self.scale @ self.coef[:-1] + self.coef[-1])
        return 1 / (1 + float(np.exp(-min(max(z, -30), 30))))


def paired(sample: DataFrame) -> Histories:
    """What the word before says: pairs of one class beyond what their history's shared counts expect, by a discount as in `discounted`.

    Only such pairs, with the masses after their histories, come to the driver; they are fewer than the sample's words.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = (Counter(), Counter())
            for y, t, n in zip(pdf["y"], pdf["text"], pdf["n"], strict=True):
                for p in after(line(t)):
                    c[y][p] += n
            w = list(c[0] | c[1])
            yield pd.DataFrame({"h": [x for x, _ in w], "w": [x for _, x in w], "c0": [c[0][x] for x in w], "c1": [c[1][x] for x in w]})

    pairs = materialize(sample.mapInPandas(count, "h binary, w binary, c0 long, c1 long").groupBy("h", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "toxicity-pairs")
    of = pairs.groupBy("h").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    share = (F.col("c0") + F.col("c1")) / (F.col("n0") + F.col("n1"))
    kept = lambda i: F.greatest(F.col(f"c{i}") - share * F.col(f"n{i}") - Z_AFTER * F.sqrt(share * F.col(f"n{i}")) - Z_AFTER, F.lit(0.0)) / F.greatest(F.col(f"n{i}"), F.lit(1))
    said = materialize(pairs.join(of, "h").select("h", "w", kept(0).alias("k0"), kept(1).alias("k1")).where("k0 > 0 or k1 > 0"), "toxicity-histories")
    mass = said.groupBy("h").agg(*[F.greatest(1 - F.sum(f"k{i}"), F.lit(1e-6)).alias(f"l{i}") for i in (0, 1)])
    everything = pairs.count()
    continued = pairs.groupBy("w").agg((F.count("*") / F.lit(float(max(1, everything)))).alias("s"))
    rows = said.join(mass, "h").join(continued, "w").select("h", "w", "k0", "k1", "l0", "l1", "s").collect()
    return histories([(bytes(r["h"]), bytes(r["w"]), r["k0"], r["k1"], r["l0"], r["l1"], r["s"]) for r in rows])


def fit(docs: DataFrame, known: DataFrame, bound: int = 4096) -> Model | None:
    """A model from texts (doc_id, text) and labels (doc_id, toxic), a row a document; None unless both classes occur.

    The classifier is fitted on at most `bound` labels of each class (the smallest hashes of doc_id), equal texts of
    a class once; a fifth of each class's texts calibrate the score, with the weight of words after words, and give no counts. A class of
    fewer than ENOUGH different texts tells too little for that: then copies count each, and all texts both count and calibrate. Calibration weighs
    the classes as all labels have them. Rows are chosen among the labels, so that only the chosen documents' texts move.
    """
    spark = docs.sparkSession
    ids = known.select(F.xxhash64("doc_id").alias("h"), "doc_id", "toxic")
    share = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not share.get(0) or not share.get(1):
        return None
    chosen = [r for c in (0, 1) for r in ids.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(bound).collect()]
    picked = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "_id long, y int").dropDuplicates(["_id"])
    # At most 2 * bound rows of 12 bytes.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("y", "text").agg(F.count("*").alias("n"))
    # At most `bound` rows a class.
    sample = materialize(texts.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("text"), "text"))), "toxicity-sample")
    different = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(different) < 2:  # labels of documents that aren't there
        return None
    few = min(different.values()) < ENOUGH
    sample = sample.select("y", "text", (F.col("n") if few else F.lit(1)).cast("long").alias("n"), (F.col("place") % 5 == 1).alias("calibrate"))
    counted = sample if few else sample.where("not calibrate")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = (Counter(), Counter())
            for y, t, n in zip(pdf["y"], pdf["text"], pdf["n"], strict=True):
                for x in words(t):
                    c[y][x] += n
            w = list(c[0] | c[1])
            yield pd.DataFrame({"w": w, "c0": [c[0][x] for x in w], "c1": [c[1][x] for x in w]})

    pair = ("c0", "c1")
    per_word = materialize(counted.mapInPandas(count, "w binary, c0 long, c1 long").groupBy("w").agg(*[F.sum(c).alias(c) for c in pair]), "toxicity-words")
    per_prefix = per_word.groupBy(F.substring("w", 1, PREFIX).alias("w")).agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in pair])
    both = []
    for table in (per_word, per_prefix):
        total = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in pair]).first()
        likely = table.where(F.greatest(*pair) > Z).toPandas()
        likely["w"] = [bytes(x) for x in likely["w"]]
        both.append((likely, np.array([total[c] for c in pair], float)))
    model = Model(kneser_ney(both[0][0], both[1][0], both[0][1], both[1][1]), paired(counted), np.zeros(5), np.ones(4))

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [model.means(t) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "k": pdf["n"], **{c: [g[i] for g in got] for i, c in enumerate(("m", "n", "m2", "n2"))}})

    cal = (sample if few else sample.where("calibrate")).mapInPandas(means, "y int, k long, m double, n long, m2 double, n2 long").toPandas()
    y, weight = cal["y"].to_numpy(float), cal["k"].to_numpy(float)
    for c in (0, 1):
        weight[y == c] *= share[c] / sum(share.values()) * len(y) / max(1, weight[y == c].sum())
    x = evidence(*(cal["m"].to_numpy(float), cal["n"].to_numpy(float), model.ratios.rest, cal["m2"].to_numpy(float), cal["n2"].to_numpy(float)))
    model.coef, model.scale = logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of all documents (doc_id, text), null and empty ones too (they have the score of a ratio of 0).

    Without a model every score is 0. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [shared.value.score(t) if shared.value else 0.0 for t in pdf["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; labels: (doc_id, toxic). A document with several labels
    is toxic if one says so; labels that are null or of held-out documents teach nothing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(5))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return score(docs, fit(docs, known)).select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
