"""Benchmark decontamination: a BM25 index of test items, asked by every training passage with block-max WAND."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: ASCII letters and digits, lowered before; other ASCII to spaces; bytes of other characters stay.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
K1, B = 1.2, 0.75
#: Items in a block.
BLOCK = 8
SHINGLE = 3


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The item's words before and after its last line break, else its last sentence end, else its last quarter."""
    body = text.strip()
    at = body.rfind("\n")
    if at < 0:
        at = max((m.end() for m in re.finditer(r"[.?!:]\s+", body)), default=-1)
    if at >= 0:
        q, a = words(body[:at]), words(body[at:])
        if q and a:
            return q, a
    w = words(body)
    cut = max(1, len(w) - max(1, len(w) // 4)) if len(w) > 1 else 0
    return (w[:cut], w[cut:]) if cut else (w, w)


def coverage(part: list[bytes], shingles: set[tuple], n: int) -> float:
    """Share of the part's words inside one of its n-word shingles that the passage has too."""
    hit = np.zeros(len(part), bool)
    for i in range(len(part) - n + 1):
        if tuple(part[i : i + n]) in shingles:
            hit[i : i + n] = True
    return float(hit.mean()) if len(part) else 0.0


class Index:
    """Postings by term and block of items, with BM25 impacts over each item's own total (so a score is a share of the item).

    A block is BLOCK items in a row; block maxima bound what a term gives to any of them.
    """

    def __init__(self, items: list[tuple[int, str | None]], dense: int = 16_000_000):
        parsed = [(i, words(t), t) for i, t in items if words(t)]
        self.ids = [i for i, _, _ in parsed]
        self.parts = [question_answer(t) for _, _, t in parsed]
        self.stride = max([64, *(len(w) for _, w, _ in parsed)])
        tf = [Counter(w) for _, w, _ in parsed]
        df = Counter(t for c in tf for t in c)
        n, avg = len(parsed), np.mean([len(w) for _, w, _ in parsed]) if parsed else 1.0
        idf = {t: np.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
        self.terms = {t: k for k, t in enumerate(df)}
        self.post: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for d, (c, (_, w, _)) in enumerate(zip(tf, parsed, strict=True)):
            norm = K1 * (1 - B + B * len(w) / avg)
            imp = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            own = sum(imp.values())
            for t, x in imp.items():
                self.post[self.terms[t], d // BLOCK].append((d, float(x / own)))
        self.blocks = -(-n // BLOCK)
        maxima = {k: max(x for _, x in v) for k, v in self.post.items()}
        self.table = self.at = None
        if len(self.terms) * self.blocks <= dense:
            self.table = np.zeros((len(self.terms) + 1, self.blocks), np.float32)  # the last row: any other word
            for (t, b), x in maxima.items():
                self.table[t, b] = x
        else:
            keys = sorted(maxima)
            self.at = np.searchsorted([t for t, _ in keys], np.arange(len(self.terms) + 1))
            self.block_of, self.max_of = np.array([b for _, b in keys]), np.array([maxima[k] for k in keys])

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """Of each block, the most that one of its items can score over these different terms."""
        if self.table is not None:
            return self.table[terms].sum(axis=0)
        runs = [slice(self.at[t], self.at[t + 1]) for t in terms]
        if not runs:
            return np.zeros(self.blocks)
        return np.bincount(np.concatenate([self.block_of[r] for r in runs]), np.concatenate([self.max_of[r] for r in runs]), self.blocks)

    def hopeful(self, ids: np.ndarray, threshold: float) -> np.ndarray:
        """Of the passage at each stride, whether some block may reach the threshold; repeated words count again, so none is missed."""
        starts = np.arange(0, len(ids), self.stride)
        if self.table is None or not len(ids):
            return np.ones(max(1, len(starts)), bool)
        part = np.add.reduceat(self.table[ids], starts, axis=0)
        part[:-1] += part[1:]
        return (part >= threshold - 1e-4).any(axis=1)

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of every item whose score over these different terms is at least the threshold.

        Block-max WAND: blocks whose maxima don't reach the threshold are skipped. In the others terms go by falling
        maximum; the pivot is the last term from which the maxima left still reach the threshold, and an item that
        no term up to the pivot holds is not scored.
        """
        found = []
        for b in np.flatnonzero(self.bounds(terms) >= threshold - 1e-5).tolist():
            lists = sorted(((max(x for _, x in p), p) for t in terms.tolist() if (p := self.post.get((t, b)))), key=lambda x: -x[0])
            left = sum(m for m, _ in lists)
            score: dict[int, float] = {}
            for m, postings in lists:
                before_pivot = left >= threshold - 1e-9
                for d, x in postings:
                    if d in score:
                        score[d] += x
                    elif before_pivot:
                        score[d] = x
                left -= m
            found += [(d, s) for d, s in sorted(score.items()) if s >= threshold - 1e-9]
        return found


def segments(text: str, chars: int = 1_000_000) -> Iterator[str]:
    """The text in runs of about so many characters, cut at white space, so that a long text is not held as words at once."""
    at = 0
    while at < len(text):
        end = at + chars
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def passages(text: str | None, stride: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of words that start at a multiple of the stride, each continued far enough to hold every passage of 2 * stride
    words that starts in it; successive runs share `stride` words."""
    carry: list[bytes] = []
    first = 0
    pieces = list(segments(text or "")) or [""]
    for i, piece in enumerate(pieces):
        run = carry + words(piece)
        yield first, run
        if i + 1 < len(pieces):
            keep = max(0, (len(run) - 2 * stride) // stride + 1) * stride
            carry = run[keep:]
            first += keep


def matches(text: str | None, index: Index, retrieve: float, question: float, answer: float) -> dict[int, tuple[float, float, float, int]]:
    """Of each item that the text gives away: score, question and answer overlap, and the word where the best passage starts."""
    out: dict[int, tuple[float, float, float, int]] = {}
    step, unknown = index.stride, len(index.terms)
    get, seen = index.terms.get, np.zeros(unknown + 1, bool)
    for first, run in passages(text, step):
        ids = np.fromiter((get(w, unknown) for w in run), np.int32, len(run))
        for s in (np.flatnonzero(index.hopeful(ids, retrieve)) * step).tolist():
            e = s + 2 * step
            seen.fill(False)
            seen[ids[s:e]] = True
            got = index.search(np.flatnonzero(seen[:unknown]), retrieve)
            if not got:
                continue
            part = run[s:e]
            shingles: dict[int, set] = {}
            for item, score in got:
                overlap = []
                for p in index.parts[item]:
                    n = min(SHINGLE, len(p))
                    if n not in shingles:
                        shingles[n] = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
                    overlap.append(coverage(p, shingles[n], n))
                if overlap[0] >= question and overlap[1] >= answer:
                    row = (score, *overlap, first + s)
                    if index.ids[item] not in out or row[:3] > out[index.ids[item]][:3]:
                        out[index.ids[item]] = row
    return out


def _blocks(items: DataFrame, block: int, most: int = 32_000_000) -> tuple[int, Iterator[Index]]:
    """How many indexes, and they one by one: of `block` items and `most` bytes each, about. Items go by length, so that a long one sets the
    passages of its own block only."""
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    all_ = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = max(1, -(-all_["n"] // block), -(-all_["b"] // most))
    edges = tests.select(F.octet_length("text").alias("l")).approxQuantile("l", [i / n for i in range(1, n)], 0.001) if n > 1 else []
    size = F.octet_length("text").cast("double")
    place = sum((F.when(size > e, 1).otherwise(0) for e in edges), F.lit(0))
    # Many items of one length stay together at an edge: they are dealt further by hash.
    held = {r["p"]: max(1, -(-r["n"] // block), -(-r["b"] // most)) for r in tests.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()} if n > 1 else {0: 1}

    def made() -> Iterator[Index]:
        for b, parts in sorted(held.items()):
            for p in range(parts):
                rows = tests.where((place == b) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)).orderBy("item_id", "text").collect()
                yield Index([(r["item_id"], r["text"]) for r in rows])

    return sum(held.values()), made()


def keep_clean(docs: DataFrame, items: DataFrame, retrieve: float = 0.6, question: float = 0.6, answer: float = 0.6, block: int = 20_000) -> DataFrame:
    """The rows of `docs` that give no item away, as `contaminated` finds them."""

    def clean(shared):  # noqa: ANN001, ANN202
        @F.pandas_udf("boolean")
        def test(text: pd.Series) -> pd.Series:
            return pd.Series([not shared.value.ids or not matches(t, shared.value, retrieve, question, answer) for t in text], dtype=bool)

        return test("text")

    n, indexes = _blocks(items, block)
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(clean(shared))
        if n > 1:
            docs = materialize(docs, "decontam-kept")
            shared.destroy()
    return docs


def contaminated(docs: DataFrame, items: DataFrame, retrieve: float = 0.6, question: float = 0.6, answer: float = 0.6, block: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, word): items (item_id, text) that documents (doc_id, text) give away.

    Passages are windows of twice the longest item (64 words at least), half overlapping, over the whole text. score is
    the share of the item's BM25 weight found in the passage; every item of `retrieve` or more is retrieved and
    kept if shared three-word shingles cover that share of its question and of its answer. A document that holds no item has
    no row. Items and documents that are null, empty or wordless match nothing. Repeated documents give repeated
    rows, an item_id that repeats its best match. Empty tables give no rows; other columns are ignored.

    The index goes out by broadcast in blocks of `block` items of like length, a pass over the documents each, one written before the next is made.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word long"
    out = None
    n, indexes = _blocks(items, block)
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = [(d, i, *m) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, m in matches(t, shared.value, retrieve, question, answer).items()] if shared.value.ids else []
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word"])

        part = src.mapInPandas(run, schema)
        if n > 1:
            part = materialize(part, "decontam-found")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
