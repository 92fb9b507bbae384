import hashlib
import random
from collections import Counter

import numpy as np

from tests.llm.helpers import ODD, SCHEMA, odd_docs
from turnloom.llm import sufdedup


def brute(texts, length):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = bytes(b for b, x in zip(t, hit, strict=False) if not x)
        out.append((len(t), int(hit.sum()), int((hit[1:] < hit[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(n=120, length=20):
    r = random.Random(6)
    shared = ["".join(r.choice("abcd ") for _ in range(r.randint(5, 90))) for _ in range(12)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice(shared) if r.random() < 0.6 else "".join(r.choice("abcdé") for _ in range(r.randint(0, 60))))
        if i % 10 == 0:
            parts.append(r.choice("ab") * r.randint(0, 80))
        out.append((1000 + i, "".join(parts)))
    for d, t in out[::9]:
        at = r.randint(0, len(t))
        out.append((2000 + d, t[:at] + "Z" + t[at:]))
        out.append((3000 + d, t))
    return out


def check(docs, length, gram, **more):
    rows = [(d["doc_id"], (d["text"] or "").encode()) for d in docs.collect()]
    want = sorted((d or -1, *b) for (d, _), b in zip(rows, brute([t for _, t in rows], length), strict=True))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sufdedup.dedup(docs, length, gram).collect())
    assert got == want
    return got


def test_against_brute_force(spark):
    got = check(odd_docs(spark, ODD + corpus()).repartition(3), 20, 6)
    assert sum(r[2] for r in got) > 1000


def test_default_length(spark):
    r = random.Random(9)
    words = ["w%d" % i for i in range(500)]
    line = " ".join(r.choice(words) for _ in range(90))
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 300))) + (line[r.randint(0, 40) :] if i % 3 == 0 else "") + " end") for i in range(60)]
    check(odd_docs(spark, ODD + docs), 200, 32)


def test_large_groups_by_hash(spark, monkeypatch):
    """Anchors with more different contexts than a task should hold go through the shuffle, with the same result."""
    real = sufdedup.repeats
    monkeypatch.setattr(sufdedup, "repeats", lambda d, length, gram: real(d, length, gram, together=3))
    check(odd_docs(spark, corpus()), 20, 6)


def test_long_texts_in_segments(monkeypatch):
    r = random.Random(3)
    text = bytes(r.choice(b"abcdefgh") for _ in range(3000))
    whole = sufdedup.anchors(text, 40, 8)
    monkeypatch.setattr(sufdedup, "_SEGMENT", 170)
    parts = sufdedup.anchors(text, 40, 8)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_columns_find_what_equality_finds():
    rng = np.random.default_rng(0)
    group = np.sort(rng.integers(0, 6, 60))
    columns = rng.integers(97, 99, (60, 14)).astype(np.int16)
    columns[rng.integers(0, 60, 20), 0] = sufdedup.ABSENT
    columns[rng.integers(0, 60, 20), -1] = sufdedup.ABSENT
    got = sufdedup.repeated_starts(group, columns, 5)
    for i in range(60):
        for c in range(10):
            x = columns[i, c : c + 5]
            twin = any(j != i and group[j] == group[i] and (columns[j, c : c + 5] == x).all() for j in range(60))
            assert got[i, c] == (twin and sufdedup.ABSENT not in x)


def test_empty(spark):
    assert sufdedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
