import numpy as np

from tests.llm.helpers import SCHEMA, odd_docs
from turnloom.llm import toxicity

LABELS = "doc_id long, quality int, toxic int, text string, score double"


def corpus(n=900):
    rng = np.random.default_rng(4)
    plain, bad = [f"w{i}x" for i in range(600)], ["vilea", "vileb", "vilec", "rotten", "vilest", "viled"]
    out = []
    for i in range(n):
        w = list(rng.choice(plain, rng.integers(20, 200), p=np.arange(600, 0, -1) / np.arange(601).sum()))
        toxic = int(i % 6 == 0)
        for _ in range(toxic * max(1, len(w) // 30)):
            w.insert(rng.integers(0, len(w)), rng.choice(bad))
        out.append((i, " ".join(w), toxic))
    return out


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None, None, None, None, None, None) for d, t, _ in rows], SCHEMA)


def test_held_out_accuracy(spark):
    rows = corpus()
    labels = spark.createDataFrame([(d, 1, y, "x", 0.0) for d, _, y in rows] + [(None, 1, 1, None, None), (5, 1, None, None, None)], LABELS)
    got = toxicity.toxicity(table(spark, rows), labels).collect()
    want = {d: y for d, _, y in rows}
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    rows = corpus(300)
    labels = spark.createDataFrame([(1000 + d, 1, y, None, None) for d, _, y in rows], LABELS)
    docs = odd_docs(spark).unionByName(table(spark, [(1000 + d, t, y) for d, t, y in rows]))
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count()
    assert {r["predicted"] for r in got.where("doc_id in (1, 2, 3)").collect()} == {0}
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_rare_words_have_no_weight():
    import pandas as pd

    counts = pd.DataFrame({"w": [b"common", b"vile", b"rare"], "c0": [900, 0, 4], "c1": [100, 60, 0]})
    r = toxicity.kneser_ney(counts, counts.head(0), np.array([5000.0, 500.0]), np.array([100.0, 20.0]))
    assert set(r.known) == {b"vile"} and r.known[b"vile"] > 1 and abs(r.rest) < 0.2


def test_as_plain_python_on_fifty_texts():
    """Ratios of the class models against the formulas worked out word by word."""
    import pandas as pd

    rng = np.random.default_rng(9)
    texts = [" ".join([*(f"p{k}lain" for k in rng.integers(0, 300, 14)), *(["vilea", "vileb"] if i % 5 == 0 else [])]) for i in range(50)]
    docs = {}
    for i, t in enumerate(texts):
        for w in set(t.split()):
            docs.setdefault(w.encode(), [0, 0])[int(i % 5 == 0)] += 1
    kinds = {}
    for w, c in docs.items():
        k = kinds.setdefault(w[: toxicity.PREFIX], [0, 0])
        k[0] += c[0] > 0
        k[1] += c[1] > 0
    frame = lambda d: pd.DataFrame({"w": list(d), "c0": [c[0] for c in d.values()], "c1": [c[1] for c in d.values()]})
    n, m = ([sum(c[i] for c in d.values()) for i in (0, 1)] for d in (docs, kinds))
    got = toxicity.kneser_ney(frame(docs), frame(kinds), np.array(n, float), np.array(m, float))

    def kept(c, total, everything):
        e = [c[0] + c[1] and (c[0] + c[1]) / everything * t for t in total]
        return [max(x - y - toxicity.Z * y**0.5 - toxicity.Z, 0) / t for x, y, t in zip(c, e, total, strict=True)]

    mass = lambda d, total: [1 - sum(kept(c, total, sum(total))[i] for c in d.values()) for i in (0, 1)]
    lam, mu = mass(docs, n), mass(kinds, m)

    def ratio(w):
        k = kinds.get(w[: toxicity.PREFIX])
        share = k and sum(k) / sum(m)
        q = [x / share + y for x, y in zip(kept(k, m, sum(m)), mu, strict=True)] if k else mu
        c = docs.get(w, [0, 0])
        s = sum(c) / sum(n)
        if not any(kept(c, n, sum(n))):
            return np.log(lam[1] * q[1] / (lam[0] * q[0]))
        p = [x + y * s * z for x, y, z in zip(kept(c, n, sum(n)), lam, q, strict=True)]
        return np.log(p[1] / p[0])

    assert got.known
    for t in [*texts, "", "never seen vilest"]:
        w = {x.encode() for x in t.split()}
        want = sum(map(ratio, w)) / max(1, len(w))
        assert abs(got.mean(t)[0] - want) < 1e-9 and got.mean(t)[1] == len(w)


def test_long_texts_and_ties(spark):
    rows = corpus(300)
    labels = spark.createDataFrame([(d, 1, y, None, None) for d, _, y in rows], LABELS)
    docs = table(spark, [*rows, (5000, "w1x w2x " * 150_000, 0), (5001, "w2x w1x", 0), (5002, "w1x w2x", 0)])
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert got[5000] == got[5001] == got[5002]


def test_phrases_and_many_copies(spark):
    """Sixty copies of a toxic text whose words are all in four hundred copies of a clean one: the word before tells them apart."""
    rows = [(i, "kill all of them" if i < 60 else "kill time with all of them", int(i < 60)) for i in range(460)]
    labels = spark.createDataFrame([(d, 1, y, None, None) for d, _, y in rows], LABELS)
    got = toxicity.toxicity(table(spark, rows), labels).collect()
    assert {r["doc_id"] < 60: r["predicted"] for r in got} == {True: 1, False: 0}
    assert all((r["predicted"] == 1) == (r["doc_id"] < 60) for r in got)


def test_phrases_of_plain_words(spark):
    """Texts of the same words at random, of which the toxic ones hold a phrase: its weight is learnt from held-out labels."""
    rng = np.random.default_rng(6)
    plain = [f"w{i}x" for i in range(60)]
    rows = []
    for i in range(900):
        w = list(rng.choice(plain, rng.integers(10, 40)))
        w[3:3] = ["w5x", "w9x", "w7x"] if i % 5 == 0 else ["w9x", "w1x", "w5x", "w2x", "w7x"]
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    labels = spark.createDataFrame([(d, 1, y, None, None) for d, _, y in rows], LABELS)
    held = [r for r in toxicity.toxicity(table(spark, rows), labels).collect() if r["held_out"]]
    right = [r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]
    assert np.mean(right) > 0.93 and np.mean([x for x, r in zip(right, held, strict=True) if r["doc_id"] % 5 == 0]) > 0.8


def test_one_toxic_text(spark):
    rows = [(i, f"some plain words number w{i % 50}x and more" if i else "vile", int(i == 0)) for i in range(1, 300)] + [(1000 + i, "vile things said", 1) for i in range(9)]
    labels = spark.createDataFrame([(d, 1, y, None, None) for d, _, y in rows], LABELS)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table(spark, rows), labels).collect()}
    assert len(set(got.values())) > 1 and min(got[1000 + i] for i in range(9)) > max(v for d, v in got.items() if d < 1000)
