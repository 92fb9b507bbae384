import zlib

import numpy as np

from tests.llm.helpers import SCHEMA, odd_docs
from turnloom.llm import langid

WORDS = {"en": "the and of that with thing over", "de": "der und die nicht schule über groß", "fr": "le et la que pour être garçon"}


def corpus(n=400):
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(rng.choice(WORDS[lang].split(), 30)), lang))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, x, None, None, None, None, None, None, None) for d, t, x in rows], SCHEMA)
    got = langid.languages(docs).collect()
    want = {d: x for d, _, x in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in want if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.98
    assert np.mean([r["score"] for r in held]) > 0.8


def test_odd_rows(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(500 + d, t, x, None, None, None, None, None, None, None) for d, t, x in corpus(60)], SCHEMA))
    got = langid.languages(docs)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == docs.count()
    assert all(rows[i]["lang_pred"] == "und" for i in (1, 2, 3, 11)) and rows[4]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert langid.languages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["lang_pred"] for r in langid.languages(odd_docs(spark)).collect()} == {"und"}


def test_prediction_does_not_depend_on_neighbours():
    model = langid.Model(["a", "b"], np.random.default_rng(0).standard_normal((langid.BUCKETS, 2)), 1.0)
    texts = ["hello there", "", "été ß", "x", "a  b   c!!", "z" * 50]
    both = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert both[0] == [a[0][0] for a in alone]
    assert np.allclose(both[1], [a[1][0] for a in alone])


def test_no_letter_in_any_plane():
    model = langid.Model(["a", "b"], np.random.default_rng(0).standard_normal((langid.BUCKETS, 2)), 1.0)
    lang, score = model.predict(["😀😀😀", "123 😀", "𐐷𐑊", "x😀"])
    assert lang[:2] == ["und", "und"] and list(score[:2]) == [0, 0] and "und" not in lang[2:]


def plain_ftrl(rows, classes, alpha, beta, l1, l2):
    """Coordinate by coordinate."""
    z, n = {}, {}

    def weight(i, k):
        a = z.get((i, k), 0.0)
        return 0.0 if abs(a) <= l1 else -(a - np.sign(a) * l1) / ((beta + n.get((i, k), 0.0) ** 0.5) / alpha + l2)

    for ids, x, y in rows:
        logit = [sum(v * weight(i, k) for i, v in zip(ids, x, strict=True)) for k in range(classes)]
        e = np.exp(np.array(logit) - max(logit))
        p = e / e.sum()
        w = {(i, k): weight(i, k) for i in ids for k in range(classes)}
        for i, v in zip(ids, x, strict=True):
            for k in range(classes):
                g, old = v * (p[k] - (k == y)), n.get((i, k), 0.0)
                z[i, k] = z.get((i, k), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[i, k]
                n[i, k] = old + g * g
    return {key: weight(*key) for key in z}


def test_ftrl_as_plain_python_on_fifty_rows():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(200, 20, replace=False)), rng.random(20), int(rng.integers(0, 3))) for _ in range(50)]
    f = langid.Ftrl(["a", "b", "c"])
    for ids, x, y in rows:
        f.learn(ids, x, y)
    got, want = f.weights(slice(None)), plain_ftrl(rows, 3, f.alpha, f.beta, f.l1, f.l2)
    assert all(abs(got[i, k] - w) < 1e-9 for (i, k), w in want.items()) and (got == 0).sum() > got.size - len(want)


def test_prediction_as_plain_python():
    model = langid.Model(["a", "b"], np.random.default_rng(1).standard_normal((langid.BUCKETS, 2)), 0.7)
    for t in ("héllo wörld 12", "a", "x y z"):
        cp, start = langid.codes([t])
        ids = [int(i) for g in langid.ngrams(cp) for i in g[start[0] - 1 : start[1] - 1] if i < langid.BUCKETS]
        z = model.table[ids].astype(float).mean(axis=0) / 0.7
        p = np.exp(z) / np.exp(z).sum()
        lang, score = model.predict([t])
        assert lang == ["ab"[int(p.argmax())]] and abs(score[0] - p.max()) < 1e-6


def test_a_rare_language_keeps_its_class(spark):
    rows = corpus(900) + [(5000 + i, "zażółć gęślą jaźń nie jest", "pl") for i in range(6)]
    docs = spark.createDataFrame([(d, t, x, None, None, None, None, None, None, None) for d, t, x in rows], SCHEMA)
    model = langid.fit(docs.select("doc_id", "text", "lang"), sample=60)
    assert model.classes == ["de", "en", "fr", "pl"]


def test_ties_and_long_texts(spark):
    flat = langid.Model(["a", "b"], np.zeros((langid.BUCKETS, 2)), 1.0)
    assert flat.predict(["abc"])[0] == ["a"]
    docs = spark.createDataFrame([(1, "the and of that " * 80_000)] + [(d + 10, t) for d, t, _ in corpus(5)], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.identify(docs, flat).collect()} == {"a"}
