import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import ODD, SCHEMA, odd_docs
from turnloom.llm import cmlm
from turnloom.llm.langid import held_out


def made(rng, n, k):
    return " ".join(f"{'abc'[k]}{int(300 * rng.random() ** 3)}" for _ in range(n))


def trained(docs, coded=200, least=3):
    counts = cmlm.materialize(cmlm.token_counts(docs), "counts")
    v = cmlm.vocabulary(counts, coded, least)
    train = cmlm.encode(docs, v).select("doc_id", "symbols")
    model = cmlm.fit(train, counts, v)
    cmlm.fit_gates(train, counts, model)
    return model


def encoded(v, texts):
    parts = [np.frombuffer(v.encoded(t)[0], v.kind).astype(np.int32) for t in texts]
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def test_base_score_and_model(spark):
    rng = np.random.default_rng(0)
    docs = odd_docs(spark, ODD + [(100 + i, made(rng, int(rng.integers(5, 200)), i % 3)) for i in range(400)])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if d is None else d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    out = cmlm.score_documents(docs, coded=200).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    known = [r for r in out if r["held_out"] and r["doc_id"] and r["doc_id"] >= 100]
    assert sum(r["score"] for r in known) > sum(r["base_score"] for r in known)
    again = {(r["doc_id"], round(r["score"], 6)) for r in cmlm.score_documents(docs, coded=200).collect()}
    assert again == {(r["doc_id"], round(r["score"], 6)) for r in out}


def test_empty(spark):
    assert cmlm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_code_gives_symbols_their_probabilities():
    counts = [50, 30, 9, 6, 5, 3, 1]
    for tree in (None, ([6], ([0, 3], ([1], [2, 4, 5])))):
        code = cmlm.Code(counts, tree)
        p = [np.prod([code.ones[n] if b else 1 - code.ones[n] for n, b in zip(*path, strict=True)]) for path in code.paths]
        assert np.allclose(p, np.array(counts) / sum(counts))


def test_mixing_is_a_probability():
    """Over all bit strings of a length, probabilities sum to 1."""
    rng = np.random.default_rng(2)
    st, z = rng.standard_normal((3, 10)).astype(np.float32), rng.standard_normal(10).astype(np.float32)
    total = sum(np.exp(cmlm.refined(st, z, np.array([x >> i & 1 for i in range(10)], np.uint8), np.array([10]), block=2)[0]) for x in range(1024))
    assert abs(total - 1) < 1e-5


def test_segments_side_by_side_are_segments_alone():
    rng = np.random.default_rng(3)
    size = np.array([5, 0, 700, 3000, 1, 64])
    n = size.sum()
    st, z, bit = rng.standard_normal((3, n)).astype(np.float32), rng.standard_normal(n).astype(np.float32), rng.integers(0, 2, n).astype(np.uint8)
    got, ends = cmlm.refined(st, z, bit, size), np.cumsum(size)
    for i, (a, b) in enumerate(zip(ends - size, ends, strict=True)):
        assert abs(got[i] - (cmlm.refined(st[:, a:b], z[a:b], bit[a:b], size[i : i + 1])[0] if b > a else 0)) < 1e-3


def plain_score(model, text):
    """The text's log probability, decision by decision, without arrays."""
    m, v = model.word, model.v
    sym, ends = encoded(v, [text])
    contexts = v.word_contexts(sym, ends)
    total, k = 0.0, len(m.counts)
    for lo in range(0, len(sym), cmlm.SEGMENT):
        delta, held, grad = [0.0] * (k + 2), 0, [0.0] * (k + 2)
        for i in range(lo, min(lo + cmlm.SEGMENT, len(sym))):
            first, n = int(m.d.first[sym[i]]), int(m.d.size[sym[i]])
            for node, bit in (divmod(x, 2) for x in m.d.step[first : first + n].tolist()):
                p, gate = float(m.ones[node]), 0
                x = [math.log(p / (1 - p))]
                for j, c in enumerate(m.counts):
                    at = int(cmlm.slots(np.array([node], np.uint32), contexts[j][i : i + 1], len(c.packed))[0])
                    seen, share = int(c.packed[at]) >> 16, (int(c.packed[at]) & 0xFFFF) / 65535
                    p = (seen * share + 8 * p) / (seen + 8)
                    q = min(max(p, 1e-6), 1 - 1e-6)
                    x.append(math.log(q / (1 - q)))
                    gate += 3**j * ((seen > 30) + (seen > 1000))
                z = sum((m.start[j, gate] + delta[j]) * x[j] for j in range(k + 1)) + delta[-1]
                p = 1 / (1 + math.exp(-min(max(z, -14), 14)))
                total += math.log(p if bit else 1 - p)
                grad = [g + (bit - p) * a for g, a in zip(grad, [*x, 1.0], strict=True)]
                held += 1
                if held == cmlm.BLOCK:
                    delta = [d + 0.5 / (cmlm.BLOCK + 64) * g for d, g in zip(delta, grad, strict=True)]
                    held, grad = 0, [0.0] * (k + 2)
    return total


@pytest.fixture(scope="module")
def pairs(spark):
    """A model of texts in which every other word is told by the one before."""
    rng = np.random.default_rng(7)
    return trained(spark.createDataFrame([(i, " ".join(f"a{x} b{x}" for x in rng.integers(0, 200, 20))) for i in range(800)], "doc_id long, text string"), coded=65_535)


def test_as_plain_python_on_fifty_texts(pairs):
    rng = np.random.default_rng(8)
    texts = ["", "b7 never seen b7"] + [" ".join(f"a{x} b{y}" for x, y in zip(rng.integers(0, 200, n), rng.integers(0, 200, n), strict=True)) for n in rng.integers(1, 200, 48)]
    sym, ends = encoded(pairs.v, texts)
    got = pairs.score(sym, ends)
    assert max(ends[0], *np.diff(ends)) > cmlm.SEGMENT
    for t, g in zip(texts, got, strict=True):
        assert abs(g - plain_score(pairs, t)) < 1e-3 * max(1, abs(g))


def test_a_run_of_texts_is_each_alone(pairs):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"a{x} b{x}" for x in rng.integers(0, 200, n)) for n in (3, 900, 1, 40)]
    sym, ends = encoded(pairs.v, texts)
    contexts = pairs.v.word_contexts(sym, ends)
    together = pairs.word.score(sym, ends, contexts)
    assert np.allclose(together, pairs.word.score(sym, ends, contexts, together=300), rtol=1e-5)
    for t, g in zip(texts, together, strict=True):
        assert abs(pairs.score(*encoded(pairs.v, [t]))[0] - g) < 1e-3


def test_contexts_tell_the_words_of_a_class_apart(spark):
    """Every other word is told by the one before, among more words than there are classes."""
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"a{x} b{x}" for x in rng.integers(0, 400, 100))) for i in range(600)], "doc_id long, text string")
    held = [r for r in cmlm.score_documents(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.65 * sum(r["base_score"] for r in held)


def test_short_texts_are_refined():
    """Weights move within the first hundred bits."""
    bit = np.random.default_rng(6).integers(0, 2, 100).astype(np.uint8)
    st = np.stack([np.where(bit, 2.0, -2.0), np.where(bit, -2.0, 2.0)]).astype(np.float32)
    z = np.zeros(100, np.float32)
    moved, still = (cmlm.refined(st, z, bit, np.array([100]), rate=r)[0] for r in (0.5, 0.0))
    assert moved > still + 5


def test_weights_are_learnt(pairs):
    assert np.abs(pairs.word.start - 1 / 3).max() > 0.1
    assert np.abs(pairs.byte.start - 1 / 4).max() > 0.01
    w = pairs.spelling([b"a7", b"zzzzzz", b"b\xc3\xa4"])
    assert (w < 0).all() and w[0] > w[1]


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(i, ("ab cd ef gh " * 3000 if i == 5 else "ab cd ef gh")) for i in range(30)] + [(99, "x" * 1_200_000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in cmlm.score_documents(docs).collect()}
    assert out[5]["n_tokens"] == 12_001 and math.isfinite(out[5]["score"]) and out[99]["n_tokens"] == 2 and math.isfinite(out[99]["score"])
    assert docs.where(held_out(10)).count() < 31


def test_context_tables_grow_with_what_was_counted():
    sizes = []
    for times in (1, 10, 100):
        v = cmlm.Vocabulary([(b"%d" % i, 40 * times) for i in range(3000)], 5)
        v.shape(np.random.default_rng(1).standard_normal((3000, cmlm.DIMS)))
        sizes.append(v.slots)
    assert sizes[0] < sizes[1] < sizes[2] <= cmlm.WORD_SLOTS
    x = np.random.default_rng(2).integers(0, 1 << 30, cmlm.STRIP).astype(np.int32)
    assert (cmlm.unpacked(cmlm.packed(x)) == x).all()


def test_tables_are_summed_in_a_tree(spark):
    """However many tasks' strips meet on a level, the tables are the same."""
    rng = np.random.default_rng(2)
    size = 2 * cmlm.STRIP
    tables = [rng.integers(0, 9, 2 * size) for _ in range(23)]
    rows = [(0, lo // (2 * cmlm.STRIP), cmlm.packed(t[lo : lo + 2 * cmlm.STRIP])) for t in tables for lo in range(0, 2 * size, 2 * cmlm.STRIP)]
    parts = spark.createDataFrame(rows, cmlm.STRIPS).repartition(23)
    want = cmlm.Counts(sum(tables)[1::2].astype(np.float32), sum(tables).reshape(-1, 2).sum(axis=1).astype(np.float32))
    for fan in (2, 5, 100):
        (got,) = cmlm._summed(parts, [size], fan)
        assert (got.packed == want.packed).all()
    big = np.array([3 * 2**31, 2**31, 5, 7])
    assert cmlm.unpacked(cmlm.packed(big)).tolist() == [3 * 2**29, 2**29, 5, 7]


def test_slopes_do_not_depend_on_texts_judged_together(pairs):
    """Each decision leaves out what it added to the counts, whatever else is in its batch."""
    rng = np.random.default_rng(12)
    parts = [encoded(pairs.v, [" ".join(f"a{x} b{x}" for x in rng.integers(0, 200, n))]) for n in (30, 1, 700, 30)]
    sym, ends = encoded(pairs.v, [" ".join(f"a{x} b{x}" for x in np.random.default_rng(13).integers(0, 200, 5))])
    parts += [(sym, ends)] * 3
    alone = sum(pairs.word.slopes(s, pairs.v.word_contexts(s, e)) for s, e in parts)
    flat = np.concatenate([s for s, _ in parts])
    together = pairs.word.slopes(flat, pairs.v.word_contexts(flat, np.cumsum([len(s) for s, _ in parts])))
    assert np.allclose(alone, together, rtol=1e-4, atol=1e-2)


def test_nodes_of_four_levels_are_numbered_together():
    code = cmlm.Code([int(1e6 / (i + 1)) for i in range(3000)])
    seen = {}
    for nodes, bits in code.paths:
        for i, node in enumerate(nodes):
            assert seen.setdefault(node, (nodes[:i], bits[:i])) == (nodes[:i], bits[:i])
            assert node // 16 == nodes[i - i % 4] // 16
    assert max(seen) < len(code.ones)


def test_texts_are_encoded_together_as_alone():
    v = cmlm.Vocabulary([(cmlm.END, 9), (b"the", 5), (b"a", 3)], 2)
    texts = ["", None, " ", " a  the\tZq\n", "x\x0bY\x0cx\r ", "the \x1ca\x85b", "zq zq ÄÖ the"]
    s, w, k = v.encoded_all(cmlm.pa.array([None, *texts], cmlm.pa.string()).slice(1))
    for i, t in enumerate(texts):
        got = np.frombuffer(s[i].as_py(), v.kind).tolist()
        own = [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [cmlm.END]
        assert got == [v.ids.get(x, v.escape) for x in own]
        assert dict(zip(w[i].as_py(), k[i].as_py(), strict=True)) == Counter(x for x in own if x not in v.ids)
        assert v.encoded(t) == (s[i].as_py(), Counter(dict(zip(w[i].as_py(), k[i].as_py(), strict=True))))
