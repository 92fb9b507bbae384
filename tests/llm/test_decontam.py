import random

import numpy as np

from tests.llm.helpers import odd_docs
from turnloom.llm import decontam

ITEMS = "item_id long, text string, score double, word string"


def made(r, n, vocab=400):
    return " ".join(f"w{int(vocab * r.random() ** 3)}" for _ in range(n))


def brute(index, terms, threshold):
    score = [0.0] * len(index.ids)
    for (t, _), p in index.post.items():
        for d, x in p if t in terms else ():
            score[d] += x
    return {d for d, s in enumerate(score) if s >= threshold - 1e-9}


def test_wand_finds_what_an_exhaustive_scan_finds():
    r = random.Random(7)
    items = [(i, made(r, r.randint(3, 40))) for i in range(300)]
    for index in (decontam.Index(items), decontam.Index(items, dense=0)):
        for _ in range(200):
            terms = np.array(sorted({r.randrange(len(index.terms)) for _ in range(r.randint(1, 80))}))
            for threshold in (0.15, 0.3, 0.6):
                assert {d for d, _ in index.search(terms, threshold)} == brute(index, set(terms.tolist()), threshold)
        for d in range(300):
            terms = np.array(sorted({t for (t, _), p in index.post.items() if d in dict(p)}))
            assert d in {x for x, _ in index.search(terms, 0.99)}


def test_plants_found_and_clean_left(spark):
    r = random.Random(1)
    items = [(i, f"{made(r, 30, 4000)}?\n{made(r, 6, 4000)}") for i in range(40)] + [(40, None), (41, ""), (42, "..."), (3, "again the same item id here")]
    docs, want = [], set()
    for d in range(300):
        w = made(r, r.randint(0, 600), 4000)
        if d % 10 == 0:
            t = items[d // 10][1]
            cut = r.randint(0, len(w))
            w = w[:cut] + " " + (t.upper() if d % 20 else t.replace(" ", "  ")) + " " + w[cut:]
            want.add((d, d // 10))
        if d % 10 == 5:  # the question alone is no leak
            w += " " + items[d // 10][1].split("\n")[0]
        docs.append((100 + d, w))
    got = decontam.contaminated(odd_docs(spark).unionByName(odd_docs(spark, docs)), spark.createDataFrame([(*i, None, None) for i in items], ITEMS))
    assert {(x["doc_id"] - 100, x["item_id"]) for x in got.collect()} == want
    assert decontam.contaminated(odd_docs(spark, docs), spark.createDataFrame([], ITEMS)).count() == 0
    assert decontam.contaminated(odd_docs(spark, []), spark.createDataFrame([(1, "a b c", None, None)], ITEMS)).count() == 0


def test_long_texts_are_read_whole(monkeypatch):
    r = random.Random(2)
    item = f"{made(r, 30, 4000)}? {made(r, 8, 4000)}"
    index = decontam.Index([(1, item)])
    monkeypatch.setattr(decontam.segments, "__defaults__", (500,))
    for at in range(0, 3000, 97):
        text = made(r, at, 4000) + " " + item + " " + made(r, 900, 4000)
        assert set(decontam.matches(text, index, 0.5, 0.6, 0.6)) == {1}


def test_blocks_of_items_find_the_same(spark):
    """Blocks of a few items of like length, one after another, find what one index finds."""
    import random

    random.seed(4)
    vocabulary = [f"term{i}" for i in range(400)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.choice([8, 8, 8, 20, 60]))) + "?") for i in range(60)]
    docs = []
    for i in range(80):
        w = [random.choice(vocabulary) for _ in range(random.choice([5, 200, 900]))]
        if i % 3 == 0:
            w[2:2] = items[i % 60][1].split()
        docs.append((i, " ".join(w)))
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda **k: {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, t, **k).collect()}
    planted = {(i, i % 60) for i in range(0, 80, 3)}
    assert planted <= found(block=7) and planted <= found() and {x[0] for x in found(block=7)} == {x[0] for x in found()} == {x[0] for x in planted}
    assert {r["doc_id"] for r in decontam.keep_clean(d, t, block=7).collect()} == {r["doc_id"] for r in decontam.keep_clean(d, t).collect()} == set(range(80)) - set(range(0, 80, 3))
