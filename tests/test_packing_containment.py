"""Batches against the fold's own, greedy choices against a loop, containment against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import archive, containment, fold, packing
from turnloom.operators.greedy import greedy


def test_batches_equal_the_folds(spark):
    random.seed(11)
    rows, want = [], set()
    for s in range(40):
        n = random.choice([0, 1, 2, 5, 40, 130])
        sizes = random.choice([(1, 50), (1, 400), (300, 3000), (2000, 9000)])
        pieces = [fold.Piece(f"p{i:04d}", "s", random.choice(["user", "tool", "assistant"]), random.randint(*sizes), "h", rendered=random.random() > 0.1) for i in range(n)]
        users = [p.id for p in pieces if p.kind == "user"]
        latest = set(users[-1:])
        rows += [(f"s{s}", p.id, p.kind, p.size, p.rendered, p.id in latest) for p in pieces]
        # Tokens: the fixed part of the largest sessions alone is near the limit.
        want |= {(f"s{s}", p.id, b) for b, batch in enumerate(fold.batches(pieces, latest, 6000, 7000)) for p in batch}
    df = spark.createDataFrame(rows, "session string, id string, kind string, size long, rendered boolean, latest boolean").repartition(5)
    got = {tuple(r) for r in packing.prune_batches(df, "session", "id", 6000, 7000).select("session", "id", "batch").collect()}
    assert got == want and len({(s, b) for s, _, b in want}) > 60


def test_greedy_by_scope(spark):
    random.seed(2)
    rows = [(f"s{i % 7}", i, random.randint(0, 40)) for i in range(600)]
    got = {(r["s"], r["i"]): (r["kept"], r["used"]) for r in greedy(spark.createDataFrame(rows, "s string, i int, n int"), ["s"], [F.desc("i")], "n", F.lit(100)).collect()}
    used = {}
    for s, i, n in sorted(rows, key=lambda r: -r[1]):
        fits = used.get(s, 0) + n <= 100
        used[s] = used.get(s, 0) + n * fits
        assert got[s, i] == (fits, used[s])


@pytest.mark.parametrize("way", ["join", "automaton"])
def test_containment_equals_a_scan(spark, way):
    random.seed(5)
    words = ["alpha", "beta", "gamma", "é漢字", "x", " ", "\n", '"q"']
    texts = [(i, "".join(random.choice(words) for _ in range(random.randrange(60)))) for i in range(300)] + [(300, None), (301, ""), (None, "alpha"), (7, "a second text of seven"), (302, "ab" * 60_000)]
    needles = [(j, random.choice(texts[:300])[1][k : k + n]) for j, (k, n) in enumerate((random.randrange(20), random.choice([1, 2, 3, 4, 7, 8, 15, 16, 17, 40, 90])) for _ in range(200))]
    needles += [(900, ""), (901, None), (902, "a second text of seven"), (903, "nowhere to be found in these"), (904, "ba" * 40_000), (905, "字"), (905, "seven"), (None, "alpha")]
    t, n = spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(needles, "j long, n string")
    got = containment.contained(t, "i", "t", n, "j", "n") if way == "join" else archive.verbatim(t, n, "i", "t", "j", "n")
    want = {(i, j) for i, x in texts for j, y in needles if i is not None and j is not None and x and y and y in x}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert containment.contained(t, "i", "t", n.limit(0), "j", "n").count() == containment.contained(t.limit(0), "i", "t", n, "j", "n").count() == 0
