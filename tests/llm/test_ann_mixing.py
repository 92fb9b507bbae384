import numpy as np

from tests.llm.helpers import ODD, SCHEMA, odd_docs
from turnloom.llm import ann, mixing


def vec_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, rank int")


def brute(rows, k, every):
    ok = [(i, np.array(e, np.float32)) for i, e, *_ in rows if e is not None and None not in e and np.isfinite(e).all() and any(e) and len(e) == len(rows[0][1])]
    out = {}
    for i, x in {i: x for i, x in ok if i % every == 0}.items():
        d = sorted((float(np.sqrt(((x.astype(float) - y) ** 2).sum())), j) for j, y in ok if j != i)
        out[i] = d[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 64))
    rows = [(i, [float(v) for v in (centres[i % 12] + rng.standard_normal(64)).astype(np.float32)], 0, None, None) for i in range(3000)]
    hot = rows[5][1]
    rows += [(3000 + i, hot, 0, None, None) for i in range(1200)]
    rows += [(9000, None, 0, None, None), (9100, [0.0] * 64, 0, None, None), (9200, [float("nan")] * 64, 0, None, None), (9300, [None] + [1.0] * 63, 0, None, None), (9400, [1.0], 0, None, None)]
    got = {}
    for r in ann.nearest(vec_table(spark, rows).repartition(5)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = brute(rows, 10, 100)
    assert set(got) == set(want)  # 9400 is alone with its length
    hits = 0
    for q, near in want.items():
        assert sorted(got[q]) == list(range(1, 11))
        hits += len(set(near) & set(got[q].values()))
        assert [got[q][r] for r in range(1, 11)] == sorted(got[q].values())
    assert hits / (10 * len(want)) >= 0.98


def test_packed_products_are_near_the_exact_ones():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((500, 100)), rng.standard_normal((20, 100))
    rot = ann.Rotation(np.zeros(100))
    packed, norm, ip = rot.encode(x)
    code = np.ascontiguousarray(packed).view(np.uint64)
    ask = rot.asked(q)
    got = ask.products(slice(0, 20), code, np.bitwise_count(code).sum(axis=1)) / ip
    want = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    err = np.sqrt((1 - ip * ip) / (ip * ip) / (rot.bits - 1) + ask.step[:, None] ** 2 / (3 * ip * ip))
    assert (np.abs(got - want) < 3 * err).mean() > 0.99 and np.abs(got - want).mean() < 0.15


def test_double_precision_and_lengths(spark):
    rows = [(0, [1.0, 1e-9, 0.0]), (1, [1.0, 3e-9, 0.0]), (2, [1.0, 2e-9, 0.0]), (3, [1e300, 0.0, 0.0]), (4, [1e-200, 0.0, 0.0]), (100, [1.0, 2.0]), (5, [2.0, 2.0]), (200, [])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [2, 1, 4, 3]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 100] == [(5, 1.0)]
    assert abs(got[0]["score"] - 1e-9) < 1e-18 and len(got) == 5


def test_few_and_none(spark):
    assert ann.nearest(vec_table(spark, [])).count() == 0
    assert ann.nearest(vec_table(spark, [(1, [1.0, 2.0], 0, None, None)])).count() == 0
    got = ann.nearest(vec_table(spark, [(0, [1.0, 2.0], 0, None, None), (3, [1.0, 2.0], 0, None, None), (2, [1.0, 2.0], 0, None, None), (2, [1.0, 3.0], 0, None, None)])).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 0.0), (2, 3, 0.0), (3, 2, 1.0)]


def test_mix(spark):
    rows = [(d, t, None, "abc"[i % 3] if i % 5 else None, None, None, None, None, None, None) for i, (d, t) in enumerate(ODD + [(100 + i, "w " * (i % 700)) for i in range(300)])]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_documents(docs).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert all((r["taken"] > 0) == (r["first_slot"] is not None) and (r["first_slot"] or 0) <= (r["last_slot"] or 0) for r in out)
    by = {}
    for r in out:
        t = by.setdefault((r["source_size"], r["target"]), [0, 0])
        t[0] += r["taken"]
        t[1] += r["size"]
    for (size, target), (taken, total) in by.items():
        assert total == size and abs(taken - target) <= 3 * 32 and target <= 2 * size
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_documents(docs.repartition(7)).collect()))


def test_a_long_text_and_repeated_rows_are_mixed(spark):
    rows = [(1, "w " * 600_000, "a"), (2, "x y", "a"), (2, "x y", "a"), (3, "z " * 1000, "b")]
    out = {}
    for r in mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        out.setdefault(r["doc_id"], []).append(r["taken"])
    assert len(out[2]) == 2 and abs(sum(sum(x) for x in out.values()) - 1.5 * 601_004) <= 100


def test_mix_degenerate(spark):
    assert mixing.mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = mixing.mix_documents(odd_docs(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_schedule_interleaves(spark):
    """Every stretch of the schedule holds each source in near its share."""
    n, share = 5000, (0.5, 0.31, 0.19)
    edges = [0] + [int(2**31 * sum(share[: i + 1])) for i in range(3)]
    src = spark.createDataFrame([(s, edges[s], edges[s + 1]) for s in range(3)], "s int, lo long, hi long")
    got = sorted((r["i"], r["s"], r["k"]) for r in mixing.schedule(src, n).collect())
    assert [i for i, _, _ in got] == list(range(n))
    for s in range(3):
        assert [k for _, x, k in got if x == s] == list(range(sum(x == s for _, x, _ in got)))
        so_far = np.cumsum([x == s for _, x, _ in got]) - share[s] * np.arange(1, n + 1)
        # The error of a stretch is the difference of two prefixes' errors.
        assert so_far.max() - so_far.min() < 6
