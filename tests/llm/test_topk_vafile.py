import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from turnloom.llm import topk, vafile

ROWS = "vec_id long, embedding array<double>, label int, score double, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, lab, None, None) for i, e, lab in rows], ROWS)


def made(n, dim, seed=0, centres=9):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return [(i, [float(v) for v in c[i % centres] + 0.3 * rng.standard_normal(dim)], i % 4 if i % 7 else None) for i in range(n)]


def held(v):
    return min(max(v, -(2**63)), 2**63 - 1)


def floors(e, times):
    return [held(math.floor(times * x)) if math.isfinite(times * x) else (2**63 - 1 if x > 0 else -(2**63)) for x in e]


def usable(rows):
    return [(i, e, lab) for i, e, lab in rows if i is not None and e is not None and None not in e and all(map(math.isfinite, e))]


def brute_top(rows, k=5, every=50):
    ok, out = [(i, floors(e, 256)) for i, e, _ in usable(rows)], {}
    for i in {i for i, _ in ok if i % every == 0}:
        q = min((e for j, e, _ in usable(rows) if j == i))
        q = floors(q, 256)
        s = sorted((-held(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in ok if j != i and len(v) == len(q))
        out[i] = [(j, -x) for x, j in s[:k]]
    return {i: x for i, x in out.items() if x}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        got = out.setdefault(r["query_id"], [])
        got.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got)
    return out


ODD = [(9000, None, 1), (9050, [float("nan")] * 16, 1), (9100, [None] + [1.0] * 15, 1), (9150, [0.0] * 16, 1), (None, [1.0] * 16, 1), (9200, [], 2), (9201, [], 2), (9250, [1.0, 2.0], 2), (9251, [2.0, -3.0], 2), (9300, [float("inf")] * 16, 1)]


@pytest.mark.parametrize("width", [3, 8, 16])
def test_top_equals_brute_force(spark, width):
    rows = made(1500, 16) + [(2000 + i, [0.5] * 16, 0) for i in range(700)] + ODD
    rows += [(50, rows[50][1], 0), (51, rows[51][1], 0)]
    assert found(topk.top_products(table(spark, rows).repartition(6), width=width, block=7)) == brute_top(rows)


def test_top_of_large_components(spark):
    rows = [(i, [x * 10.0 ** (i % 24) for x in e], 0) for i, e, _ in made(160, 6, seed=3)] + [(200, [1e308] * 6, 0), (201, [-1e308] * 6, 0)]
    assert found(topk.top_products(table(spark, rows))) == brute_top(rows)


def test_top_of_few(spark):
    assert topk.top_products(table(spark, [])).count() == 0
    assert topk.top_products(table(spark, [(50, [1.0], 1)])).count() == 0
    assert found(topk.top_products(table(spark, [(0, [1.0], 1), (3, [2.0], 1), (2, [2.0], 1)]))) == {0: [(2, 131072), (3, 131072)]}


def test_branches_are_cut():
    """Most pairs go before their last block, and what comes out is still everything that can be among the first."""
    rng = np.random.default_rng(2)
    v = topk.whole(rng.standard_normal((3000, 32)) * np.linspace(2, 0.1, 32), 256)
    ask = topk.Asked(np.arange(10), v[:10], 4)
    lim = np.sort(v[:10] @ v.T, axis=1)[:, -6].astype(float)
    a, b, score = topk.search([v.T[e : e + 4] for e in ask.edges], np.arange(3000), topk.masses(v.T, ask.edges), ask, slice(0, 10), lim, 5)
    full = v[:10] @ v.T
    np.fill_diagonal(full, -(2**60))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(full >= lim[:, None])), strict=True))
    assert (score == full[a, b]).all() and len(a) < 80


def brute_codes(rows, entries=256, parts=4, rounds=4):
    """Plain integers, one length at a time."""
    ok, out = usable(rows), []
    for dim in {len(e) for _, e, _ in ok}:
        own = [(i, floors(e, 1024), lab) for i, e, lab in ok if len(e) == dim]
        width = -(-dim // parts)
        cut = lambda v: [(v + [0] * (width * parts - dim))[p * width : (p + 1) * width] for p in range(parts)]  # noqa: B023, E731
        ids = sorted({i for i, _, _ in own})[:entries]
        first = [cut(min(floors(e, 1024) for j, e, _ in ok if j == i and len(e) == dim)) for i in ids]
        books = [[f[p] for f in first] for p in range(parts)]
        x = [cut(v) for _, v, _ in own]

        def near(v, book):
            return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(book))

        for _ in range(rounds):
            for p in range(parts):
                got = {}
                for v in x:
                    got.setdefault(near(v[p], books[p])[1], []).append(v[p])
                books[p] = [[sum(c) // len(got[j]) for c in zip(*got[j], strict=True)] if j in got else e for j, e in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for (i, _, lab), v in zip(own, x, strict=True):
            d = [near(v[p], books[p]) for p in range(parts)]
            out.append((i, lab, "".join(f"{j:02x}" for _, j in d), held(sum(y for y, _ in d)), sha))
    total = {}
    for _, lab, _, e, _ in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, c, e, held(total[lab]), s) for i, lab, c, e, s in out), key=str)


def coded(df, **how):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vafile.with_label_errors(vafile.compress(df, **how)).collect()), key=str)


def test_codes_equal_brute_force(spark):
    rows = made(300, 8, seed=5) + [(400 + i, [0.25] * 8, None) for i in range(150)] + ODD + [(7, [9.0] * 8, 1), (8, made(9, 8, seed=5)[8][1], 3)]
    assert coded(table(spark, rows).repartition(5), entries=40) == brute_codes(rows, entries=40)


def test_codes_of_large_components(spark):
    rows = [(i, [x * 10.0 ** (i % 26) for x in e], 0) for i, e, _ in made(90, 8, seed=3)] + [(200, [1e308] * 8, 0), (201, [-1e308] * 8, 1)]
    assert coded(table(spark, rows), entries=12) == brute_codes(rows, entries=12)


def test_codes_of_few(spark):
    assert vafile.with_label_errors(vafile.compress(table(spark, []))).count() == 0
    assert coded(table(spark, [(5, [1.0, 2.0, 3.0, 4.5], None)])) == brute_codes([(5, [1.0, 2.0, 3.0, 4.5], None)])


def test_filter_refines_few_entries():
    rng = np.random.default_rng(1)
    book = vafile.Codebook(rng.integers(-500, 500, (256, 16)))
    x = book.entries[rng.integers(0, 256, 400)] + rng.integers(-60, 60, (400, 16))
    index, dist = book.nearest(x)
    d = ((x[:, None] - book.entries) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
    q = x[:, :, None].astype(float)
    least = (np.maximum(np.maximum(book.low - q, q - book.high), 0) ** 2).reshape(400, -1) @ book.which
    most = ((np.maximum(np.abs(q - book.low), np.abs(q - book.high)) ** 2).reshape(400, -1) @ book.which).min(axis=1)
    assert (least <= d).all() and (least <= most[:, None]).mean() < 0.1


def test_first_tile_and_ties_leave_few_pairs():
    """What a task holds of a tile: before F1 the first tile left every pair, and ties of all queries were held together."""
    rng = np.random.default_rng(5)
    v = topk.whole(rng.standard_normal((4096, 64)) / 8, 256)
    edges, ids = list(range(0, 64, 8)), np.arange(4096)
    ask = topk.Asked(ids[:64], v[:64], 8)
    tile, mass = [np.ascontiguousarray(v.T[e : e + 8], "i4") for e in edges], topk.masses(v.T, edges)
    a, b, score = topk.search(tile, ids, mass, ask, slice(0, 64), np.full(64, -np.inf), 5)
    assert len(a) < 20 * 64
    got = topk.first(a, score.astype(np.int64), ids[b], 5)
    s = v[:64] @ v.T
    s[np.arange(64), np.arange(64)] = topk.LEAST
    want = [sorted((-int(x), j) for j, x in enumerate(r))[:5] for r in s]
    assert [(-int(x), int(j)) for x, j in zip(got[1], got[2], strict=True)] == [p for w in want for p in w]

    held = []
    copies = np.repeat(v[:1], 2000, axis=0)
    packed = {"rows": 2000, "bytes": 8, "ids": np.arange(2000).tobytes(), "mass": topk.masses(copies.T, edges).tobytes(), "blocks": [np.ascontiguousarray(copies.T[e : e + 8], "i8").tobytes() for e in edges]}
    merge = topk.first
    with pytest.MonkeyPatch.context() as m:
        m.setattr(topk, "first", lambda q, score, v, k: held.append(len(q)) or merge(q, score, v, k))
        ask = topk.Asked(np.arange(2000), copies, 8)
        (out,) = topk.scan(iter([pa.RecordBatch.from_pylist([packed])]), ask, 5)
    assert out.num_rows == 10_000 and max(held) <= 64 * 2000
    assert out.column("vec_id").to_pylist()[-5:] == [0, 1, 2, 3, 4]
