"""Exact percentiles by refinement against a sort."""

import random

import numpy as np
import pytest

from turnloom.operators import metrics


@pytest.mark.parametrize("q", [0.5, 0.37])
def test_refinement_equals_a_sort(spark, q, monkeypatch):
    monkeypatch.setattr(metrics, "BUCKETS", 512)
    random.seed(3)
    scopes = {
        "whole": [random.randint(-5000, 5000) for _ in range(3000)], "double": [random.gauss(0, 1) for _ in range(999)], "skewed": [10.0 ** random.uniform(-3, 8) for _ in range(500)], "few": [1.5, 2.5],
        "one": [7], "same": [3.25] * 400, "close": [1 + i * 2.0**-52 for i in range(40)], "tiny": [5e-324, 1e-323, 0.0, 2e-323], None: [1.0, 2.0, 9.0],
    }
    rows = [(s, float(v), 1 + i % 3) for s, vs in scopes.items() for i, v in enumerate(vs)] + [("none", None, 4), ("one", None, 1)]
    df = spark.createDataFrame(rows, "s string, v double, n int")
    want = {}
    for s, vs in scopes.items():
        x = sorted(v for i, v in enumerate(vs) for _ in range(1 + i % 3))
        a, at = int(np.floor(q * (len(x) - 1))), q * (len(x) - 1)
        b = int(np.ceil(at))
        want[s] = x[a] if x[a] == x[b] else (b - at) * x[a] + (at - a) * x[b]
    for most in (4, 100_000):
        got = {r["s"]: r["percentile"] for r in metrics.percentiles(df, ["s"], "v", "n", q, most).collect()}
        assert set(got) == set(want) and all(got[s] == pytest.approx(want[s], rel=1e-12, abs=0) for s in want)


def test_nothing_has_no_percentile(spark):
    df = spark.createDataFrame([], "s string, v double, n int")
    assert metrics.percentiles(df, ["s"], "v", "n").count() == 0 and metrics.percentiles(df, [], "v", "n").collect() in ([], [(None,)])
