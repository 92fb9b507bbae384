"""Every query of the engine against DuckDB on the smallest fixture."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from turnloom.plans import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(df):
    def text(v):
        if v is None or v is pd.NA or v != v:
            return "~"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") in "if" and hasattr(v, "dtype") else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = plain(QUERIES[name](spark, SF).toPandas())
    if name in SQL:
        assert got == plain(db.execute(SQL[name]).df())
    assert got[1]
