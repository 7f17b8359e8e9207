"""Every registered query against its SQL twin, value for value."""

import numbers
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from emberframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, numbers.Integral) or (isinstance(v, (float, Decimal)) and v == int(v)):
            return str(int(v))  # keys and sums are compared in full
        try:
            return f"{float(v):.5g}"
        except (TypeError, ValueError):
            return str(v).removesuffix(" 00:00:00")

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(one, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    text = catalog.oracle_sql().get(name)
    if text is None:
        assert len(got)
        return
    want = duck.execute(text).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and plain(got) == plain(want)
