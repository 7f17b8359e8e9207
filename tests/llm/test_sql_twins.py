"""Queries of the training-data operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from emberframe.llm import queries
from tests.test_queries import plain  # null integers look alike in both engines


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, small).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert plain(got) == plain(want)
