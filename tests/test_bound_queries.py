"""Every bound query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from stratavane import bindings

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(df):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(value(r[c]) for c in cols) for r in df.to_dict("records"))


@pytest.mark.parametrize("name", sorted(bindings.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert _rows(bindings.queries()[name](spark, SF).toPandas()) == _rows(duck.execute(bindings.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(bindings.queries()) - set(bindings.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert bindings.queries()[name](spark, SF).count() > 0
