"""Every registered graph query that has SQL, against DuckDB."""

import math
import os

import duckdb
import pytest

from loomgraph.plans import catalog, catalog_more  # noqa: F401  the second adds to the first

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame, columns):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return x if isinstance(x, str) else f"{float(x):.6g}"

    return sorted(tuple(map(plain, r)) for r in frame[columns].values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, db, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), db.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
