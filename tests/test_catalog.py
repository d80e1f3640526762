"""Every query of the library gives the rows of its SQL twin in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from sanilake.plans import catalog, metadata, more  # noqa: F401  the last two add to the catalogue

DATA = os.environ.get("SANILAKE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Files of a format that Spark doesn't know are read in Python, in Arrow batches.
IN_PYTHON = {"dbc_parts", "dbc_headers"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def cell(x):
    if pd.isna(x):
        return None
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    try:
        return round(float(x), 6)
    except (TypeError, ValueError):
        return str(x)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(cell(x) for x in r) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


def test_every_query_has_a_twin():
    assert set(catalog.ORACLE) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Python" not in plan or name in IN_PYTHON) and "CartesianProduct" not in plan
    assert rows(got.toPandas()) == rows(db.execute(catalog.ORACLE[name]).df())
