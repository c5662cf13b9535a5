import warnings
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from lakeweave.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list):
        return tuple(map(plain, v))
    return float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_its_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, DATA)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = oracle.execute(catalogue.SQL[name]).to_arrow_table()
    names = sorted(df.columns)
    assert names == sorted(want.column_names)
    found = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert found == sorted((tuple(plain(r[c]) for c in names) for r in want.to_pylist()), key=repr)


def test_entry_and_registry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries()) and len(catalogue.SQL) == len(catalogue.QUERIES) >= 50
