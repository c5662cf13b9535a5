from pathlib import Path

import duckdb
import pytest

from lakeweave.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    want = con.sql(queries.oracle_sql()[name]).to_arrow_table()
    names = sorted(df.columns)
    assert names == sorted(want.column_names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted((tuple(r[c] for c in names) for r in want.to_pylist()), key=repr)


@pytest.mark.parametrize("name", ["op1_co_training", "op3_site_style", "op5_secrets", "op6_langid", "op7_bpe", "op8_pseudo_likelihood"])
def test_the_rest_runs_over_its_whole_table(spark, name):
    table = "pages" if name == "op3_site_style" else "documents"
    assert queries.queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
