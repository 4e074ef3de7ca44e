"""The registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from kinelake import llm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(llm.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    got = llm.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == cols

    def rows(df):
        return sorted(tuple(None if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_has_a_row_for_each_document(spark, name):
    got = llm.queries()[name](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert got.count() == docs.count() and "doc_id" in got.columns
    assert got.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
