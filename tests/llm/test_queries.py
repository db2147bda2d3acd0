"""The registered queries: against their SQL where there is one, else that they give their columns for every row."""

import glob
import os

import duckdb
import pytest

from hyperloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    rows = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == rows


@pytest.mark.parametrize("name", ["op1_lines", "op2_langid", "op6_quality", "op10_licences"])
def test_a_row_a_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.queries()[name](spark, SF)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
