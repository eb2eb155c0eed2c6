"""Queries of the training-data operators against their DuckDB SQL, over the smallest tables with odd rows added."""


import duckdb
import pytest

from sparkloom.llm import queries as q


@pytest.fixture(scope="module")
def tables(spark, data, tmp_path_factory):
    """The tables with nulls, blanks, repeats and ties."""
    root = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = [(-5, None, "en", None, 0), (-6, "", "en", "", 0), (-7, " \t\n", "de", "src1", 3), (-8, "a b", "en", "é", 3), (-8, "c d", "en", "é", 3), (-9, "A  B", "en", "é", 4), (-10, "É x\n\nÉ x\n$ & x", "fr", "z", 9), (-10, "É x\n\nÉ x\n$ & x", "fr", "z", 9), (-11, "w " * 3000, "en", "src2", 6000), (None, "a b", None, None, 3), (-12, "New York, new york! $ " * 40, None, "", 9), (-13, "New York, new york! $ " * 40, None, "", 9)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{root}/documents.parquet")
    pages = spark.read.parquet(f"{data}/pages.parquet")
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/?x#y", "x://a.net/es/", "x://net/fr/#", "x://b.net?/es/", "x://Éa.org"]
    pages.unionByName(spark.createDataFrame([(-k - 1, u, "") for k, u in enumerate(urls)] + [(-3, "no scheme", "")], pages.schema)).write.parquet(f"{root}/pages.parquet")
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as from '{tables}/{t}.parquet/*.parquet'")
    df, want = q.queries()[name](spark, tables), con.sql(q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_one_query_for_each_operator():
    numbered = [n for n in q.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in numbered) == list(range(1, 14))
    assert set(q.oracle_sql()) <= set(q.queries())
