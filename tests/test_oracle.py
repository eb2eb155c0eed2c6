"""Every registered query against its DuckDB SQL over the smallest tables."""

import decimal
import os

import duckdb
import pytest

from sparkloom.plans.queries import QUERIES, SQL, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        c.sql(f"create view {t} as from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v % 1 == 0 else float(v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_flagship_has_rows(spark, data):
    assert flagship(spark, data).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_confidence_is_rounded_as_sql_does(spark):
    """Every confidence of three decimals, half of the last ones a tie in print only."""
    from sparkloom.functions import dims
    from sparkloom.operators import findings as fi

    want = dict(duckdb.sql("select k, round(k / 10.0::double / 100, 2) from range(300, 1001) t(k)").fetchall())
    nodes = spark.range(300, 1001).selectExpr("cast(id as string) as node_id", "'a' as file_path", "id as line", "'python' as language", "'SINK' as label", "'CWE-1' as cwe", "id / 10D / 100 as confidence", "'' as raw_text")
    assert {r.line: r.confidence for r in fi.serialised(nodes, dims.frame(spark, "cwes")).collect()} == want
