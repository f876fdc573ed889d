"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quire.plans import catalog

SF = os.environ.get("QUIRE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(value) if isinstance(value, list) else value


def same(rows):
    return sorted(repr(tuple(plain(v) for v in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [[row[c] for c in columns] for row in df.collect()]
    assert got, "a query without rows proves nothing"
    if name not in catalog.ORACLE_SQL:
        return
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [[row[names.index(c)] for c in columns] for row in result.fetchall()]
    assert same(got) == same(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "score", "snippet"]


def test_postings_deal_out_texts(spark):
    from quire.operators.search import postings

    found = postings(spark.createDataFrame([(1, "engine valve"), (1, "engine"), (2, None), (3, "valve")], "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == {("engine", 1, 2), ("valve", 1, 1), ("valve", 3, 1)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    plan = plan if "Exchange" in plan else found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate ") < plan.index("Exchange ")  # a plan's first line is its last step
