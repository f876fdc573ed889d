"""Queries against their SQL on rows that the smallest tables don't have."""

import __spark_entry__
import duckdb
import pytest


def differ(spark, folder, name: str, **tables) -> list:
    """What the query and its SQL don't share on these tables (lists of rows, with a schema)."""
    duck = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = __spark_entry__.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    places = [[d[0] for d in result.description].index(c) for c in columns]
    expected = sorted(repr(tuple(row[k] for k in places)) for row in result.fetchall())
    assert expected, "a query without rows proves nothing"
    return [(a, b) for a, b in zip(got, expected, strict=True) if a != b]


def page(title: str, body: str = "<p>One.</p><p>Two.</p>") -> str:
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav>'
        f"<article><h1>{title}</h1>{body}</article><footer>x</footer></body></html>"
    )


PAGES = "page_id long, url string, html string"
CUT = [(k, "", page(title)) for k, title in enumerate(("a &amp;&amp", "b &am", "c &quo", "d &amp", "e & f", "g &quot;h&quot;"))] + [(404, "", page("not here"))]
LONG = [(k, "", page("t", "<p><b>open<br>" * 250 if k < 5 else "<p>shut</p>" * 250)) for k in range(10)]


@pytest.mark.parametrize("name", ["page_records", "page_titles", "rendered_parts", "ordered_steps", "paragraph_steps"])
def test_references_that_were_cut(spark, tmp_path, name):
    assert differ(spark, tmp_path, name, pages=(CUT, PAGES)) == []


def test_steps_of_pages_with_many_paragraphs(spark, tmp_path):
    """More paragraphs than 1,024, in one list, in lists that go on, with a condition and with an empty one."""
    bodies = ["<p>Turn it.</p>" * 1025, "<p><b>Turn it.<br>" * 1300, "<p>Turn it.</p>" * 1100 + "<p>Stop if hot.</p>", "<p>Turn it.</p>" * 1100 + "<p></p>"]
    assert differ(spark, tmp_path, "paragraph_steps", pages=([(k, "", page("t", body)) for k, body in enumerate(bodies)], PAGES)) == []


def test_roles_of_pages_with_many_paragraphs(spark, tmp_path):
    assert differ(spark, tmp_path, "page_roles", pages=(LONG, PAGES)) == []


@pytest.mark.parametrize("name", ["package_links", "package_documents", "package_aliases"])
def test_publications_that_lack_documents(spark, tmp_path, name):
    assert differ(spark, tmp_path, name, documents=([(k,) for k in (0, 1, 2, 5, 6, 11, 15, 26, 31)], "doc_id long")) == []


def test_alias_conflicts_meet_by_years(spark):
    """All pairs of aliases in plain Python, with open, turned and long ranges; ranges apart are never joined."""
    from itertools import combinations
    from random import Random

    from quire.operators.hierarchy import alias_conflicts

    some = Random(3)
    year = lambda: some.choice([None, *range(1990, 2000), 1990, 2200])
    rows = [(k, some.choice("xy"), some.choice("mn"), some.choice([None, "p", "q"]), year(), year()) for k in range(120)]
    df = spark.createDataFrame(rows, "alias_id long, literal string, target_id string, make_id string, year_start int, year_end int")

    def clash(a, b):
        starts, ends = [x for x in (a[4], b[4]) if x is not None], [x for x in (a[5], b[5]) if x is not None]
        return a[1:2] == b[1:2] and a[2] != b[2] and (None in (a[3], b[3]) or a[3] == b[3]) and starts and ends and max(starts) <= min(ends)

    assert sorted(map(tuple, alias_conflicts(df).collect())) == sorted((a[1], a[0], b[0]) for a, b in combinations(rows, 2) if clash(a, b))
    apart = spark.range(20_000).selectExpr("id AS alias_id", "'x' AS literal", "string(id) AS target_id", "CAST(NULL AS STRING) AS make_id", "int(id * 2) AS year_start", "int(id * 2) AS year_end")
    joined = alias_conflicts(apart)
    assert joined.isEmpty() and "year" in joined._jdf.queryExecution().toString().split("Join Inner")[1][:200]


def test_range_summary_folds_values(spark):
    from quire.operators.hierarchy import range_summary

    rows = spark.range(300_000).selectExpr("id % 3 AS day")
    ranges = spark.range(2_000).selectExpr("id AS k", "id % 3 AS s", "id % 3 + 1 AS t")
    found = {(r.k % 3, r.n, r["first"], r["last"]) for r in range_summary(rows, ranges, "k", "day", "s", "t", 1).collect()}
    assert found == {(0, 200_000, 0, 1), (1, 200_000, 1, 2), (2, 100_000, 2, 2)}


def test_pages_are_read_in_slices(spark, monkeypatch):
    """No slice holds more than its bytes, but for a larger row alone; nothing is lost, and records don't pile up."""
    import pyarrow as pa

    from quire.sources import html

    sizes = [10, 5000, 40, 3000, 3000, 0, 20_000, 7]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([b"x" * n if n else None for n in sizes], pa.binary())], ["k", "content"])
    cut = list(html.slices(batch, 1, 8192))
    assert [k for some in cut for k in some.column(0).to_pylist()] == list(range(8))
    assert all(some.num_rows == 1 or sum(len(v or b"") for v in some.column(1).to_pylist()) <= 8192 for some in cut) and len(cut) == 4
    rows = spark.range(3000).selectExpr("id AS page_id", "concat('p', id, '.html') AS path", "binary(concat('<body><h1>t</h1><p>', repeat('x ', 500), id)) AS content").coalesce(1)
    run = html.parse(rows).select("page_id", "page.title", "page.error")
    assert "ArrowEvalPython" not in run._jdf.queryExecution().toString()
    assert {(r.title, r.error) for r in run.collect()} == {("t", None)} and run.count() == 3000
    events = html.events(rows).where("kind = 'open'").groupBy("doc_id").count()
    assert {r["count"] for r in events.collect()} == {3} and events.count() == 3000


def test_tables_that_grow_are_not_broadcast(spark):
    """Small sides of joins over edges and steps are dealt out too: many broadcasts add up on the driver."""
    from quire.llm import graph
    from quire.operators import steps
    from quire.sources import html

    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "u long, v long")
    pages = spark.createDataFrame([(1, "p.html", bytearray(b"<body><h1>t</h1><ol><li>a<li>b<ol type=a><li>c</ol></ol>"))], "doc_id long, path string, content binary")
    found = steps.extract_steps(html.parse(pages).select("doc_id", "page.nodes"))
    for df in (graph._large_star(edges), graph._small_star(edges), found):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.label for r in found.collect()) == ["1", "2", "2.a"]
    assert sorted(map(tuple, graph.components(edges).collect())) == [(2, 1), (3, 1), (5, 4)]
