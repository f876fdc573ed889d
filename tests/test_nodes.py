"""Paths of nodes and parts written back, against a plain walk over the parser's page."""

import pytest
from pyspark.sql import functions as F

from quire.operators import nodes
from quire.sources import html

PAGES = [
    "<html><body><div><p>a<p>b<div>c</div></div><div class=footer>no</div><ul><li>x<li>y <b>z</b></ul></body>",
    "<p>one <a href='t.html'>two & three</a> <a href='http://e/'>out</a> <a name=n>n</a><script>s</script><table><tr><td colspan=2 onclick=x>4<td>\"5\"</table>",
    "text only",
    "",
    "<div>" * 150 + "deep",
    "<div>" * 500,
]


def frame(spark):
    return spark.createDataFrame([(k, bytearray(p.encode())) for k, p in enumerate(PAGES)], "page_id long, content binary")


def plain_selector(page, node):
    parts = []
    while node > 0:
        alike = [n for n in range(1, len(page.tags)) if page.parents[n] == page.parents[node] and page.tags[n] == page.tags[node]]
        parts.append(f"{page.tags[node]}:nth-of-type({alike.index(node) + 1})")
        node = page.parents[node]
    return " > ".join(reversed(parts))


def test_selectors(spark):
    got = {(r["doc_id"], r["node_id"]): r["selector"] for r in nodes.selectors(html.events(frame(spark))).collect()}
    expected = {}
    for k, markup in enumerate(PAGES[:-1]):
        page = html.Page(markup)
        expected.update({(k, n): plain_selector(page, n) for n in range(1, len(page.tags))})
    assert got == expected  # a page that is nested too deeply is an error, so it has no events
    assert got[4, 150].count(" > ") == 149


def test_rendered(spark):
    events = html.events(frame(spark))
    roots = nodes.nodes(events).where("parent_id = 0")
    links = spark.createDataFrame([(1, 0, "a&b/t.html", None), (1, 1, None, 'not "ours"')], "doc_id long, link int, target string, reason string")
    got = {(r["doc_id"], r["node_id"]): r["markup"] for r in nodes.rendered(events, roots, links).collect()}
    assert got[0, 1] == "<div><p>a</p><p>b<div>c</div></p></div><ul><li>x</li><li>y <b>z</b></li></ul>"
    assert "no" not in got[0, 1] and "footer" not in got[0, 1]
    assert got[1, 1].startswith('<p>one <a href="#/a&amp;b/t.html">two &amp; three</a> <span title="not &quot;ours&quot;">out</span> <span>n</span>')
    assert '<td colspan="2">4</td><td>&quot;5&quot;</td>' in got[1, 1] and "onclick" not in got[1, 1] and "script" not in got[1, 1]
    assert len(got[4, 1]) == 150 * len("<div></div>") + 4


@pytest.mark.parametrize("separator", ["/", " > "])
def test_rooted_chains(spark, separator):
    rows = spark.range(1, 301).select(F.lit(1).alias("doc_id"), F.col("id").alias("node_id"), (F.col("id") - 1).alias("parent_id"), F.col("id").cast("string").alias("piece"))
    got = {r["node_id"]: r["path"] for r in nodes.rooted(rows, "piece", separator).collect()}
    assert got[300] == separator.join(map(str, range(1, 301))) and got[1] == "1" and len(got) == 300
