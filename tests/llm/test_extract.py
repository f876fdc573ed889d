"""Main texts of pages: the given pages against their articles' markup, made pages against what was put in."""

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import extract

SF = "/root/testdata/sf0.01"


def article(page):
    """Blocks of the only article of a given page, by its markup alone."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", body))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = extract.op12_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for row in rows:
        expected = article(pages[row["page_id"]]["html"])
        assert row["text"] == expected and row["n_chars"] == len(expected) and row["url"] == pages[row["page_id"]]["url"]


LONG = " ".join(f"word{k}" for k in range(60))
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>"

CASES = {
    "nothing": ("", []),
    "no tag": ("plain &amp; simple <3", ["plain & simple <3"]),
    "only menus": (NAV, []),
    "short article": (f"{NAV}<div class='ad'>{LONG}</div><article><p>Hi.</p></article><footer>{LONG}</footer>", ["Hi."]),
    "decoded": ("<article><p>a &lt;b&gt; &eacute;&#33;&#x21;&nbsp;&amp;amp;  c\n\t d<br>e</p></article>", ["a <b> é!! &amp; c d e"]),
    "short blocks stay": (f"<article><h1>T</h1><p>{LONG}</p><p>Of.</p><ul><li>one<li>two</ul><blockquote>q</blockquote><p>{LONG}</p></article>", ["T", LONG, "Of.", "one", "two", "q", LONG]),
    "inside an article": (
        f"<article><header><h1>T</h1></header><p>{LONG}</p><aside>side</aside><div class='advert'>buy</div><form><p>mail</p></form><script>x('<p>')</script><style>p</style>"
        f"<section id='comments'><article><p>{LONG}</p></article></section><footer>tags</footer></article>",
        ["T", LONG],
    ),
    "comments by title": (f"<article><h1>T</h1><p>{LONG}</p><div><h3>3 Comments</h3><p>{LONG}</p></div></article>", ["T", LONG]),
    "no article": (
        f"<div class=top><a href=/>Home</a> <a href=/b>B</a></div><div id=c><h1>T</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><h3>More</h3><ul><li><a href=1>Another long title of a story</a></ul></div><div>All rights kept</div>",
        ["T", LONG, "Short.", LONG],
    ),
    "flat": (f"<ul><li><a>Home</a><li><a>About</a></ul><h1>T</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul><li><a href=x>Next story here</a></ul>", ["T", LONG, "Short.", LONG]),
    "main": (f"<header><h1>Site</h1></header><main><h2>T</h2><p>{LONG}</p></main><aside>{LONG}</aside>", ["T", LONG]),
    "wrapped in a form": (f"<form id=f><div class=menu><a href=x>y</a></div><article><p>{LONG}</p></article></form>", [LONG]),
    "nav left open": (f"<nav><a href=x>y</a><article><h1>T</h1><p>{LONG}<p>Second</article>", ["T", LONG, "Second"]),
    "hidden": ("<article><p>a</p><p hidden>b</p><div style='display: none'>c</div><p aria-hidden=true>d</p></article>", ["a"]),
    "notices": (f"<div class='cookie-notice'><p>{LONG}</p></div><article><p>a</p></article><div role=alert>{LONG}</div><noscript>{LONG}</noscript>", ["a"]),
    "unclosed blocks": ("<article><h1>T</h1><p><b>one<br><p>two</p><p>three</article></body>", ["T", "one", "two", "three"]),
    "teasers": (f"<article><p>{LONG}</p><p>{LONG}</p></article><article><a href=x>More</a></article>", [LONG, LONG]),
    "comment marks": (f"<!-- <p>no</p> --><article><p>{LONG}</p></article><!-- never closed <p>", [LONG]),
}


@pytest.mark.parametrize("name", CASES)
def test_made_pages(name):
    page, blocks = CASES[name]
    assert extract.main_blocks(page) == blocks


def test_pages_of_many_shapes():
    """Articles between all kinds of surroundings: every block comes back, and nothing else."""
    rng = random.Random(1)
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "R&D", "<x>", "naïve"])
    text = lambda most: " ".join(word() for _ in range(rng.randint(1, most)))
    around = ["<nav>{}</nav>", "<div class='sidebar'><p>{}</p></div>", "<aside><h3>x</h3><p>{}</p></aside>", "<footer>{}</footer>", "<div id='ad-7'>{}</div>", "<section class='comments'><p>{}</p><p>{}</p></section>", "<header>{}</header>", "<form><label>{}</label><input></form>"]
    for _ in range(300):
        blocks = [text(80) for _ in range(rng.randint(1, 12))]
        inner = "".join(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<p>{}", "<div>{}</div>", "<ul><li>{}</ul>", "<pre>{}</pre>"]).format(html.escape(b)) for b in blocks)
        sides = [[rng.choice(around).replace("{}", html.escape(text(120))) for _ in range(rng.randint(0, 4))] for _ in range(2)]
        page = f"<!DOCTYPE html><html><head><title>{html.escape(text(5))}</title></head><body>{''.join(sides[0])}<article>{inner}</article>{''.join(sides[1])}</body>"
        assert extract.main_blocks(page) == blocks


def test_smoothing_and_threshold():
    assert np.allclose(extract.smooth(np.full(9, 3.0)), 3.0)
    spike = extract.smooth(np.array([0, 0, 0, 0, 10.0, 0, 0, 0, 0]))
    assert spike.argmax() == 4 and spike[3] == pytest.approx(spike[5]) and spike[3] > spike[2] > spike[1] > 0 == spike[0]
    values = np.array([1, 2, 1, 90, 100, 95, 2.0])
    assert extract.threshold(values) == pytest.approx(90) and extract.threshold(np.full(3, 5.0)) == 5


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<div>", "<b>", "<p><b>", "<li><div>", "&", "<![CDATA[", '<a href="', "</div>", "<div><h2>Comments</h2>", "<table><tr><td>x", "<a>x"])
def test_hostile_pages_take_time_in_proportion(piece):
    began = time.time()
    extract.main_blocks(piece * 40_000)
    assert time.time() - began < 20


def test_edges(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "v", "<article><p>x</p></article>"), (2, "v", "<article><p>x</p></article>"), (3, None, "<article><p>" + "long text " * 300_000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(7).alias("n_chars"), F.lit(8).alias("element"))
    found = extract.extract(pages)
    assert found.columns == ["page_id", "url", "n_chars", "element", "text"]
    assert [(r["page_id"], r["n_chars"], len(r["text"])) for r in found.collect()] == [(1, 7, 0), (None, 7, 0), (2, 7, 1), (2, 7, 1), (3, 7, 2_999_999)]
    assert extract.extract(pages.where("false")).collect() == []
