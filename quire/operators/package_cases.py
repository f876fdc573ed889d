"""Queries that normalise made sources: every ten documents are the files of one publication.

A publication is normalised whole, with the files of all ten; the queries give what
belongs to the files whose documents there are.
The SQL beside them has, for each file, the documents and links that it must give,
written down by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.cases import pick
from quire.plans.package import normalize

FILES = [
    ("m/index.html", "<h1>Start</h1><nav><ul><li><a href='a.html'>A</a><ul><li><a href='b.html#x'>B</a></ul></ul></nav><p>Welcome"),
    ("m/a.html", "<h1>A</h1><p>Text 2006 only <a href='b.html#x'>ok</a><a href='b.html#none'>frag</a><a href='index.html'>home</a><a href='http://e/'>ext</a>"),
    ("m/b.html", "<h1>B</h1><p id='x'>Text of b <a href='d.pdf'>pdf</a><a href='gone.html'>gone</a><a href='known.html'>known</a><a href='i.png'>img</a><a href='external-car.html'>out</a>"),
    ("m/c.html", "<h1>Start</h1><p>Welcome"),
    ("m/external-car.html", "<p>not here"),
    ("m/e.html", "<h1>E</h1><p>The same text"),
    ("m/f.html", "<h1>E</h1><p>The same <b>text</b>"),
    ("m/bad.html", "<meta charset=klingon><p>x"),
    ("m/d.pdf", "%PDF-1"),
    ("m/i.png", "not read"),
]
# file, page, role, whether it is found by a search, where its text comes from, breadcrumbs
DOCUMENTS = [
    (0, None, "landing", False, "none", ""),
    (1, None, "procedure", True, "native", "A"),
    (2, None, "procedure", True, "native", "A/B"),
    (3, None, "landing", False, "none", ""),
    (4, None, "unavailable", False, "none", ""),
    (5, None, "procedure", True, "native", ""),
    (6, None, "procedure", True, "native", ""),
    (8, 1, "pdf_page", True, "native", ""),
    (8, 2, "pdf_page", False, "none", ""),
]
# file, link, status, file it leads to
LINKS = [
    (0, "a.html", "resolved", 1),
    (0, "b.html#x", "resolved", 2),
    (1, "b.html#x", "resolved", 2),
    (1, "b.html#none", "missing", None),
    (1, "index.html", "resolved", 0),
    (1, "http://e/", "blocked", None),
    (2, "d.pdf", "resolved", 8),
    (2, "gone.html", "missing", None),
    (2, "known.html", "outside_selection", None),
    (2, "i.png", "unsupported", None),
    (2, "external-car.html", "unavailable_by_source", None),
]


def _present(spark, sf_dir: str) -> DataFrame:
    """(publication_id, path): the file of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 10).cast("string")).alias("publication_id"), pick([path for path, _ in FILES]).alias("path"))


def _tables(spark, sf_dir: str) -> dict[str, DataFrame]:
    content = pick([text for _, text in FILES]).cast("binary")
    # a number of its own for each file of each publication, which picks the path and the content
    files = _present(spark, sf_dir).select("publication_id").distinct().select("publication_id", F.explode(F.sequence(F.lit(0), F.lit(len(FILES) - 1))).alias("doc_id"))
    members = files.select("publication_id", F.lit("m/index.html").alias("entry_path"), pick([path for path, _ in FILES]).alias("path"), F.sha2(content, 256).alias("sha256"), content.alias("content"))
    pages = spark.createDataFrame([("m/d.pdf", 1, "first page", "native"), ("m/d.pdf", 2, None, "ocr")], "path string, page int, text string, provenance string")
    known = spark.createDataFrame([("m/known.html",)], "path string")
    return normalize(members, pages, known)


def q_package_documents(spark, sf_dir):
    rows = _tables(spark, sf_dir)["documents"].join(_present(spark, sf_dir), ["publication_id", "path"])
    return rows.select("publication_id", "path", "page", "role", "search_eligible", "provenance", F.array_join("breadcrumbs", "/").alias("breadcrumbs"))


def q_package_links(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    targets = tables["documents"].select(F.col("document_id").alias("target_id"), F.col("path").alias("target"))
    asked = _present(spark, sf_dir).withColumnRenamed("path", "source_path")
    return tables["links"].join(asked, ["publication_id", "source_path"]).join(targets, "target_id", "left").select("publication_id", "source_path", "href", "status", "target")


def q_package_aliases(spark, sf_dir):
    """How many documents of each publication share a text, and how many all around it: their titles are alike, their markup isn't."""
    tables = _tables(spark, sf_dir)
    present = tables["documents"].select("document_id", "publication_id", "path").join(_present(spark, sf_dir), ["publication_id", "path"])
    rows = tables["aliases"].join(present.select("document_id"), "document_id")
    return rows.groupBy("same_texts", "same_contexts").agg(F.count("*").alias("documents"))


QUERIES = {"package_documents": q_package_documents, "package_links": q_package_links, "package_aliases": q_package_aliases}


def _rows(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(show, row)) + ")" for row in rows)


_PATHS = "(VALUES " + _rows([(k, path) for k, (path, _) in enumerate(FILES)]) + ") f(k, path)"
ORACLE_SQL = {
    "package_documents": f"""SELECT 'p' || (doc_id // 10) AS publication_id, path, CAST(page AS INT) AS page, role, search_eligible, provenance, breadcrumbs
      FROM documents JOIN {_PATHS} ON doc_id % 10 = f.k JOIN (VALUES {_rows(DOCUMENTS)}) d(k, page, role, search_eligible, provenance, breadcrumbs) ON d.k = f.k""",
    "package_links": f"""SELECT 'p' || (doc_id // 10) AS publication_id, f.path AS source_path, href, status, t.path AS target
      FROM documents JOIN {_PATHS} ON doc_id % 10 = f.k JOIN (VALUES {_rows(LINKS)}) l(k, href, status, goal) ON l.k = f.k LEFT JOIN {_PATHS.replace("f(k, path)", "t(k, path)")} ON t.k = goal""",
    "package_aliases": "SELECT 2 AS same_texts, 1 AS same_contexts, count(*) AS documents FROM documents WHERE doc_id % 10 IN (5, 6)",
}
