"""Queries over a published generation, written beside the session's checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.ids import canonical_digest
from quire.operators.search import _tfidf_sql, documents
from quire.plans import publish
from quire.plans.fixpoint import shared_folder
from quire.plans.store import files_of

_SEARCHES = (("en", "the and", 100), ("fr", "est que de", 20), ("every", "er the", 50))


def generation(spark, sf_dir: str) -> str:
    """The folder of the documents' generation, with a scope for each language and one for all; published if there is none yet.

    The names of the table's files are the review's revision, so other files are another generation.
    """
    docs = documents(spark, sf_dir)
    revision = canonical_digest(sorted(docs.inputFiles()))
    root = f"{shared_folder(spark)}/library-{revision[:16]}"
    system, place = files_of(spark, f"{root}/current.json")
    if not system.exists(place):
        units = docs.select(F.col("doc_id").alias("unit_id"), F.split("text", "\n")[0].alias("title"), F.coalesce("text", F.lit("")).alias("text"))
        scopes = docs.select(F.explode(F.array_compact(F.array("lang", F.lit("every")))).alias("scope"), F.col("doc_id").alias("unit_id"), F.lit("confirmed").alias("state"), F.lit(True).alias("eligible"))
        publish.publish(units, scopes, root, {"review_revision": revision})
    return publish.open_current(spark, root, revision)[0]


def q_published_search(spark, sf_dir) -> DataFrame:
    """The best documents of three scopes by the published index, with snippets."""
    folder, rows = generation(spark, sf_dir), None
    for scope, query, limit in _SEARCHES:
        found = publish.search(spark, folder, scope, query, limit, digits=6).select(F.lit(scope).alias("scope"), F.col("unit_id").alias("doc_id"), "score", "snippet")
        rows = found if rows is None else rows.unionByName(found)
    return rows


def q_index_heads(spark, sf_dir) -> DataFrame:
    """Of each term of the published index, in how many documents it is and its greatest count."""
    blocks = spark.read.parquet(f"{generation(spark, sf_dir)}/blocks")
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").cast("long").alias("most"))


QUERIES = {"published_search": q_published_search, "index_heads": q_index_heads}

_SCOPE_SQL = {"en": "lang = 'en'", "fr": "lang = 'fr'", "every": "true"}

ORACLE_SQL = {
    "published_search": " UNION ALL ".join(
        f"SELECT '{scope}' AS scope, * FROM ({_tfidf_sql(_SCOPE_SQL[scope], query, limit, True)})" for scope, query, limit in _SEARCHES
    ),
    "index_heads": r"""SELECT term, count(*) AS df, max(n) AS most
      FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1""",
}
