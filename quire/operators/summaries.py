"""Summaries and checks over names, books, searches and members: counts, votes, capped lists, anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Rows that a list of an index shows.
INDEX_CAP = 400


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extension(path: Column) -> Column:
    """The lower-cased extension of a path's or address's name, with its dot, or nothing."""
    return F.regexp_extract(F.lower(F.regexp_extract(path, r"([^/?#]*)(?:[?#].*)?$", 1)), r"(\.[a-z0-9]+)$", 1)


def extension_counts(members: DataFrame, path_column: str = "path") -> DataFrame:
    """(extension, n)."""
    return members.groupBy(extension(F.col(path_column)).alias("extension")).agg(F.count("*").alias("n"))


def prefix_votes(names: DataFrame, group: str, name: str, chars: int = 3) -> DataFrame:
    """(group, prefix, n): the prefix that most names of a group begin with; of several the last in order."""
    votes = names.groupBy(group, F.substring(name, 1, chars).alias("prefix")).agg(F.count("*").alias("n"))
    return votes.groupBy(group).agg(F.max(F.struct("n", "prefix")).alias("best")).select(group, "best.prefix", "best.n")


def book_summary(rows: DataFrame, book: str, year: str, model: str, order: str) -> DataFrame:
    """(book, years, models): distinct years ascending, and distinct models in the order in which they come first."""
    first = rows.groupBy(book, model).agg(F.min(order).alias("__first"))  # a row a model, however often it comes
    models = first.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("__first", F.col(model).alias("model")))).alias("all"))
    years = rows.groupBy(book).agg(F.array_sort(F.collect_set(year)).alias("years"))
    return years.join(models, book).select(book, "years", F.transform("all", lambda one: one["model"]).alias("models"))


def latencies(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, p95, median) by nearest rank, exact: each is a value that was measured."""
    rank = lambda share: F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)")
    return rows.groupBy(group).agg(rank(0.95).alias("p95"), rank(0.5).alias("median"))


def normalization_summary(documents: DataFrame, links: DataFrame, figures: DataFrame, by: str = "source") -> DataFrame:
    """(by, documents, searchable, unresolved, unavailable): what a source's normalisation left open.

    ``documents`` has ``by`` and text, ``links`` and ``figures`` have ``by`` and status.
    """
    held = documents.groupBy(by).agg(F.count("*").alias("documents"), F.count_if(F.trim("text") != "").alias("searchable"))
    open_ = links.where("status <> 'resolved'").groupBy(by).agg(F.count("*").alias("unresolved"))
    lost = figures.where("status NOT IN ('raster', 'safe_svg')").groupBy(by).agg(F.count("*").alias("unavailable"))
    none = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return held.join(open_, by, "left").join(lost, by, "left").select(by, "documents", "searchable", none("unresolved"), none("unavailable"))


def index_rows(rows: DataFrame, group: str, order: str, most: int = INDEX_CAP) -> DataFrame:
    """(group, order, place, left_out): the first rows of each group, and on the last of these how many there are besides."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    shown = rows.select(group, order).withColumn("place", place).where(F.col("place") <= most)
    sizes = rows.groupBy(group).agg(F.count("*").alias("__all"))
    left = F.when(F.col("place") == most, F.col("__all") - most)
    return shown.join(sizes, group).select(group, order, "place", F.when(left > 0, left).alias("left_out"))


def phrase_hits(docs: DataFrame, phrases: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, phrase): documents that hold a phrase between word ends, with blanks of any width."""
    held = F.array_compact(F.array(*[F.when(F.col(text_column).rlike(T.phrase_pattern(p)), F.lit(p)) for p in phrases]))
    return docs.select(id_column, F.explode(held).alias("phrase"))


def not_within(rows: DataFrame, allowed: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of the rows that aren't allowed; none where the rows are a subset."""
    return rows.select(*keys).distinct().join(allowed.select(*keys).distinct(), list(keys), "left_anti")


def case_insensitive_paths(links: DataFrame, members: DataFrame, path_column: str = "path") -> DataFrame:
    """Links with ``member``: the path as it is, where there is such a member, else the first that differs in case only."""
    exact = members.select(F.col("path").alias("__exact")).distinct()
    folded = members.groupBy(F.lower("path").alias("__folded")).agg(F.min("path").alias("__first"))
    joined = links.join(exact, F.col(path_column) == F.col("__exact"), "left").join(folded, F.lower(path_column) == F.col("__folded"), "left")
    return joined.withColumn("member", F.coalesce("__exact", "__first")).drop("__exact", "__folded", "__first")


def parents(path: Column) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def empty_directories(directories: DataFrame, members: DataFrame) -> DataFrame:
    """(path) of directories (path) with no member (path) in them or below."""
    full = members.select(F.explode(parents(F.col("path"))).alias("path"))
    return not_within(directories, full, "path")


# ---------------------------------------------------------------- queries


def q_extension_counts(spark, sf_dir):
    return extension_counts(load(spark, sf_dir, "pages"), "url")


def q_prefix_vote(spark, sf_dir):
    return prefix_votes(load(spark, sf_dir, "part"), "p_brand", "p_name")


def q_book_summary(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderkey")
    made = book_summary(rows, "o_custkey", "year", "o_orderpriority", "o_orderkey")
    return made.select("o_custkey", F.concat_ws(",", F.col("years").cast("array<string>")).alias("years"), F.concat_ws(",", "models").alias("models"))


def q_latency_p95(spark, sf_dir):
    return latencies(load(spark, sf_dir, "events"), "event_type", "value")


def q_unresolved_references(spark, sf_dir):
    """Documents, their words as links that lead to sources or nowhere, and lines with marks as figures."""
    docs = load(spark, sf_dir, "documents")
    words = docs.select("source", F.explode(F.split("text", " ")).alias("word"))
    links = words.select("source", F.when(F.length("word") > 3, "resolved").otherwise("missing").alias("status"))
    figures = docs.select("source", F.element_at(F.array(*[F.lit(x) for x in ("raster", "safe_svg", "blocked")]), (F.col("n_chars") % 3 + 1).cast("int")).alias("status"))
    return normalization_summary(docs, links, figures)


def q_index_rows(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("lang", "doc_id")
    return index_rows(rows, "lang", "doc_id").withColumn("place", F.col("place").cast("long"))


_PHRASES = ["the and", "and the", "der die", "de la"]


def q_phrase_hits(spark, sf_dir):
    return phrase_hits(load(spark, sf_dir, "documents"), _PHRASES)


def q_subset_breaches(spark, sf_dir):
    """Orders of lines that no order of the first status has."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey")
    orders = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return not_within(lines, orders, "l_orderkey")


def q_empty_directories(spark, sf_dir):
    """Folders of all pages' addresses in which no address ends in a name with an extension."""
    pages = load(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://|[?#].*$", "").alias("path"))
    folders = pages.select(F.explode(parents(F.col("path"))).alias("path"))
    return empty_directories(folders, pages.where(extension(F.col("path")) == ".html"))


QUERIES = {
    "extension_counts": q_extension_counts,
    "prefix_vote": q_prefix_vote,
    "book_summary": q_book_summary,
    "latency_p95": q_latency_p95,
    "unresolved_references": q_unresolved_references,
    "index_rows": q_index_rows,
    "phrase_hits": q_phrase_hits,
    "subset_breaches": q_subset_breaches,
    "empty_directories": q_empty_directories,
}

_NAME = r"lower(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1))"
_PATHS = "SELECT regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path FROM pages"

ORACLE_SQL = {
    "extension_counts": rf"SELECT regexp_extract({_NAME}, '(\.[a-z0-9]+)$', 1) AS extension, count(*) AS n FROM pages GROUP BY 1",
    "prefix_vote": "WITH v AS (SELECT p_brand, substr(p_name, 1, 3) AS prefix, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, prefix, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, prefix DESC) AS k FROM v) WHERE k = 1",
    "book_summary": """WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
      SELECT o_custkey, years, models FROM (SELECT o_custkey, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS years FROM orders GROUP BY 1)
      JOIN (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY k) AS models FROM f GROUP BY 1) USING (o_custkey)""",
    "latency_p95": "SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS median FROM events GROUP BY 1",
    "unresolved_references": r"""WITH d AS (SELECT source, text, n_chars, string_split(text, ' ') AS w FROM documents)
      SELECT source, count(*) AS documents, count(*) FILTER (trim(text) <> '') AS searchable, CAST(sum(len(list_filter(w, lambda x: length(x) <= 3))) AS BIGINT) AS unresolved,
        count(*) FILTER (n_chars % 3 = 2) AS unavailable FROM d GROUP BY 1""",
    "index_rows": f"""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents)
      SELECT lang, doc_id, place, CASE WHEN place = {INDEX_CAP} AND n > {INDEX_CAP} THEN n - {INDEX_CAP} END AS left_out FROM r WHERE place <= {INDEX_CAP}""",
    "phrase_hits": " UNION ALL ".join(
        f"SELECT doc_id, '{p}' AS phrase FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])" + "\\s+".join(p.split()) + "($|[^\\p{L}\\p{N}_])')" for p in _PHRASES
    ),
    "subset_breaches": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "empty_directories": rf"""WITH p AS ({_PATHS}), d AS (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM p), f AS (SELECT DISTINCT array_to_string(string_split(path, '/')[:k], '/') AS path FROM d)
      SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE starts_with(p.path, f.path || '/') AND lower(p.path) LIKE '%.html')""",
}
