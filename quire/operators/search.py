"""Inverted index, scoped TF-IDF search and BM25 ranking with prefix widening."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.fixpoint import reliable

TF_CAP = 255
K1, B = 1.2, 0.35
WIDENED, WIDENED_WEIGHT = 81, 0.6
RESULT_CAP = 150


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query_terms(query: str) -> list[str]:
    """Terms of a library query, in order, repeats included."""
    return [word.casefold() for word in re.findall(r"\w+", query)]


def site_terms(query: str) -> list[str]:
    """Distinct terms of a site query, in order."""
    return list(dict.fromkeys(re.findall(T.SITE_TOKEN, query.lower())))


def term_counts(docs: DataFrame, tokens: Column, id_column: str = "doc_id") -> DataFrame:
    """(id, term, tf) of the tokens of every document."""
    return docs.select(id_column, F.explode(tokens).alias("term")).groupBy(id_column, "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df), exact."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def postings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(term, id, tf) without stop words, tf capped; rows of one id are counted together, in one task.

    Texts are dealt out by id, so their words, which are more, need not be.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(id_column, text_column).repartition(tasks, id_column)
    found = term_counts(texts, T.indexed_tokens(F.col(text_column)), id_column)
    return found.select("term", id_column, F.least(F.lit(TF_CAP), "tf").cast("long").alias("tf"))


def document_lengths(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, dl): indexed tokens, uncapped, one at least."""
    return docs.select(id_column, F.greatest(F.lit(1), F.size(T.indexed_tokens(F.col(text_column)))).cast("long").alias("dl"))


def _alone(term: str) -> str:
    """A pattern for the term as a whole library token."""
    word = re.escape(term)
    return rf"{word}(?<![\p{{L}}\p{{N}}_]{word})(?![\p{{L}}\p{{N}}_])"


def _begins(term: str):
    return lambda word: word.startswith(term)


def scoped_search(scope: DataFrame, query: str, limit: int = 100, id_column: str = "doc_id", text_column: str = "text", digits: int | None = None) -> DataFrame:
    """(id, score, snippet) of the documents of a scope that hold all terms of the query.

    The score sums tf * ln((N + 1) / (df + 1)) over the query's terms, repeats
    included; N and df count the scope. Tokens are counted in place, for the
    query's terms only and once: ids and counts are kept, and texts are read again
    for the top rows alone, which are no more than ``limit``.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    terms = query_terms(query)
    if not terms:
        return scope.select(id_column, F.lit(0.0).alias("score"), F.lit("").alias("snippet")).limit(0)
    distinct = list(dict.fromkeys(terms))
    low = F.col("__low")
    # a term's tokens are counted where they stand, between characters that no token holds
    tf = [F.when(low.contains(t), F.regexp_count(low, F.lit(_alone(t)))).otherwise(0).alias(f"tf{k}") for k, t in enumerate(distinct)]
    # texts are read once: what is kept has a term, and the number of all is told by the way
    met = Observation()
    folded = scope.select(F.col(id_column).alias("id"), T.casefold(F.col(text_column)).alias("__low"))
    counted = folded.select("id", *tf).observe(met, F.count(F.lit(1)).alias("n"))
    counted = reliable(counted.where(" or ".join(f"tf{k} > 0" for k in range(len(distinct)))))
    return _top_scored(scope, counted, met.get["n"], terms, distinct, limit, id_column, text_column, digits)


def _top_scored(scope, counted, n, terms, distinct, limit, id_column, text_column, digits) -> DataFrame:
    """The best rows by the counts (id, tf0, tf1, ...) of the documents that hold a term, with their snippets."""
    numbers = range(len(distinct))
    sums = counted.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in numbers])
    # one row of counts joins every hit
    hits = counted.where(" and ".join(f"tf{k} > 0" for k in numbers)).crossJoin(F.broadcast(sums))
    score = sum(
        (F.col(f"tf{distinct.index(t)}") * F.log((F.lit(n) + 1) / (F.col(f"df{distinct.index(t)}") + 1)) for t in terms), F.lit(0.0)
    )
    score = F.round(score, digits) if digits is not None else score
    best = hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    shown = scope.join(F.broadcast(best), scope[id_column] == F.col("id"))  # limit rows at most
    rows = shown.select(id_column, "score", T.snippet(F.col(text_column), distinct).alias("snippet"))
    return rows.orderBy(F.desc("score"), id_column).limit(limit)  # where ids repeat, too


def _widened(index: DataFrame, terms: list[str]) -> DataFrame:
    """(query, term, weight): each query term itself and the first longer terms that begin with it."""
    vocabulary = index.select("term").distinct()
    exact = vocabulary.where(F.col("term").isin(terms)).select(F.col("term").alias("query"), "term", F.lit(1.0).alias("weight"))
    longer = None
    for t in terms:
        # ordered and cut per term: bounded by WIDENED rows
        more = vocabulary.where(F.col("term").startswith(t) & (F.col("term") != t)).orderBy("term").limit(WIDENED)
        more = more.select(F.lit(t).alias("query"), "term", F.lit(WIDENED_WEIGHT).alias("weight"))
        longer = more if longer is None else longer.unionByName(more)
    return exact.unionByName(longer)


def document_stats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", title: Column | None = None) -> DataFrame:
    """(id, dl, title, title_tokens) of every document; the title is its first line by default."""
    title = title if title is not None else F.split(F.col(text_column), "\n")[0]
    return docs.select(
        id_column,
        F.greatest(F.lit(1), F.size(T.indexed_tokens(F.col(text_column)))).alias("dl"),
        F.lower(title).alias("title"),
        T.site_tokens(title).alias("title_tokens"),
    )


def rank(index: DataFrame, stats: DataFrame, query: str, id_column: str = "doc_id", n: int | None = None, avgdl: float | None = None) -> DataFrame:
    """(id, score, matched) by BM25 with prefix widening, coverage and title boosts; not cut.

    Postings of the terms that begin with a term of the query are read once; the
    widened terms are bounded, so they are broadcast to the postings; the index is
    never shuffled as a whole. Figures of documents are read for those that hold a
    term; how many documents there are and their mean length come from the caller,
    or from ``stats``, which then has all documents.
    """
    terms = site_terms(query)
    if not terms:
        return stats.select(id_column, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched")).limit(0)
    # the few terms that the query can reach are read once
    index = reliable(index.where(functools.reduce(operator.or_, [F.col("term").startswith(t) for t in terms])))
    reach = F.broadcast(_widened(index, terms))  # WIDENED rows a term at most
    hits = index.join(reach, "term").groupBy("query", id_column).agg(F.sum(F.col("tf") * F.col("weight")).alias("tf"))
    frequency = hits.groupBy("query").agg(F.count("*").alias("df"))
    if n is None:
        n, avgdl = stats.agg(F.count("*"), F.avg("dl")).first()
    idf = frequency.select("query", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.lit(avgdl).alias("avgdl"))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    body = (
        hits.join(F.broadcast(idf), "query")
        .join(stats.select(id_column, "dl"), id_column)
        .groupBy(id_column)
        .agg(F.sum(F.col("idf") * norm).alias("s"), F.count("*").alias("m"))
    )
    known = idf.agg(F.map_from_entries(F.collect_list(F.struct("query", "idf"))).alias("idfs"), F.count("*").alias("used"))
    scored = body.join(stats, id_column).crossJoin(F.broadcast(known))
    in_title = [F.exists("title_tokens", _begins(t)) for t in terms]
    boost = sum((F.when(hit, F.coalesce(F.try_element_at("idfs", F.lit(t)), F.lit(1.0))).otherwise(0.0) for t, hit in zip(terms, in_title, strict=True)), F.lit(0.0))
    count = sum((hit.cast("int") for hit in in_title), F.lit(0))
    score = F.col("s") * F.pow(F.col("m") / F.greatest(F.lit(1), "used"), F.lit(2))
    score = F.when((F.col("used") > 1) & (F.col("m") < F.col("used")), score * 0.3).otherwise(score) + boost * 7
    score = F.when(count == len(terms), score * 2.2).otherwise(score)
    phrase = query.strip().lower()
    score = F.when(F.col("title").contains(phrase), score * 3).otherwise(score) if phrase else score
    return scored.select(id_column, score.alias("score"), F.col("m").alias("matched"))


def bm25(docs: DataFrame, query: str, id_column: str = "doc_id", text_column: str = "text", title: Column | None = None) -> DataFrame:
    """``rank`` over documents without an index: each text is tokenised once, and what is kept holds a term that the query reaches."""
    terms = site_terms(query)
    if not terms:
        return docs.select(id_column, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched")).limit(0)
    title = title if title is not None else F.split(F.col(text_column), "\n")[0]
    tokens = docs.select(id_column, title.alias("title"), T.indexed_tokens(F.col(text_column)).alias("tokens"))
    reached = F.filter("tokens", lambda token: functools.reduce(operator.or_, [token.startswith(t) for t in terms]))
    figures = tokens.select(id_column, F.greatest(F.lit(1), F.size("tokens")).alias("dl"), F.lower("title").alias("title"), T.site_tokens(F.col("title")).alias("title_tokens"), reached.alias("reached"))
    met = Observation()
    held = reliable(figures.observe(met, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).where(F.size("reached") > 0))
    counts = held.select(id_column, F.explode("reached").alias("term")).groupBy(id_column, "term").agg(F.least(F.lit(TF_CAP), F.count("*")).cast("long").alias("tf"))
    return rank(counts.select("term", id_column, "tf"), held.drop("reached"), query, id_column, met.get["n"], met.get["avgdl"])


def save_index(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", title: Column | None = None) -> None:
    """Postings in a folder for each first letter, sorted by term; beside them the documents' figures, and one row over all of these."""
    index = postings(docs, id_column, text_column).withColumn("initial", F.substring("term", 1, 1))
    index.repartition("initial", F.pmod(F.xxhash64("term"), F.lit(16))).sortWithinPartitions("initial", "term").write.partitionBy("initial").parquet(f"{path}/postings")
    document_stats(docs, id_column, text_column, title).write.parquet(f"{path}/documents")
    docs.sparkSession.read.parquet(f"{path}/documents").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{path}/totals")


def indexed_search(spark, path: str, query: str, id_column: str = "doc_id") -> DataFrame:
    """``rank`` over a saved index: only the folders of the query's first letters are read."""
    initials = sorted({t[0] for t in site_terms(query)})
    index = spark.read.schema(f"term string, {id_column} bigint, tf bigint, initial string").parquet(f"{path}/postings")
    n, avgdl = spark.read.parquet(f"{path}/totals").first()
    return rank(index.where(F.col("initial").isin(initials)).drop("initial"), spark.read.parquet(f"{path}/documents"), query, id_column, n, avgdl)


def top(ranked: DataFrame, k: int = RESULT_CAP, id_column: str = "doc_id") -> DataFrame:
    return ranked.orderBy(F.desc("score"), id_column).limit(k)


def facets(hits: DataFrame, column: str) -> DataFrame:
    """(column, hits) over all hits, before any filter or cut."""
    return hits.groupBy(column).agg(F.count("*").alias("hits"))


def collapse(ranked: DataFrame, group: str, keep: int = 2, id_column: str = "doc_id", most: int | None = None) -> DataFrame:
    """The first rows of each group, and one row that tells how many more there are; rows without a group all stay.

    Given ``most``, the first so many of these rows by score; the row that tells of
    more stands where the first of them would.
    """
    grouped = ranked.where(F.col(group).isNotNull())
    order = Window.partitionBy(group).orderBy(F.desc("score"), id_column)
    placed = grouped.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep + 1)
    sizes = grouped.groupBy(group).agg(F.count("*").alias("members"))
    more = F.when(F.col("place") > keep, F.col("members") - keep).cast("long")
    rows = placed.join(sizes, group).select(group, id_column, "score", more.alias("more"))
    rows = rows.unionByName(ranked.where(F.col(group).isNull()).select(group, id_column, "score", F.lit(None).cast("long").alias("more")))
    rows = rows.orderBy(F.desc("score"), id_column).limit(most) if most is not None else rows
    return rows.select(group, F.when(F.col("more").isNull(), F.col(id_column)).alias(id_column), "score", "more")


def filtered(ranked: DataFrame, column: str, chosen=None, k: int = RESULT_CAP, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(facets, results): hits by the column's values, all of them, and the best rows of the chosen value, or of all."""
    held = ranked if chosen is None else ranked.where(F.col(column) == F.lit(chosen))
    return facets(ranked, column), top(held, k, id_column)


# ---------------------------------------------------------------- queries

_SCOPE, _QUERY, _SECOND = "lang = 'en'", "the and", "est que de"
_BM25 = "the thand er"


def q_tokens_library(spark, sf_dir):
    words = T.library_tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("terms"))


def q_tokens_site(spark, sf_dir):
    words = T.site_tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("terms"))


def q_doc_frequency(spark, sf_dir):
    return document_frequency(documents(spark, sf_dir), T.library_tokens(F.col("text")))


def q_postings(spark, sf_dir):
    return postings(documents(spark, sf_dir))


def q_doc_lengths(spark, sf_dir):
    return document_lengths(documents(spark, sf_dir))


def q_scoped_search(spark, sf_dir):
    return scoped_search(documents(spark, sf_dir).where(_SCOPE), _QUERY, digits=6)


def q_search_topk(spark, sf_dir):
    return scoped_search(documents(spark, sf_dir).where("lang = 'fr'"), _SECOND, limit=20, digits=6).drop("snippet")


def q_snippets(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.snippet(F.col("text"), ["tion", "ment"]).alias("snippet"))


def q_bm25_search(spark, sf_dir):
    ranked = bm25(documents(spark, sf_dir), _BM25).withColumn("score", F.round("score", 6))
    return top(ranked)


def _hits(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ranked = bm25(docs, _BM25).withColumn("score", F.round("score", 6))
    return ranked.join(docs.select("doc_id", "source", "lang"), "doc_id")


def q_facet_counts(spark, sf_dir):
    return facets(_hits(spark, sf_dir), "source")


def q_collapse(spark, sf_dir):
    """Hits by source; those of every third document have none."""
    source = F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source")
    return collapse(_hits(spark, sf_dir).select("doc_id", "score", source), "source")


def q_collapsed_results(spark, sf_dir):
    """The rows of a result page: one language, collapsed by source, capped."""
    rows = _hits(spark, sf_dir).where("lang = 'en'")
    return collapse(rows.select("doc_id", "score", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source")), "source", most=RESULT_CAP)


def q_filtered_search(spark, sf_dir):
    """Of one language the best hits, each with how many hits the language has."""
    counts, rows = filtered(_hits(spark, sf_dir), "lang", "en")
    return rows.join(counts, "lang").select("lang", "doc_id", "score", "hits")


QUERIES = {
    "tokens_library": q_tokens_library,
    "tokens_site": q_tokens_site,
    "doc_frequency": q_doc_frequency,
    "postings": q_postings,
    "doc_lengths": q_doc_lengths,
    "scoped_search": q_scoped_search,
    "search_topk": q_search_topk,
    "snippets": q_snippets,
    "bm25_search": q_bm25_search,
    "facet_counts": q_facet_counts,
    "collapse_two_per_group": q_collapse,
    "collapsed_results": q_collapsed_results,
    "filtered_search": q_filtered_search,
}

# of the letters whose folding isn't their lower case, the tables have one
FOLD_SQL = "replace(lower(text), 'ß', 'ss')"
_LIB = f"regexp_extract_all({FOLD_SQL}, '{T.LIBRARY_TOKEN}')"


def _site(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '" + T.SITE_TOKEN.replace("'", "''") + "')"


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_INDEXED = f"list_filter({_site('text')}, lambda t: t NOT IN ({_STOPS}))"


def _snippet_sql(terms):
    places = ", ".join(f"nullif(strpos({FOLD_SQL}, '{t}'), 0)" for t in terms)
    return f"substr(text, greatest(coalesce(least({places}), 1) - 1 - 60, 0) + 1, coalesce(least({places}), 1) - 1 + 160 - greatest(coalesce(least({places}), 1) - 1 - 60, 0))"


def _tfidf_sql(scope, query, limit, with_snippet):
    terms = query_terms(query)
    distinct = list(dict.fromkeys(terms))
    counts = ", ".join(f"len(list_filter(w, lambda t: t = '{t}')) AS tf{k}" for k, t in enumerate(distinct))
    frequencies = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(distinct)))
    score = " + ".join(f"tf{distinct.index(t)} * ln((n + 1) / (df{distinct.index(t)} + 1))" for t in terms)
    return f"""
WITH c AS (SELECT doc_id, text, {counts} FROM (SELECT doc_id, text, {_LIB} AS w FROM documents WHERE {scope})),
s AS (SELECT count(*) AS n, {frequencies} FROM c)
SELECT doc_id, round({score}, 6) AS score {', ' + _snippet_sql(distinct) + ' AS snippet' if with_snippet else ''}
FROM c, s WHERE {' AND '.join(f'tf{k} > 0' for k in range(len(distinct)))}
ORDER BY round({score}, 6) DESC, doc_id LIMIT {limit}"""


def _bm25_sql(query):
    terms = site_terms(query)
    listed = ", ".join(f"('{t}')" for t in terms)
    titles = [f"len(list_filter(title_tokens, lambda w: starts_with(w, '{t}'))) > 0" for t in terms]
    boost = " + ".join(f"CASE WHEN {hit} THEN coalesce((SELECT idf FROM idf WHERE query = '{t}'), 1.0) ELSE 0 END" for t, hit in zip(terms, titles, strict=True))
    count = " + ".join(f"CAST({hit} AS INT)" for hit in titles)
    return f"""
WITH d AS (SELECT doc_id, source, {_INDEXED} AS tokens, lower(split_part(text, chr(10), 1)) AS title,
    {_site("split_part(text, chr(10), 1)")} AS title_tokens FROM documents),
lengths AS (SELECT doc_id, source, greatest(1, len(tokens)) AS dl, title, title_tokens FROM d),
p AS (SELECT term, doc_id, least(255, count(*)) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM d) GROUP BY 1, 2),
q(query) AS (VALUES {listed}),
v AS (SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY term) AS place
      FROM (SELECT DISTINCT term FROM p) t JOIN q ON starts_with(term, query) AND term <> query),
reach AS (SELECT query, query AS term, 1.0 AS weight FROM q UNION ALL SELECT query, term, {WIDENED_WEIGHT} FROM v WHERE place <= {WIDENED}),
hits AS (SELECT query, doc_id, sum(CAST(tf AS DOUBLE) * CAST(weight AS DOUBLE)) AS tf FROM p JOIN reach USING (term) GROUP BY 1, 2),
sums AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
idf AS (SELECT query, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT query, count(*) AS df FROM hits GROUP BY 1), sums),
body AS (SELECT doc_id, sum(idf * (tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl)))) AS s, count(*) AS m
         FROM hits JOIN idf USING (query) JOIN lengths USING (doc_id), sums GROUP BY 1),
used AS (SELECT count(*) AS used FROM idf),
ranked AS (SELECT doc_id, source, m AS matched, round(
    (s * pow(m / greatest(1, used), 2) * CASE WHEN used > 1 AND m < used THEN 0.3 ELSE 1 END + ({boost}) * 7)
    * CASE WHEN {count} = {len(terms)} THEN 2.2 ELSE 1 END
    * CASE WHEN contains(title, '{query}') THEN 3 ELSE 1 END, 6) AS score
  FROM body JOIN lengths USING (doc_id), used)"""


_COLLAPSED = """, placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY source) AS members
    FROM (SELECT doc_id, score, CASE WHEN doc_id % 3 > 0 THEN source END AS source FROM h))
  SELECT source, CASE WHEN source IS NULL OR place <= 2 THEN doc_id END AS doc_id, score, CASE WHEN source IS NOT NULL AND place > 2 THEN members - 2 END AS more, doc_id AS own
  FROM placed WHERE source IS NULL OR place <= 3"""

ORACLE_SQL = {
    "tokens_library": f"SELECT doc_id, len({_LIB}) AS tokens, len(list_distinct({_LIB})) AS terms FROM documents",
    "tokens_site": f"SELECT doc_id, len({_site('text')}) AS tokens, len(list_distinct({_site('text')})) AS terms FROM documents",
    "doc_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_LIB})) AS term FROM documents) GROUP BY 1",
    "postings": f"SELECT term, doc_id, least(255, count(*)) AS tf FROM (SELECT doc_id, unnest({_INDEXED}) AS term FROM documents) GROUP BY 1, 2",
    "doc_lengths": f"SELECT doc_id, greatest(1, len({_INDEXED})) AS dl FROM documents",
    "scoped_search": _tfidf_sql(_SCOPE, _QUERY, 100, True),
    "search_topk": _tfidf_sql("lang = 'fr'", _SECOND, 20, False),
    "snippets": f"SELECT doc_id, {_snippet_sql(['tion', 'ment'])} AS snippet FROM documents",
    "bm25_search": _bm25_sql(_BM25) + f" SELECT doc_id, score, matched FROM ranked ORDER BY score DESC, doc_id LIMIT {RESULT_CAP}",
    "facet_counts": _bm25_sql(_BM25) + " SELECT source, count(*) AS hits FROM ranked GROUP BY 1",
    "collapse_two_per_group": _bm25_sql(_BM25) + ", h AS (SELECT * FROM ranked)" + _COLLAPSED,
    "collapsed_results": _bm25_sql(_BM25) + ", h AS (SELECT ranked.* FROM ranked JOIN documents USING (doc_id) WHERE lang = 'en')" + _COLLAPSED + f" ORDER BY score DESC, own LIMIT {RESULT_CAP}",
    "filtered_search": _bm25_sql(_BM25)
    + f""" SELECT lang, doc_id, score, hits FROM ranked JOIN documents USING (doc_id) JOIN (SELECT lang, count(*) AS hits FROM ranked JOIN documents USING (doc_id) GROUP BY 1) USING (lang)
      WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT {RESULT_CAP}""",
}
ORACLE_SQL["collapsed_results"] = "SELECT source, doc_id, score, more FROM (" + ORACLE_SQL["collapsed_results"] + ")"
ORACLE_SQL["collapse_two_per_group"] = "SELECT source, doc_id, score, more FROM (" + ORACLE_SQL["collapse_two_per_group"] + ")"
