"""Names of a vocabulary found in texts by joins.

A text becomes tokens: words, and single characters that are none; white space is
one blank between them. A name can begin where a token does. Only tokens that a
name begins with go on, each with the tokens ahead of it, as many as the longest
name has; of these, a string is cut for each number of tokens that names with this
first token have, and joined with the names by equality. So the vocabulary is a
table of any size, and a text is never compared with a name that isn't there.

Spans of one text that overlap are a cluster by a window over their places; in each
the longest is kept first, then those that no kept one overlaps. Where all names of
a kind are single tokens none overlaps another, so ``mentions`` asks each text for
its distinct tokens instead of their places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.fixpoint import reliable
from quire.plans.sizes import small

_WORD = r"[\p{L}\p{N}_]"
_TOKEN = rf" ?(?:{_WORD}+|[^\p{{L}}\p{{N}}_ ])"


def folded(text: Column) -> Column:
    """Lower case, white space as single blanks."""
    return T.compact(F.lower(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    """The tokens of a folded text, each with the blank before it; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _bare(token: Column) -> Column:
    return F.ltrim(token)


def _only_year(text: Column) -> Column:
    years = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b((?:19|20)[0-9]{2})\b"), F.lit(1)))
    return F.when(F.size(years) == 1, F.get(years, F.lit(0))).cast("int")


def _keyed(names: DataFrame) -> DataFrame:
    """Names with their folded literal, first token and number of tokens; ``rank`` orders names alike."""
    order = F.col("ord") if "ord" in names.columns else F.lit(0)
    rank = F.struct(order.alias("ord"), "kind", "target_id", "literal", "year_start", "year_end")
    rows = names.select("kind", "target_id", "year_start", "year_end", folded(F.col("literal")).alias("key"), rank.alias("rank")).where("key <> ''")
    parts = tokens(F.col("key"))
    return rows.select("*", _bare(F.get(parts, F.lit(0))).alias("first"), F.size(parts).alias("n"))


def _read(statements: DataFrame) -> DataFrame:
    """(id, said, year, tokens) of statements; ``said`` tells texts of one id apart."""
    year = F.col("year").cast("int") if "year" in statements.columns else _only_year(F.col("statement"))
    return statements.select("id", F.xxhash64("statement").alias("said"), year.alias("year"), tokens(folded(F.col("statement"))).alias("tokens"))


def _free(token: Column, k: Column) -> Column:
    """Whether a name can begin at this token: inside a word or behind one none does."""
    return (k == 0) | token.startswith(" ") | token.rlike(rf"^{_WORD}") | ~F.coalesce(F.get("tokens", k - 1).rlike(rf"{_WORD}$"), F.lit(False))


def _ends(after: Column) -> Column:
    """Whether a name can end before this token."""
    return after.isNull() | after.startswith(" ") | ~after.rlike(rf"^{_WORD}")


_IN_YEARS = "year_start IS NULL OR year BETWEEN year_start AND year_end"


def candidates(statements: DataFrame, names: DataFrame) -> DataFrame:
    """(id, said, kind, target_id, rank, start, n, chars): every place where a name stands between word ends, by token numbers.

    ``said`` tells texts of one id apart. A name with years counts only where the
    statement's year lies between them.
    """
    names = _keyed(names)
    longest = names.agg(F.max("n")).first()[0] or 0
    rows = _read(statements)
    places = F.transform("tokens", lambda token, k: F.struct(k.alias("start"), _bare(token).alias("first"), F.slice("tokens", k + 1, longest + 1).alias("ahead"), _free(token, k).alias("free")))
    begun = rows.select("id", "said", "year", F.explode(F.filter(places, lambda place: place["free"])).alias("p")).select("id", "said", "year", "p.start", "p.first", "p.ahead")
    sizes = names.groupBy("first").agg(F.collect_set("n").alias("sizes"))  # the longest name's tokens at most
    begun = begun.join(small(sizes), "first").select("id", "said", "year", "start", "ahead", F.explode("sizes").alias("n"))
    cut = begun.where((F.size("ahead") >= F.col("n")) & _ends(F.get("ahead", F.col("n")))).select("id", "said", "year", "start", "n", _bare(F.array_join(F.slice("ahead", 1, F.col("n")), "")).alias("key"))
    met = cut.join(small(names.drop("first", "n")), "key").where(_IN_YEARS)
    return met.select("id", "said", "kind", "target_id", "rank", "start", "n", F.length("key").alias("chars"))


def spans(statements: DataFrame, names: DataFrame) -> DataFrame:
    """(id, kind, target_id, start, n): names that no longer one of their kind overlaps; of names alike the first counts."""
    found = candidates(statements, names)
    text = ["id", "said", "kind"]
    before = Window.partitionBy(*text).orderBy("start", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("start") >= F.max(F.col("start") + F.col("n")).over(before), F.lit(True))
    upto = Window.partitionBy(*text).orderBy("start", F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clusters = found.withColumn("begins", begins.cast("int")).withColumn("cluster", F.sum("begins").over(upto))
    one = F.struct((-F.col("chars")).alias("shorter"), "rank", "start", "n", "target_id")
    sorted_ = clusters.groupBy(*text, "cluster").agg(F.sort_array(F.collect_list(one)).alias("all"))  # places that overlap one another
    overlaps = lambda a, b: (a["start"] < b["start"] + b["n"]) & (b["start"] < a["start"] + a["n"])
    keep = lambda kept, one: F.when(F.exists(kept, lambda other: overlaps(one, other)), kept).otherwise(F.concat(kept, F.array(one)))
    kept = F.aggregate("all", F.slice("all", 1, 0), keep)
    return sorted_.select("id", "kind", F.explode(kept).alias("s")).select("id", "kind", "s.target_id", "s.start", "s.n")


def _single(statements: DataFrame, names: DataFrame) -> DataFrame:
    """(id, kind, target_id) of names of one token each, which can't overlap; a token counts once in a text."""
    # of names alike and of the same years only the first can count
    names = _keyed(names).groupBy("kind", "key", "year_start", "year_end").agg(F.min("rank").alias("rank"))
    whole = F.filter("tokens", lambda token, k: _free(token, k) & _ends(F.get("tokens", k + 1)))
    held = _read(statements).select("id", "said", "year", F.explode(F.array_distinct(F.transform(whole, _bare))).alias("key"))
    met = held.join(small(names), "key").where(_IN_YEARS)
    return met.groupBy("id", "said", "kind", "key").agg(F.min("rank").alias("rank")).select("id", "kind", "rank.target_id")


def mentions(statements: DataFrame, names: DataFrame) -> DataFrame:
    """(id, kind, target_id): the makes, models and engines that a statement names.

    ``names`` has kind, target_id, literal, year_start, year_end and may have ord,
    which tells which of names alike counts; one with years counts only where the
    statement's year lies between them. That is column ``year`` where there is
    one, else the statement's only year.
    """
    names = reliable(names)
    kinds = _keyed(names).groupBy("kind").agg(F.max("n").alias("longest")).where("longest = 1").select("kind")
    single, rest = (names.join(kinds, "kind", how) for how in ("left_semi", "left_anti"))
    found = [read(statements, some) for read, some in ((_single, single), (spans, rest)) if not some.isEmpty()] or [spans(statements, rest)]
    return reduce(DataFrame.unionByName, (some.select("id", "kind", "target_id") for some in found)).distinct()


# ---------------------------------------------------------------- queries


def q_first_word_mentions(spark, sf_dir) -> DataFrame:
    """How many of the words that documents begin with each document names, and the first of them by name.

    The vocabulary grows with the documents: their first words, as they stand there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast("int")
    first = F.regexp_extract("text", rf"^{_WORD}+", 0)
    names = docs.select(F.lit("opening").alias("kind"), F.lower(first).alias("target_id")).where("target_id <> ''").distinct()
    names = names.select("kind", "target_id", F.col("target_id").alias("literal"), none.alias("year_start"), none.alias("year_end"))
    # texts are dealt out by id, so none of their words are
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("statement")).repartition("id")
    found = mentions(texts, names)
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("openings"), F.min("target_id").alias("first"))


QUERIES = {"first_word_mentions": q_first_word_mentions}

ORACLE_SQL = {
    "first_word_mentions": r"""WITH v AS (SELECT DISTINCT lower(regexp_extract(text, '^[\p{L}\p{N}_]+')) AS name FROM documents),
      w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents)
      SELECT doc_id, count(*) AS openings, min(word) AS first FROM w JOIN v ON word = name WHERE name <> '' GROUP BY 1""",
}
