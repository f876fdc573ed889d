"""Filter interaction audit: what every order of filters removes, and each filter's Shapley value.

A document fails some of the filters; which ones is its mask, and all that an audit
needs is the number of documents of each mask in a part. They make the part's
removal polynomial: with filter i switched on with probability x_i, the expected
number of removed documents is the multilinear

    R(x) = sum over masks m of n(m) * (1 - product over i in m of (1 - x_i)),

whose coefficient at a set T is (-1)^(|T|+1) times the number of documents that
fail all of T. A corner of the cube, x_i being 1 for a set of filters and 0 for the
others, says what these filters remove together, so corners give survivors,
removals and unique failures of every order; the integral of a partial derivative
along the diagonal is that filter's Shapley value. Integrals are exact rationals,
and as many times them as there are orders is a whole number.

Masks are DataFrame expressions and counts are partial aggregates, so what is
shuffled of a document is a digest and a few small columns. A part is one row of
at most 2^n counts from there on.

Defined results: a null text counts as empty; a null part as the empty string, one
part with it; copies are found by digest over the whole table, and of equal texts
those with the smallest id are the first, all of them if the id repeats; a null id
is no larger than any other, so it copies nothing, and has no labels; a label given
several times for an id counts as 1 if any of them does; repeated rows count each;
an empty table has no parts and gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import table

FILTERS = "ABCDE"
#: Filter E, copies, is the one that needs the whole table.
COPIES = FILTERS.index("E")


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients by set of filters (bits) from the number of documents of each mask."""
    failing_all = list(counts)
    for bit in range(len(counts).bit_length() - 1):
        for some in range(len(counts)):
            if not some >> bit & 1:
                failing_all[some] += failing_all[some | 1 << bit]
    return [0] + [failing_all[some] * (1 if some.bit_count() % 2 else -1) for some in range(1, len(counts))]


def corners(polynomial: list[int]) -> list[int]:
    """Its values where the filters of a set are on and the others off, by set."""
    values = list(polynomial)
    for bit in range(len(values).bit_length() - 1):
        for some in range(len(values)):
            if some >> bit & 1:
                values[some] += values[some ^ 1 << bit]
    return values


def shapley(polynomial: list[int], which: int) -> Fraction:
    """The integral of the partial derivative by one variable along the diagonal from 0 to 1."""
    along = [0] * (len(polynomial).bit_length() - 1)  # the derivative there, by power
    for some, value in enumerate(polynomial):
        if some >> which & 1:
            along[some.bit_count() - 1] += value
    return sum((Fraction(value, power + 1) for power, value in enumerate(along)), Fraction(0))


def failures(text: Column) -> list[Column]:
    """Whether a text fails each of the filters that look at it alone, A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [F.size(words) < 200, 100 * distinct < 50 * F.size(words), 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the number of documents of each part and mask, and of those labelled.

    ``docs`` has doc_id, text and source, ``labels`` has doc_id, quality and toxic.
    Rows that agree in text and id are folded first, then those that agree in text,
    part and labels, so a text that very many documents share is a few rows when its
    smallest id is looked for.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((failed.cast("int") * (1 << k) for k, failed in enumerate(failures(text))), F.lit(0))
    read = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), bits.alias("mask"))
    rows = read.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marked = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    known = rows.join(marked, "doc_id", "left").select("digest", "doc_id", "part", "mask", "n", flag("good"), flag("toxic"))
    kinds = ["part", "mask", "good", "toxic"]
    # a null id comes before all others, but it is no id that another could be larger than
    alike = known.groupBy("digest", *kinds).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unknown"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"),
    )
    # rows of a text: one for each part and labels, however many documents
    least = alike.groupBy("digest").agg(F.min("low.doc_id").alias("least"))
    first = F.col("unknown") + F.when(F.col("low.doc_id") == F.col("least"), F.col("low.n")).otherwise(0)
    found = alike.join(least, "digest").select(*kinds, F.col("n"), first.alias("first"))
    copies = F.explode(
        F.array(
            F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
            F.struct((F.col("mask") + (1 << COPIES)).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
        )
    )
    split = found.select("part", "good", "toxic", copies.alias("found")).select("part", "good", "toxic", "found.mask", "found.n").where("n > 0")
    count = lambda name: F.sum(F.when(F.col(name), F.col("n")).otherwise(0)).alias(name)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def polynomials(counted: DataFrame, filters: int) -> DataFrame:
    """(part, total, removed, good, toxic, shapley) of each part.

    The middle three are arrays by set of filters, what those remove together; the
    last is by filter, times the number of orders.
    """
    gathered = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 2^filters at most
    longs = pa.list_(pa.int64())

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("total", "removed", "good", "toxic", "shapley")}
            for found in batch.column("masks").to_pylist():
                for name, kind in (("removed", "n"), ("good", "good"), ("toxic", "toxic")):
                    counts = [0] * (1 << filters)
                    for mask in found:
                        counts[mask["mask"]] = mask[kind]
                    polynomial = removal_polynomial(counts)
                    out[name].append(corners(polynomial))
                    if kind == "n":
                        values = [shapley(polynomial, which) * factorial(filters) for which in range(filters)]
                        assert all(value.denominator == 1 for value in values)
                        out["shapley"].append([value.numerator for value in values])
                        out["total"].append(sum(counts))
            columns = [batch.column("part"), pa.array(out["total"], pa.int64()), *[pa.array(out[k], longs) for k in ("removed", "good", "toxic", "shapley")]]
            yield pa.RecordBatch.from_arrays(columns, ["part", "total", "removed", "good", "toxic", "shapley"])

    return gathered.mapInArrow(solve, "part string, total long, removed array<long>, good array<long>, toxic array<long>, shapley array<long>")


def orders(solved: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the values at the corners.

    The table of steps has ``n * n!`` rows whatever the data, so it is broadcast.
    """
    steps = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, which in enumerate(order, 1):
            steps.append((len(steps), "".join(filters[k] for k in order), step, which, before, before | 1 << which))
            before |= 1 << which
    shape = "place int, filter_order string, step int, which int, before int, after int"
    known = F.broadcast(solved.sparkSession.createDataFrame(steps, shape))
    spread = solved.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(known, "place")
    at = lambda values, some: F.get(F.col(values), some)
    here = lambda values: at(values, F.col("after")) - at(values, F.col("before"))
    alone, all_of = F.expr("shiftleft(1, which)"), (1 << len(filters)) - 1
    return spread.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("removed", F.col("after"))).alias("kept"),
        here("removed").alias("removed"),
        (at("removed", alone) - here("removed")).alias("redundant"),
        (at("removed", F.lit(all_of)) - at("removed", F.lit(all_of) - alone)).alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        at("shapley", F.col("which")).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Every order of the five filters over all documents, by source."""
    counted = masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return orders(polynomials(counted, len(FILTERS)))


QUERIES = {"op11_filter_audit": op11_filter_audit}

# The SQL walks the orders themselves: a document is removed at the first filter of an order that it fails.
ORACLE_SQL = {
    "op11_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents
), read AS (
  SELECT doc_id, part, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS least FROM texts
), failing AS (
  SELECT doc_id, part,
         concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 2 * length(body) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM read
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), kinds AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters(f) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), sequences AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
  FROM sequences, range(1, 6) AS r(step)
), met AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failed, fails = f AS only_this,
         len(translate(fails, earlier, '')) < len(fails) AS gone
  FROM kinds, steps
), counted AS (
  SELECT part, filter_order, step, any_value(f) AS f,
         sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failed AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN failed AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
}
