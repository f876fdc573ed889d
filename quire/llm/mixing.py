"""Mixing sources to target weights by temperature, with budgeted block permutations.

Weights are the sources' token shares raised to an exponent and normalised. The
exponent is bisected: the largest in [0, 1] whose weights have at least the
target entropy (as a share of the greatest one), raised, if need be, to the
smallest that repeats no source more than ``max_repeat`` times. Without targets
it is 1.

The budget is the number of tokens with which the source that is repeated least
is read once in full, so that no document is lost, or one that the caller gives.
``max_repeat`` holds for either; a budget that no weights can meet within it is an
error. Each source's part of it is realised as passes over a permutation of its
documents: documents fall into blocks by a hash of their id and text, of about
``BLOCK_TOKENS`` tokens and ``MOST_BLOCKS`` a source at most; each pass has an
order of its own for the blocks, and for the documents inside a block. Full
passes take all documents; in the last, partial one a document is taken while
the tokens before it are below what is left of the source's budget. Sums run
over blocks first, then over the documents of the one block that is cut, so no
window holds a source.

Everything is DataFrame functions. Tokens are runs of characters other than
white space (space, tab, line ends, form feed).

Defined results: a null source counts as the empty one; null and empty texts have
no tokens and are taken in every full pass, and in the partial one where their
turn comes; null ids count as empty text in hashes; repeated ids are rows each
for themselves (rows equal in id and text share a block, and are counted
there, not gathered); a source without tokens has weight 0 and one pass; an empty
table gives an empty table. Other columns are kept by ``mixed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import reliable, table

BLOCK_TOKENS, MOST_BLOCKS = 100_000, 1 << 16
#: Passes that are listed at once; more are listed run by run.
MOST_PASSES = 1024
MAX_REPEAT = 2.0
#: Exponents tried in each step of the search, and steps; each step narrows 32-fold.
SECTIONS, STEPS = 32, 6
#: Rows up to which the tables of sources and blocks are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\x0b\\x0c]+")), F.lit(0)).cast("long")


def spot(*parts: Column) -> Column:
    """A number below 2**60 from the MD5 of the parts as text."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _edge(shares: DataFrame, holds: Column, rising: bool) -> float:
    """Where in [0, 1] a condition on the exponent turns, by sections of the interval.

    ``holds`` is an aggregate over the sources that tells whether the condition
    holds for the exponent in column ``a``; with ``rising`` it holds from the edge
    on, else up to it. One aggregation tries all exponents of a step.
    """
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        tried = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        exponents = F.posexplode(F.array(*[F.lit(a) for a in tried])).alias("i", "a")
        rows = shares.select("share", exponents).groupBy("i").agg(holds.alias("ok")).where("ok").select("i").collect()
        good = sorted(r["i"] for r in rows)
        if not good:
            return high if rising else low
        if rising:
            low, high = tried[max(0, good[0] - 1)], tried[good[0]]
        else:
            low, high = tried[good[-1]], tried[min(SECTIONS, good[-1] + 1)]
        if low == high:
            break
    return high if rising else low


def exponent(shares: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None, passes: float | None = None) -> float:
    """The exponent, to six places, for the shares in column ``share``, a row a source.

    ``passes`` is the budget as a multiple of all tokens, where the caller gives one.
    """
    shares = shares.where("share > 0")
    power, found = F.exp(F.col("a") * F.log("share")), 1.0 if max_repeat is None else 0.0
    if target_entropy is not None:
        # H = ln sum(p^a) - a sum(p^a ln p) / sum(p^a) falls in a; the most is ln n
        entropy = F.log(F.sum(power)) - F.max("a") * F.sum(power * F.log("share")) / F.sum(power)
        enough = entropy >= target_entropy * F.log(F.count("*").cast("double")) - 1e-12
        found = math.floor(_edge(shares, enough, False) * 1e6) / 1e6
    if max_repeat is not None:
        if max_repeat < 1:
            raise ValueError("max_repeat is 1 at least")
        if passes is None:
            # with the least repeated source read once, share p is read (p / p_max)^(a - 1) times
            most = F.exp((F.max("a") - 1) * (F.log(F.min("share")) - F.log(F.max("share"))))
        elif passes <= max_repeat:
            # of the budget, share p gets p^a / sum(p^a); the smallest share is repeated most
            most = F.lit(passes) * F.exp((F.max("a") - 1) * F.log(F.min("share"))) / F.sum(power)
        else:
            raise ValueError(f"the budget reads all sources {passes:.3f} times, more than max_repeat")
        found = max(found, math.ceil(_edge(shares, most <= max_repeat, True) * 1e6) / 1e6)
    return min(1.0, found)


def weights(sources: DataFrame, alpha: float, budget_tokens: int | None = None, max_repeat: float | None = None) -> DataFrame:
    """(key, tokens, docs, weight, budget): each source's weight and its tokens of the budget."""
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    raised = sources.withColumn("power", F.when(F.col("tokens") > 0, F.exp(F.lit(alpha) * F.log(share))).otherwise(0.0))
    scale = raised.agg(F.sum("power").alias("z"), F.max(F.when(F.col("power") > 0, F.col("tokens") / F.col("power"))).alias("each")).first()
    z = scale["z"] or 1.0
    each = budget_tokens / z if budget_tokens is not None else scale["each"] or 0.0
    budget = F.round(F.col("power") * each).cast("long")
    if max_repeat is not None:
        budget = F.least(budget, F.floor(F.col("tokens") * max_repeat))  # what rounding adds
    return raised.select("key", "tokens", "docs", (F.col("power") / z).alias("weight"), budget.alias("budget"))


def _key(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def _turn(seed: int, number: Column) -> Column:
    return spot(F.lit(seed), F.lit("turn"), F.col("__key"), number, F.col("__block"))


def _doc(seed: int, number: Column, key: Column) -> Column:
    return spot(F.lit(seed), F.lit("doc"), number, key)


def _sized(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _schedule(measured: DataFrame, target_entropy, max_repeat, budget_tokens, seed) -> tuple[DataFrame, DataFrame]:
    """Passes and blocks of each source, and what the partial pass takes of each block."""
    sources = reliable(measured.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    whole = sources.agg(F.sum("tokens")).first()[0] or 1
    shares = sources.select((F.col("tokens") / F.lit(float(max(whole, 1)))).alias("share"))
    some = F.col("tokens") > 0
    alpha = exponent(shares, target_entropy, max_repeat, None if budget_tokens is None else budget_tokens / max(whole, 1))
    parts = reliable(
        weights(sources, alpha, budget_tokens, max_repeat).select(
            F.col("key").alias("__key"),
            F.when(some, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long").alias("__full"),
            F.when(some, F.col("budget") % F.col("tokens")).otherwise(0).cast("long").alias("__rest"),
            F.least(F.lit(MOST_BLOCKS), F.ceil(F.greatest(F.lit(1), "tokens", "docs") / BLOCK_TOKENS)).cast("long").alias("__blocks"),
        )
    )
    sums = (
        _blocked(measured.select("id", F.col("key").alias("__key"), "tokens", "digest"), "id", F.col("digest"), parts, seed)
        .groupBy("__key", "__block", "__full", "__rest")
        .agg(F.sum("tokens").alias("size"))
    )
    order = Window.partitionBy("__key").orderBy(_turn(seed, F.col("__full")), "__block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).select(
        "__key",
        "__block",
        (F.col("before") + F.col("size") <= F.col("__rest")).alias("__whole"),
        (F.col("__rest") - F.col("before")).alias("__left"),
    )
    return parts, reliable(starts)


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _blocked(rows: DataFrame, id_column: str, digest: Column, parts: DataFrame, seed: int) -> DataFrame:
    # an id that very many documents share is spread by their texts
    block = F.pmod(spot(F.lit(seed), F.lit("block"), F.col(id_column), digest), F.col("__blocks"))
    return rows.join(_sized(parts), "__key").withColumn("__block", block)


def _copies(rows: DataFrame, id_column: str, tokens: Column, digest: Column, parts: DataFrame, starts: DataFrame, seed: int) -> DataFrame:
    """The rows (with column __key), once for each time that the mixture has them, with __pass."""
    placed = _blocked(rows, id_column, digest, parts, seed).join(_sized(starts), ["__key", "__block"])
    # the partial pass takes whole blocks, and of the one that is cut the first documents
    taken = F.col("__whole") & (F.col("__rest") > 0)
    times = F.col("__full") + taken.cast("long")
    first = F.col("__run") * MOST_PASSES
    sure = placed.where(times > 0).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / MOST_PASSES))))
    sure = sure.withColumn("__pass", F.explode(F.sequence(first, F.least(times, first + MOST_PASSES) - 1))).drop("__run")
    # equal rows lie in one block, so they are one row with their number where a block is cut
    cut = placed.where(~F.col("__whole") & (F.col("__left") > 0)).withColumn("__tokens", tokens)
    cut = cut.groupBy(*cut.columns).agg(F.count("*").alias("__alike"))
    inside = Window.partitionBy("__key", "__block").orderBy(_doc(seed, F.col("__full"), F.col(id_column)), id_column, "__tokens")
    before = F.coalesce(F.sum(F.col("__tokens") * F.col("__alike")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("__before", before).where("__before < __left").withColumn("__pass", F.col("__full"))
    enough = F.ceil((F.col("__left") - F.col("__before")) / F.greatest(F.lit(1), "__tokens"))
    cut = cut.withColumn("__times", F.when(F.col("__tokens") > 0, F.least("__alike", enough)).otherwise(F.col("__alike")))
    cut = cut.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__times") - 1) / MOST_PASSES))))
    cut = cut.withColumn("__copy", F.explode(F.sequence(first, F.least("__times", first + MOST_PASSES) - 1)))
    return sure.unionByName(cut.select(*sure.columns))


def _measure(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return reliable(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            _key(F.col(source_column)).alias("key"),
            token_count(F.col(text_column)).alias("tokens"),
            _digest(F.col(text_column)).alias("digest"),
        )
    )


def realise(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    target_entropy: float | None = None,
    max_repeat: float | None = MAX_REPEAT,
    budget_tokens: int | None = None,
    seed: int = 1,
) -> DataFrame:
    """(id, source, pass, block, place) of every copy of every document in the mixture.

    Passes count from 0. Inside a source and a pass, ``place`` is the order of
    the permutation: block after block, and document after document in each.
    """
    measured = _measure(docs, id_column, text_column, source_column)
    parts, starts = _schedule(measured, target_entropy, max_repeat, budget_tokens, seed)
    rows = measured.select("id", "source", F.col("key").alias("__key"), "tokens", "digest")
    found = _copies(rows, "id", F.col("tokens"), F.col("digest"), parts, starts, seed)
    half = lambda number: F.shiftright(number, 30)
    place = F.shiftleft(half(_turn(seed, F.col("__pass"))), 30).bitwiseOR(half(_doc(seed, F.col("__pass"), F.col("id"))))
    return found.select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        F.col("__pass").alias("pass"),
        F.col("__block").alias("block"),
        place.alias("place"),
    )


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    target_entropy: float | None = None,
    max_repeat: float | None = MAX_REPEAT,
    budget_tokens: int | None = None,
    seed: int = 1,
) -> DataFrame:
    """The documents, all columns kept whatever their names, each as often as the mixture has it.

    Texts aren't shuffled but for those of the one block of a source that is cut.
    """
    names = docs.columns
    # columns go by place meanwhile, so none meets a name of the plan's own
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])
    id_column, text_column, source_column = (f"c{names.index(c)}" for c in (id_column, text_column, source_column))
    measured = _measure(docs, id_column, text_column, source_column)
    parts, starts = _schedule(measured, target_entropy, max_repeat, budget_tokens, seed)
    rows = docs.withColumn("__key", _key(F.col(source_column)))
    return _copies(rows, id_column, token_count(F.col(text_column)), _digest(F.col(text_column)), parts, starts, seed).select(*docs.columns).toDF(*names)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Every copy of every document in a mixture that repeats no source more than twice."""
    return realise(table(spark, sf_dir, "documents"))


QUERIES = {"op10_mixing": op10_mixing}

_SPOT = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"

ORACLE_SQL = {
    "op10_mixing": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS key, coalesce(CAST(doc_id AS VARCHAR), '') AS name, md5(coalesce(text, '')) AS digest,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+')), 0) AS tokens
  FROM documents
), s AS (
  SELECT key, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS docs FROM d GROUP BY key
), r AS (
  SELECT min(tokens / w) AS low, max(tokens / w) AS high FROM s, (SELECT sum(tokens) AS w FROM s) WHERE tokens > 0
), bisect AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1,
    CASE WHEN exp(((lo + hi) / 2 - 1) * (ln(low) - ln(high))) <= {MAX_REPEAT} THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN exp(((lo + hi) / 2 - 1) * (ln(low) - ln(high))) <= {MAX_REPEAT} THEN (lo + hi) / 2 ELSE hi END
  FROM bisect, r WHERE i < 50
), edge AS (
  SELECT CASE WHEN exp(-(ln(low) - ln(high))) <= {MAX_REPEAT} THEN 0.0
              ELSE least(1.0, ceil(hi * 1e6) / 1e6) END AS alpha
  FROM bisect, r WHERE i = 50
), w AS (
  SELECT s.*, CASE WHEN tokens > 0 THEN exp(alpha * ln(tokens / (SELECT sum(tokens) FROM s))) ELSE 0 END AS power FROM s, edge
), b AS (
  SELECT key, tokens, docs, CAST(round(power * (SELECT max(tokens / power) FROM w WHERE power > 0)) AS BIGINT) AS budget FROM w
), p AS (
  SELECT key, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS full_passes,
         CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest,
         least({MOST_BLOCKS}, CAST(ceil(greatest(1, tokens, docs) / {BLOCK_TOKENS}.0) AS BIGINT)) AS blocks
  FROM b
), placed AS (
  SELECT d.*, full_passes, rest, {_SPOT.format("'1:block:' || name || ':' || digest")} % blocks AS block FROM d JOIN p USING (key)
), sums AS (
  SELECT key, block, full_passes, rest, sum(tokens) AS size FROM placed GROUP BY ALL
), starts AS (
  SELECT key, block, size, coalesce(sum(size) OVER (PARTITION BY key
    ORDER BY {_SPOT.format("'1:turn:' || key || ':' || full_passes || ':' || block")}, block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sums
), inside AS (
  SELECT placed.*, size, starts.before, coalesce(sum(tokens) OVER (PARTITION BY placed.key, placed.block
    ORDER BY {_SPOT.format("'1:doc:' || full_passes || ':' || name")}, doc_id, tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inner_before
  FROM placed JOIN starts ON placed.key = starts.key AND placed.block = starts.block
), copies AS (
  SELECT doc_id, source, key, name, block, unnest(range(full_passes)) AS pass FROM inside
  UNION ALL
  SELECT doc_id, source, key, name, block, full_passes FROM inside
  WHERE rest > 0 AND (before + size <= rest OR before < rest AND inner_before < rest - before)
)
SELECT doc_id, source, CAST(pass AS BIGINT) AS pass, block,
       (({_SPOT.format("'1:turn:' || key || ':' || pass || ':' || block")} >> 30) << 30)
       | ({_SPOT.format("'1:doc:' || pass || ':' || name")} >> 30) AS place
FROM copies
"""
}
