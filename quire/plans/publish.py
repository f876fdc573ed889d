"""Immutable generations of a library, a pointer to the current one, and search over it."""

from __future__ import annotations

import json
import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ids import canonical_digest
from quire.operators import blocks
from quire.operators.relations import SHARD_CHARS, membership, shard_pack
from quire.operators.search import query_terms
from quire.plans import hashtree
from quire.plans.fixpoint import reliable
from quire.plans.sizes import small
from quire.plans.store import files_of, read_text, write_text


#: Rows of four short columns up to which they are broadcast to the units.
NARROW_ROWS = 1_000_000
#: Memberships of a scope that a search names in its filters; more are joined.
MOST_MEMBERSHIPS = 1000
#: Shards that one file of a generation should hold.
SHARDS_A_FILE = 1024


class StaleScope(RuntimeError):
    """The published generation doesn't belong to the current review."""


class Cancelled(RuntimeError):
    """The caller's ``cancelled`` said so; the pointer still names the generation before."""


def scope_fingerprint(scope: dict) -> str:
    """A digest of a selection with its modes and revisions; the eligible units aren't part of it."""
    return canonical_digest({k: v for k, v in scope.items() if k != "eligible"})


def publish(
    units: DataFrame, scope_units: DataFrame, root: str, revisions: dict, limit: int = SHARD_CHARS, cancelled: Callable[[], bool] = lambda: False
) -> str:
    """Write a generation (units by membership, their index, scopes, counts) and move the pointer to it; gives its name.

    ``units`` has unit_id, title, text; ``scope_units`` has scope, unit_id, state,
    eligible. Units that the same scopes can see share a folder, in which they are
    sorted by shard, so a search reads no text of units it may not show. There are
    as many folders as memberships occur, which the scopes bound, not the units.
    """
    spark = units.sparkSession
    eligible = scope_units.where("eligible").select("scope", "unit_id").distinct()
    shards = shard_pack(membership(eligible).join(units.select("unit_id", F.length("text").alias("chars")), "unit_id"), limit)
    # a name that a folder keeps as a name, whatever its digits
    membership_id = F.concat(F.lit("m"), F.substring(F.sha2("signature", 256), 1, 16))
    # a narrow table, which numbers, folders and index share
    order = reliable(blocks.numbered(shards.select("unit_id", membership_id.alias("membership"), F.col("bin").alias("shard"))))
    placed = units.join(small(order, NARROW_ROWS), "unit_id")
    sums = lambda rows, *columns: rows.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    said = [*sums(units, "unit_id", "title", "text"), *sums(order, "unit_id", "membership", "shard")]
    name = canonical_digest([revisions, limit, *map(str, said)])[:32]
    folder = f"{root}/generations/{name}"
    system, place = files_of(spark, f"{folder}/complete")
    if not system.exists(place):
        # a row for each scope that sees a membership, not for each unit
        seen = eligible.join(order.select("unit_id", "membership"), "unit_id").select("scope", "membership").distinct()
        sizes = order.groupBy("membership").agg(F.count("*").alias("units"), F.min("unit_no").alias("first_no"))
        steps = {
            "units": lambda path: _deal(placed).write.mode("overwrite").partitionBy("membership").parquet(path),
            "scope_memberships": seen.join(sizes, "membership").write.mode("overwrite").parquet,
            "blocks": lambda path: blocks.write(spark.read.parquet(f"{folder}/units"), path),  # in order of numbers there
            "numbers": lambda path: order.sortWithinPartitions("unit_no").select("unit_no", "unit_id", "membership").write.mode("overwrite").parquet(path),
        }
        for step, write in steps.items():
            if cancelled():
                raise Cancelled(step)
            write(f"{folder}/{step}")
        counts = scope_units.groupBy("scope", "state").agg(F.count("*").alias("units"), F.count_if("eligible").alias("eligible"))
        counts.write.mode("overwrite").parquet(f"{folder}/filter_counts")
        top = hashtree.write(spark, folder, {"units": None, "scope_memberships": None, "blocks": None, "numbers": None, "filter_counts": None})
        write_text(spark, f"{folder}/complete", json.dumps({**revisions, "tree": top}))
    if cancelled():
        raise Cancelled("activate")
    write_text(spark, f"{root}/current.json", json.dumps({"generation": name, **revisions}))
    return name


def _deal(placed: DataFrame) -> DataFrame:
    """Units dealt out by runs of shards, so that a large membership is written by many tasks, in files sorted by number."""
    run = F.floor(F.col("shard") / SHARDS_A_FILE)
    return placed.repartition(F.col("membership"), run).sortWithinPartitions("membership", "unit_no")


def open_current(spark: SparkSession, root: str, review_revision: str) -> tuple[str, dict]:
    """The current generation's folder and its pointer; an error if its review is not the current one."""
    pointer = json.loads(read_text(spark, f"{root}/current.json"))
    if pointer.get("review_revision") != review_revision:
        raise StaleScope("published eligibility belongs to another review")
    return f"{root}/generations/{pointer['generation']}", pointer


def search(spark: SparkSession, folder: str, scope: str, query: str, limit: int = 100, digits: int | None = None) -> DataFrame:
    """(unit_id, score, snippet) of the best units of a scope that hold all terms of the query, by the published blocks.

    The score is that of ``quire.operators.search.scoped_search``. No text is read
    but that of the rows shown, from the folders and by the numbers where they
    are. An unknown scope is an error, never a wider search.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    numbers = spark.read.parquet(f"{folder}/numbers")
    nothing = numbers.select("unit_id", F.lit(0.0).alias("score"), F.lit("").alias("snippet")).limit(0)
    terms = list(dict.fromkeys(query_terms(query)))
    seen = spark.read.parquet(f"{folder}/scope_memberships").where(F.col("scope") == scope).select("membership", "units")
    few = seen.limit(MOST_MEMBERSHIPS + 1).collect()
    if not few and spark.read.parquet(f"{folder}/filter_counts").where(F.col("scope") == scope).isEmpty():
        raise KeyError(f"scope was not published: {scope}")
    if not few or not terms:
        return nothing
    named = [row["membership"] for row in few] if len(few) <= MOST_MEMBERSHIPS else seen.select("membership")
    units = sum(row["units"] for row in few) if isinstance(named, list) else seen.agg(F.sum("units")).first()[0]
    shown = blocks.best(blocks.open_blocks(spark, f"{folder}/blocks", terms), numbers, named, units, query, limit, digits)
    if not shown:
        return nothing
    where = F.col("membership").isin({row["membership"] for row in shown}) & F.col("unit_no").isin([row["unit_no"] for row in shown])
    texts = spark.read.parquet(f"{folder}/units").where(where)
    scores = spark.createDataFrame([(row["unit_no"], row["score"]) for row in shown], "unit_no long, score double")
    rows = texts.join(F.broadcast(scores), "unit_no").select("unit_id", "score", T.snippet(F.col("text"), terms).alias("snippet"))
    return rows.orderBy(F.desc("score"), "unit_id")


def verified(spark: SparkSession, folder: str) -> hashtree.Tree:
    """The generation's tables, each file checked when it is first opened, under the root that the generation was completed with."""
    return hashtree.Tree(spark, folder, json.loads(read_text(spark, f"{folder}/complete"))["tree"])


class Search:
    """A search that runs in a thread of its own, with a job tag by which ``cancel`` stops it between or inside its stages."""

    def __init__(self, spark: SparkSession, folder: str, scope: str, query: str, limit: int = 100):
        self._context, self._tag = spark.sparkContext, f"quire-search-{uuid.uuid4().hex}"
        self._stopped, self._rows, self._error = threading.Event(), None, None

        def run() -> None:
            self._context.addJobTag(self._tag)
            try:
                if not self._stopped.is_set():
                    self._rows = search(spark, folder, scope, query, limit).collect()  # limit rows at most
            except Exception as error:  # noqa: BLE001  raised again where the rows are asked for
                self._error = error
            finally:
                self._context.removeJobTag(self._tag)

        self._thread = InheritableThread(target=run, session=spark)
        self._thread.start()

    def cancel(self) -> None:
        self._stopped.set()
        self._context.cancelJobsWithTag(self._tag)

    def rows(self) -> list:
        """The rows, once they are there; ``Cancelled`` if the search was stopped."""
        self._thread.join()
        if self._stopped.is_set():
            raise Cancelled("search")
        if self._error:
            raise self._error
        return self._rows


def scope_units(spark: SparkSession, folder: str, scope: str) -> DataFrame:
    """The units that a scope may show; the join with its memberships prunes the folders of all others."""
    seen = spark.read.parquet(f"{folder}/scope_memberships").where(F.col("scope") == scope).select("membership")
    return spark.read.parquet(f"{folder}/units").join(small(seen), "membership", "left_semi")


class ScopeCache:
    """The last scopes that were resolved, by their revisions and selection."""

    def __init__(self, size: int = 16):
        if not 1 <= size <= 128:
            raise ValueError("size is 1 to 128")
        self.size, self._held = size, OrderedDict()

    def get(self, key: dict, resolve: Callable[[], DataFrame]) -> DataFrame:
        name = canonical_digest(key)
        if name not in self._held:
            self._held[name] = resolve()
            while len(self._held) > self.size:
                self._held.popitem(last=False)
        self._held.move_to_end(name)
        return self._held[name]
