"""Printed steps of pages' ordered lists, by joins and windows over their nodes.

Lists, items and problems are tables. Lists that go on (a top list whose printed
number isn't 1) form a run, and so do the lists directly inside one item; an item's
number is its place in its run. Labels of nested steps come from their parents' by
jumps of doubled length. A run with any problem is one row with the first
problem's reason, first by its place on the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.fixpoint import reliable
from quire.plans.sizes import dealt

# Words that make a step more than the next thing to do, and limits of nesting and lettering; a run has as many steps as it has.
CONDITIONAL = r"(?i)\b(?:if|unless|otherwise|repeat|rerun|refer\s+to|go\s+to|proceed|see\s+|M/T|A/T)\b"
MOST_NESTED, LETTERS = 8, 26
#: Doublings of jumps to parents: chains of up to 2^4 lists, more than are allowed.
DOUBLINGS = 4

DEEP, STYLE = "lists are too deep or numbered in several ways", "numbering isn't decimal or of single letters"
SHAPE, GAP = "list runs backward or holds more than its items", "printed numbers have a gap"
STEP_GAP, EMPTY = "printed numbers have a gap, or a step is empty", "a step has nothing but steps of its own"
NOTES = {
    "drawn": "a step's figure has to be bound",
    "linked": "a step is conditional or linked",
    "listed": "steps inside steps need a review of their order",
}


def plain(text: Column) -> Column:
    """Blanks run together, none at the ends; a null text is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def list_nodes(pages: DataFrame) -> DataFrame:
    """The nodes of ordered lists and of all items, from (doc_id, nodes)."""
    return pages.select("doc_id", F.explode("nodes").alias("n")).select("doc_id", "n.*").where("tag IN ('ol', 'li')")


def _lists(nodes: DataFrame) -> DataFrame:
    """(doc_id, list_id, above, top, run, start, style, bad): ``run`` is the top run's first list or the item that holds the lists."""
    lists = nodes.where("tag = 'ol'").select(
        "doc_id",
        F.col("node_id").alias("list_id"),
        F.col("parent_id").alias("above"),
        F.col("number").alias("start"),
        F.coalesce("style", F.lit("1")).alias("style"),
        F.arrays_overlap("marks", F.array(F.lit("backward"), F.lit("loose"))).alias("bad"),
        (~F.array_contains("marks", "inside")).alias("top"),
    )
    order = Window.partitionBy("doc_id", "top").orderBy("list_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.when(F.col("start").isNull() | (F.col("start") == "1"), F.col("list_id"))
    first = F.coalesce(F.max(begins).over(order), F.min("list_id").over(order))
    return lists.withColumn("run", F.when(F.col("top"), first).otherwise(F.col("above")))


def _items(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """Items of ordered lists with their numbers in the run."""
    own = nodes.where("tag = 'li'").select(
        "doc_id",
        F.col("node_id").alias("step_id"),
        F.col("parent_id").alias("list_id"),
        F.col("number").alias("value"),
        plain(F.col("text")).alias("said"),
        plain(F.coalesce("own", "text")).alias("instruction"),
        "marks",
    )
    order = Window.partitionBy("doc_id", "run").orderBy("step_id")
    rows = own.join(dealt(lists.select("doc_id", "list_id", "run", "top", "style")), ["doc_id", "list_id"])
    rows = rows.withColumn("sequence", F.row_number().over(order)).withColumn("next_id", F.lead("step_id").over(order))
    letter = F.when(F.col("sequence") <= LETTERS, F.char(F.ascii("style") + F.col("sequence") - 1))
    label = F.when(F.col("style") == "1", F.col("sequence").cast("string")).when(F.col("style").isin("a", "A"), letter)
    return rows.withColumn("printed", label).withColumn("parent_id", F.when(~F.col("top"), F.col("run")))


def labelled(items: DataFrame) -> DataFrame:
    """(doc_id, step_id, list_run, label, depth) of the items that hang on a top run; others, of lists in other lists, go.

    An item knows the way to the item above it; in each round every way is joined
    with the one that begins where it ends, so it doubles.
    """
    ways = items.select(
        "doc_id", "step_id", F.col("parent_id").alias("up"), F.when(F.col("top"), F.col("run")).alias("list_run"), F.coalesce("printed", F.lit("?")).alias("label"), F.when(F.col("top"), 0).otherwise(1).alias("depth")
    )
    for _ in range(DOUBLINGS):
        upper = ways.select("doc_id", F.col("step_id").alias("up"), F.col("up").alias("up2"), F.col("list_run").alias("run2"), F.col("label").alias("label2"), F.col("depth").alias("depth2"))
        met = F.col("label2").isNotNull()
        ways = ways.join(dealt(upper), ["doc_id", "up"], "left").select(
            "doc_id",
            "step_id",
            F.when(met, F.col("up2")).otherwise(F.col("up")).alias("up"),
            F.coalesce("list_run", "run2").alias("list_run"),
            F.when(met, F.concat_ws(".", "label2", "label")).otherwise(F.col("label")).alias("label"),
            (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
        )
    return ways.where("list_run IS NOT NULL").drop("up")


def _problems(lists: DataFrame, steps: DataFrame) -> DataFrame:
    """(doc_id, list_run, reason): the first problem of each run that has one.

    Problems are rows of place, rank and reason; ranks order those of one place.
    """
    held = steps.groupBy("doc_id", "list_id").agg(F.min("sequence").alias("first_number"))
    whose = steps.select("doc_id", F.col("step_id").alias("above"), F.col("list_run").alias("of"), (F.col("depth") + 1).alias("deep"))
    known = lists.join(dealt(whose), ["doc_id", "above"], "left").join(dealt(held), ["doc_id", "list_id"], "left")
    known = known.withColumn("list_run", F.when(F.col("top"), F.col("run")).otherwise(F.col("of"))).where("list_run IS NOT NULL")
    among = Window.partitionBy("doc_id", "run")
    known = known.withColumn("styles", F.size(F.collect_set("style").over(among))).withColumn("begins", F.min("list_id").over(among))
    problem = lambda holds, place, rank, reason: F.when(holds, F.struct(F.col(place).alias("place"), F.lit(rank).alias("rank"), F.lit(reason).alias("reason")))
    of_lists = F.array(
        problem((F.coalesce("deep", F.lit(0)) > MOST_NESTED) | (F.col("styles") > 1) | (F.col("top") & (F.col("style") != "1")), "begins", 0, DEEP),
        problem(F.col("bad") | F.col("first_number").isNull(), "list_id", 1, SHAPE),
        problem(F.col("start") != F.col("first_number").cast("string"), "list_id", 2, GAP),
    )
    of_steps = F.array(
        problem((F.coalesce(F.col("value") != F.col("sequence").cast("string"), F.lit(False))) | (F.col("said") == ""), "step_id", 3, STEP_GAP),
        problem(F.col("instruction") == "", "step_id", 4, EMPTY),
        problem(F.col("printed").isNull(), "step_id", 5, STYLE),
    )
    every = known.select("doc_id", "list_run", F.explode(F.array_compact(of_lists)).alias("p")).unionByName(
        steps.select("doc_id", "list_run", F.explode(F.array_compact(of_steps)).alias("p"))
    )
    return every.groupBy("doc_id", "list_run").agg(F.min("p")["reason"].alias("reason"))


def extract_steps(pages: DataFrame) -> DataFrame:
    """All steps of each page's ordered lists (columns doc_id, nodes) with their printed labels, nested ones under their parents.

    (doc_id, list_id, step_id, label, style, sequence, parent_id, instruction,
    next_id, missing, reason). A run of lists that isn't plain (gaps, other
    numbering, loose text, too deep) gives one row with a reason. In a run where any
    step is conditional, linked, drawn or has steps of its own, all steps keep their
    order but none has a next one, and ``missing`` tells why.
    """
    nodes = reliable(list_nodes(pages))  # what the page parser gave, read once
    lists = _lists(nodes)
    items = _items(nodes, lists)
    steps = reliable(items.join(dealt(labelled(items)), ["doc_id", "step_id"]))
    problems = reliable(_problems(lists, steps))
    marked = lambda name: F.array_contains("marks", name)
    holds = {"drawn": marked("drawn"), "linked": marked("linked") | F.col("said").rlike(CONDITIONAL), "listed": marked("listed")}
    notes = F.array_compact(F.array(*[F.when(F.bool_or(holds[name]), F.lit(note)) for name, note in NOTES.items()]))
    told = steps.groupBy("doc_id", "list_run").agg(F.sort_array(notes).alias("missing"))
    good = steps.join(dealt(told), ["doc_id", "list_run"]).join(dealt(problems), ["doc_id", "list_run"], "left_anti")
    rows = good.select(
        "doc_id",
        F.col("list_run").alias("list_id"),
        "step_id",
        "label",
        "style",
        "sequence",
        "parent_id",
        "instruction",
        F.when(F.size("missing") == 0, F.col("next_id")).alias("next_id"),
        "missing",
        F.lit(None).cast("string").alias("reason"),
    )
    bad = problems.select("doc_id", F.col("list_run").alias("list_id"), "reason")
    return rows.unionByName(bad, allowMissingColumns=True)
