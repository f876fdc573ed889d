"""Procedures from page nodes: tables by recipe, Yes/No decisions, ordered steps.

Input is the flat node table of ``quire.sources.html`` (array of node_id,
parent_id, tag, rowspan, colspan, text in document order); output rows quote the
source, and whatever isn't plain is a row with a reason instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions import text as T
from quire.operators.steps import CONDITIONAL, extract_steps as extract_steps
from quire.sources.html import PageError, grid


def _tables(nodes: list[dict]) -> list[list[dict]]:
    """The node rows of each table, in order."""
    parents = {n["node_id"]: n["parent_id"] for n in nodes}
    tables = [n["node_id"] for n in nodes if n["tag"] == "table"]

    def inside(node: int, table: int) -> bool:
        while node in parents and node != table:
            node = parents[node]
        return node == table

    return [[n for n in nodes if inside(n["node_id"], t)] for t in tables]


def _plain(text: str | None) -> str:
    return " ".join((text or "").split())


def _fitting(nodes: list[dict], headers: list[list[str]]) -> tuple[list[dict], list[list[str]], list[str], int] | None:
    """(node rows, body cells, texts of the body's rows, first row's node) of the one table whose columns have these header paths."""
    found = []
    for rows in _tables(nodes):
        try:
            cells = [[_plain(c) for c in line] for line in grid(rows)]
        except PageError:
            continue
        lines = [n["node_id"] for n in rows if n["tag"] == "tr"]
        plain = {n["parent_id"] for n in rows if n["tag"] == "td"}
        heads = next((k for k, line in enumerate(lines) if line in plain), len(lines))
        paths = [list(dict.fromkeys(c for c in (cells[r][x] for r in range(heads)) if c)) for x in range(len(cells[0]))]
        if paths == headers:
            said = [" ".join(_plain(n["text"]) for n in rows if n["parent_id"] == line) for line in lines]
            found.append((rows, cells[heads:], said[heads:], rows[0]["node_id"]))
    return found[0] if len(found) == 1 else None


def table_rows(nodes: list[dict], headers: list[list[str]], labels: list[str]) -> list[tuple[str, list[str] | None, str | None]]:
    """(label, cells, reason) of the labelled rows of the one table with these header paths."""
    table = _fitting(nodes, headers)
    if table is None:
        return [(label, None, "no table or several have these headers") for label in labels]
    out = []
    for label in labels:
        found = [line for line in table[1] if line[0] == label]
        out.append((label, found[0], None) if len(found) == 1 else (label, None, "row is absent or repeated"))
    return out


def _governs(nodes: list[dict], text: str, table: list[dict], caption: bool) -> bool:
    """Whether a text stands once on the page, as the table's caption or before the table with no other table between."""
    saying = [n for n in nodes if _plain(n["text"]) == text]
    holders = {n["parent_id"] for n in saying}
    saying = [n for n in saying if n["node_id"] not in holders]
    inside = {n["node_id"] for t in _tables(nodes) for n in t}
    own = {n["node_id"] for n in table}
    saying = [n for n in saying if n["node_id"] not in inside or (caption and n["node_id"] in own)]
    if len(saying) != 1:
        return False
    place, begins = saying[0]["node_id"], table[0]["node_id"]
    if place in own:
        return True
    return place < begins and not any(n["tag"] == "table" and place < n["node_id"] < begins for n in nodes)


@dataclass(frozen=True)
class Recipe:
    """A table to read: the header path of each column, the rows by their first cells, where unit and values stand."""

    name: str
    headers: tuple[tuple[str, ...], ...]
    rows: tuple[str, ...]
    unit_column: int
    value_columns: tuple[tuple[int, str], ...]  # column, and the condition that ends its header path
    subject_column: int = 0
    caption: str | None = None
    note: str | None = None
    conditions: tuple[str, ...] = ()

    def __post_init__(self):
        if any(not 0 <= at < len(self.headers) or self.headers[at][-1:] != (condition,) for at, condition in self.value_columns):
            raise ValueError("a condition has to end the header path of its column")


def read_recipe(nodes: list[dict], recipe: Recipe) -> list[dict]:
    """label, text, conditions, values (condition, raw, unit), missing and reason of each row of a recipe.

    A row that can't be read has a reason and no values: its table or its row is
    absent or ambiguous, what governs the table is, or no value is there. Nothing
    is ever taken for zero.
    """
    bare = {"text": None, "header": None, "conditions": None, "values": None, "missing": None}
    table = _fitting(nodes, [list(path) for path in recipe.headers])
    if table is None:
        return [{"label": label, **bare, "reason": "no table or several have these headers"} for label in recipe.rows]
    rows, body, said, _ = table
    if not all(_governs(nodes, text, rows, text == recipe.caption) for text in (recipe.caption, recipe.note) if text):
        return [{"label": label, **bare, "reason": "what governs the table is ambiguous"} for label in recipe.rows]
    header, out = " ".join(dict.fromkeys(name for path in recipe.headers for name in path)), []
    for label in recipe.rows:
        at = [k for k, line in enumerate(body) if line[recipe.subject_column] == label]
        if len(at) != 1:
            out.append({"label": label, **bare, "reason": "row is absent or repeated"})
            continue
        line = body[at[0]]
        unit = line[recipe.unit_column]
        values = [{"condition": condition, "raw": line[column], "unit": unit} for column, condition in recipe.value_columns if line[column] and unit]
        if not values:
            out.append({"label": label, **bare, "reason": "row has no value that can be read"})
            continue
        missing = ["value or unit is empty"] if len(values) < len(recipe.value_columns) else []
        conditions = list(dict.fromkeys([v["condition"] for v in values] + list(recipe.conditions)))
        out.append({"label": label, "text": said[at[0]], "header": header, "conditions": conditions, "values": values, "missing": missing, "reason": None})
    return out


#: Pages whose rows a task gives away at once.
PAGES_AT_ONCE = 64


def _read(pages: DataFrame, read: Callable[[list[dict]], list[dict]], columns: str) -> DataFrame:
    """(doc_id, columns): the rows that ``read`` gives for the nodes of each page, read a page at a time; a page without nodes has none."""
    out = StructType([pages.schema["doc_id"], *StructType.fromDDL(columns)])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(at, PAGES_AT_ONCE)
                rows = [{"doc_id": name.as_py(), **row} for name, nodes in zip(some.column(0), some.column(1), strict=True) for row in read(nodes.as_py() or [])]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("doc_id", "nodes").mapInArrow(run, out)


def specifications(pages: DataFrame, recipe: Recipe) -> DataFrame:
    """(doc_id, label, subject_text, quantity, conditions, values, missing, reason) of a recipe's rows on every page.

    ``pages`` has doc_id and nodes. Values keep what is printed and have
    ``normalized``, null where number or unit isn't plain; ``missing`` says so then.
    ``subject_text`` is what a scope gate has to read: headers, caption and label.
    """
    kind = "label string, text string, header string, conditions array<string>, values array<struct<condition:string,raw:string,unit:string>>, missing array<string>, reason string"
    rows = _read(pages, lambda nodes: read_recipe(nodes, recipe), kind)
    values = F.transform("values", lambda v: F.struct(v["condition"].alias("condition"), v["raw"].alias("original_value"), v["unit"].alias("original_unit"), T.numeric_range(v["raw"], v["unit"]).alias("normalized")))
    units = F.create_map(*[F.lit(x) for unit, (quantity, _) in T.UNITS.items() for x in (unit, quantity)])
    quantity = F.coalesce(F.try_element_at(units, F.element_at("values", 1)["original_unit"]), F.lit("unknown original quantity"))
    unread = F.transform(F.filter("values", lambda v: v["normalized"].isNull()), lambda v: F.concat(F.lit("value or unit isn't plain under "), v["condition"]))
    return rows.withColumn("values", values).select(
        "doc_id",
        "label",
        F.concat_ws(" ", "header", F.lit(recipe.caption or ""), "label").alias("subject_text"),
        F.when(F.col("reason").isNull(), quantity).alias("quantity"),
        "conditions",
        "values",
        F.concat("missing", unread).alias("missing"),
        "reason",
    )


def extract_tables(pages: DataFrame, headers: list[list[str]], labels: list[str]) -> DataFrame:
    """(doc_id, label, cells, reason) of labelled rows of every page (columns doc_id, nodes), without their values' units."""

    names = ("label", "cells", "reason")
    return _read(pages, lambda nodes: [dict(zip(names, row, strict=True)) for row in table_rows(nodes, headers, labels)], "label string, cells array<string>, reason string")


def decision(nodes: list[dict]) -> tuple[str, str, str] | str:
    """(question, yes, no) of a section with one heading and one Yes/No table, or why it has none."""
    questions = [n for n in nodes if n["tag"] in ("p", "h3", "h4") and (n["text"] or "").rstrip().endswith("?")]
    tables = _tables(nodes)
    if len(questions) != 1 or len(tables) != 1:
        return "question or branch table is missing or ambiguous"
    try:
        cells = [[_plain(c) for c in line] for line in grid(tables[0])]
    except PageError as stopped:
        return str(stopped)
    if len(cells) != 2 or [c.casefold() for c in cells[0]] != ["yes", "no"] or not all(cells[1]):
        return "branches aren't Yes and No"
    return _plain(questions[0]["text"]), cells[1][0], cells[1][1]


def extract_decisions(sections: DataFrame) -> DataFrame:
    """(doc_id, question, if_yes, if_no, reason) of every section (columns doc_id, nodes)."""


    def one(nodes: list[dict]) -> list[dict]:
        found = decision(nodes)
        return [{"reason": found} if isinstance(found, str) else dict(zip(("question", "if_yes", "if_no"), found, strict=True))]

    return _read(sections, one, "question string, if_yes string, if_no string, reason string")


def ordered_steps(nodes: DataFrame) -> DataFrame:
    """(doc_id, list_id, step, text, next_step, conditional, nested) of all ordered lists.

    ``nodes`` is the exploded node table (doc_id, node_id, parent_id, tag, text);
    order, numbers and next steps are windows inside one list.
    """
    from pyspark.sql import Window

    lists = nodes.where("tag = 'ol'").select("doc_id", F.col("node_id").alias("list_id"))
    items = nodes.where("tag = 'li'").join(lists, (nodes["parent_id"] == lists["list_id"]) & (nodes["doc_id"] == lists["doc_id"])).drop(lists["doc_id"])
    inner = nodes.where("tag in ('ol', 'ul')").select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("__nested", F.lit(True))
    order = Window.partitionBy("doc_id", "list_id").orderBy("node_id")
    rows = items.join(inner, ["doc_id", "node_id"], "left")
    return rows.select(
        "doc_id",
        "list_id",
        F.row_number().over(order).alias("step"),
        F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"),
        F.when(F.lead("node_id").over(order).isNotNull(), F.row_number().over(order) + 1).alias("next_step"),
        F.col("text").rlike(CONDITIONAL).alias("conditional"),
        F.coalesce("__nested", F.lit(False)).alias("nested"),
    )


def source_paths(steps: DataFrame, recipes: DataFrame) -> DataFrame:
    """(step_id, kind, quote, reason): alternative and repeat paths whose quote stands once in the step's text."""
    rows = recipes.join(steps.select("step_id", "text"), "step_id", "left")
    count = F.when(F.length("quote") > 0, F.floor((F.length("text") - F.length(F.replace("text", F.col("quote"), F.lit("")))) / F.length("quote"))).otherwise(0)
    reason = F.when(F.col("text").isNull(), "step is unknown").when(count == 0, "quote isn't in the step").when(count > 1, "quote is ambiguous")
    return rows.select("step_id", "kind", "quote", reason.alias("reason"))


def audit_links(source: str, links: DataFrame, pages: DataFrame, most_targets: int) -> DataFrame:
    """(target, found, downstream): pages one link away from a source, and how many they link to.

    The number of targets is checked before any target is read; links of the
    targets are counted, not followed.
    """
    targets = links.where(F.col("source") == source).groupBy("target").agg(F.min("ord").alias("ord"))
    if targets.limit(most_targets + 1).count() > most_targets:
        raise ValueError(f"more than {most_targets} targets")
    further = links.groupBy("source").agg(F.countDistinct("target").alias("downstream"))
    known = pages.select(F.col("path").alias("target")).distinct().withColumn("found", F.lit(True))
    rows = targets.join(known, "target", "left").join(further, targets["target"] == further["source"], "left")
    return rows.select(targets["target"], F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("downstream", F.lit(0)).alias("downstream"))
