"""Queries that hold single rules to the tables' own columns.

The SQL beside each is written from the rule, by other means than the code's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import procedures
from quire.operators.pages import _BLOCKS, _line_sql, ended, load, read_pages
from quire.plans.sizes import dealt

#: Spellings of an address as the path of a member: what stands for "://", before it, and for "/".
SPELLINGS = (("url", "://", "", "/"), ("host", "", "", "/"), ("rooted", "", "/", "/"), ("back", "", "./", "\\"), ("up", "/../", "", "/"), ("drive", "", "c:", "/"), ("dots", "/./", "x//", "/"))


def q_address_paths(spark, sf_dir) -> DataFrame:
    """Why a spelling of each page's address isn't safe as a member's path, and its portable spelling."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    scheme, rest = F.regexp_extract("url", "^([a-z]+)://", 1), F.regexp_replace("url", "^[a-z]+://", "")

    def spelt(middle: str, before: str, slash: str):
        name = F.concat(scheme, F.lit(middle), rest) if middle else rest
        return F.replace(F.concat(F.lit(before), name), F.lit("/"), F.lit(slash))

    forms = F.explode(F.array(*[F.struct(F.lit(name).alias("form"), spelt(*how).alias("path")) for name, *how in SPELLINGS])).alias("f")
    rows = pages.select("page_id", forms).select("page_id", "f.form", "f.path")
    return rows.select("page_id", "form", T.unsafe_path(F.col("path")).alias("reason"), T.canonical_path(F.col("path")).alias("canonical"))


_UNITS = ("V", "Hz", "mm", "psi", "N·m")


def q_line_ranges(spark, sf_dir) -> DataFrame:
    """Discounts and taxes of lines, written as numbers and ranges under units that are known or not."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 100).cast("int").alias("low"), F.round(F.col("l_tax") * 100).cast("int").alias("high"))
    dash = F.element_at(F.array(*[F.lit(x) for x in ("-", " to ", " - ", "/")]), F.col("l_linenumber") % 4 + 1)
    raw = F.when(F.col("l_linenumber") == 3, F.col("low").cast("string")).otherwise(F.concat(F.col("low").cast("string"), dash, F.col("high").cast("string")))
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("l_orderkey") % len(_UNITS) + 1).cast("int"))
    rows = lines.select("l_orderkey", "l_linenumber", T.numeric_range(raw, unit).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "r.minimum", "r.maximum", "r.unit")


def q_paragraph_steps(spark, sf_dir) -> DataFrame:
    """Paragraphs of pages as printed steps: a list a page, the paragraphs that leave a mark open beginning lists that go on."""
    pages = load(spark, sf_dir, "pages")
    body = F.regexp_extract("html", "(?s)</h1>(.*)</article>", 1)
    items = F.filter(F.split(F.replace(body, F.lit("</p>"), F.lit("")), "<p>"), lambda _, k: k > 0)
    markup = F.array_join(F.transform(items, lambda item, k: F.concat(F.when(item.startswith("<b>"), F.concat(F.when(k > 0, F.lit("</ol>")).otherwise(F.lit("")), F.lit('<ol start="'), (k + 1).cast("string"), F.lit('">'))).when(k == 0, F.lit("<ol>")).otherwise(F.lit("")), F.lit("<li>"), item)), "")
    page = F.concat(F.lit("<body><h1>Steps</h1>"), markup, F.lit("</ol></body>"))
    nodes = read_pages(pages.select("page_id", ended(page).alias("html"))).select(F.col("page_id").alias("doc_id"), "page.nodes")
    steps = procedures.extract_steps(nodes)
    following = steps.select(F.col("doc_id").alias("of"), F.col("step_id").alias("id"), F.col("label").alias("next"))
    rows = steps.join(dealt(following), (F.col("doc_id") == F.col("of")) & (F.col("next_id") == F.col("id")), "left")
    return rows.select(F.col("doc_id").alias("page_id"), "label", "instruction", "next", F.array_join("missing", "; ").alias("missing"), "reason")


QUERIES = {"address_paths": q_address_paths, "line_ranges": q_line_ranges, "paragraph_steps": q_paragraph_steps}

_SPELT = ", ".join(f"('{name}', '{middle}', '{before}', '{slash}')" for name, middle, before, slash in SPELLINGS)
_SHOWN = "CAST(['V', 'Hz', 'mm', NULL, 'N.m'] AS VARCHAR[])"

ORACLE_SQL = {
    # addresses hold letters, digits, dots and marks of a query, so a few rules can meet them at all
    "address_paths": f"""WITH f(form, middle, prefix, slash) AS (VALUES {_SPELT}),
      p AS (SELECT page_id, form, replace(prefix || CASE WHEN middle = '' THEN '' ELSE split_part(url, '://', 1) || middle END || substr(url, strpos(url, '://') + 3), '/', slash) AS path FROM pages, f),
      l AS (SELECT *, string_split(replace(path, chr(92), '/'), '/') AS parts, regexp_matches(replace(path, chr(92), '/'), '^/|^[a-z]:') AS rooted FROM p)
      SELECT page_id, form, CASE WHEN contains(path, chr(92)) THEN 'backslash' WHEN rooted THEN 'absolute'
          WHEN list_has_any(parts, ['', '.', '..']) THEN 'not canonical' END AS reason,
        CASE WHEN NOT rooted AND NOT list_contains(parts, '..') THEN array_to_string(list_filter(parts, lambda x: x NOT IN ('', '.')), '/') END AS canonical FROM l""",
    "line_ranges": f"""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS INT) AS low, CAST(round(l_tax * 100) AS INT) AS high, {_SHOWN}[l_orderkey % 5 + 1] AS shown FROM lineitem),
      r AS (SELECT *, CASE WHEN l_linenumber = 3 THEN low ELSE high END AS most, shown IS NOT NULL AND (l_linenumber = 3 OR l_linenumber % 4 <> 3 AND low <= high) AS fine FROM l)
      SELECT l_orderkey, l_linenumber, CASE WHEN fine THEN CAST(low AS DOUBLE) END AS minimum, CASE WHEN fine THEN CAST(most AS DOUBLE) END AS maximum, CASE WHEN fine THEN shown END AS unit FROM r""",
    "paragraph_steps": rf"""WITH i AS (SELECT page_id, string_split(replace(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '</p>', ''), '<p>')[2:] AS items FROM pages),
      s AS (SELECT page_id, len(items) AS n, unnest(items) AS item, generate_subscripts(items, 1) AS k FROM i),
      t AS (SELECT *, {_line_sql(f"regexp_replace(item, '{_BLOCKS}', ' ', 'g')")} AS said FROM s),
      m AS (SELECT *, bool_or(regexp_matches(said, '(?i)\b(if|unless|otherwise|repeat|rerun|refer\s+to|go\s+to|proceed|see\s+|M/T|A/T)\b')) OVER (PARTITION BY page_id) AS conditional, bool_or(said = '') OVER (PARTITION BY page_id) AS empty FROM t)
      SELECT page_id, CAST(k AS VARCHAR) AS label, said AS instruction, CASE WHEN k < n AND NOT conditional THEN CAST(k + 1 AS VARCHAR) END AS next,
        CASE WHEN conditional THEN 'a step is conditional or linked' ELSE '' END AS missing, CAST(NULL AS VARCHAR) AS reason FROM m WHERE NOT empty
      UNION ALL SELECT DISTINCT page_id, NULL, NULL, NULL, NULL, 'printed numbers have a gap, or a step is empty' FROM m WHERE empty""",
}
