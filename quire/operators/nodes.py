"""Paths of a page's nodes, and parts of a page written back, from its events.

Events are rows in the order of the page (``quire.sources.html.events``); a node's
open event tells where it closes, so what is inside a node is an interval of
events, and a part is written back by a join with that interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.pages import load, spread
from quire.plans.fixpoint import reliable
from quire.sources import html


def nodes(events: DataFrame) -> DataFrame:
    """(doc_id, node_id, parent_id, tag, first, ends) of every node."""
    return events.where("kind = 'open'").select("doc_id", "node_id", "parent_id", "tag", F.col("ord").alias("first"), "ends")


def rooted(rows: DataFrame, piece: str, separator: str = " > ") -> DataFrame:
    """(doc_id, node_id, path): the pieces of a node's ancestors and its own, from the top, joined.

    Each round joins every way up with the one that begins where it ends, so ways
    double; there are as many rounds as doublings reach the deepest node.
    """
    ways = rows.select("doc_id", "node_id", F.col("parent_id").alias("up"), F.col(piece).alias("path"))
    known = ways.select("doc_id", F.col("node_id").alias("up")).withColumn("__known", F.lit(True))
    ways = reliable(ways.join(known, ["doc_id", "up"], "left").withColumn("up", F.when(F.col("__known"), F.col("up"))).drop("__known"))
    while not ways.where("up IS NOT NULL").isEmpty():
        upper = ways.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("path").alias("__path"))
        ways = reliable(ways.join(upper, ["doc_id", "up"], "left").select("doc_id", "node_id", F.col("__up").alias("up"), F.concat_ws(separator, "__path", "path").alias("path")))
    return ways.drop("up")


def selectors(events: DataFrame) -> DataFrame:
    """(doc_id, node_id, tag, selector): every node's path of ``tag:nth-of-type(k)`` from the top of its page."""
    every = nodes(events)
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_id", "tag").orderBy("node_id"))
    named = reliable(every.withColumn("piece", F.concat("tag", F.lit(":nth-of-type("), place, F.lit(")"))))
    return named.select("doc_id", "node_id", "tag").join(rooted(named, "piece").withColumnRenamed("path", "selector"), ["doc_id", "node_id"])


def _escaped(text: Column, spelled: bool = False) -> Column:
    for letter, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))[spelled:]:
        text = F.replace(text, F.lit(letter), F.lit(name))
    return text


def rendered(events: DataFrame, roots: DataFrame, links: DataFrame | None = None, spelled: bool = False) -> DataFrame:
    """(doc_id, node_id, markup): each root node (doc_id, node_id) written back with what is inside it, safe to show.

    Tags that aren't static content are left out, with their attributes, but for
    spans of cells; hidden nodes and frames go with all that is in them. A link
    (doc_id, link, target, reason) leads to its target, or tells why it doesn't.
    Texts of ``spelled`` events keep their character references, cut ones too.
    """
    bounds = roots.select("doc_id", "node_id").distinct().join(nodes(events), ["doc_id", "node_id"]).select("doc_id", F.col("node_id").alias("root"), "first", F.col("ends").alias("until"))
    inside = events.join(bounds, "doc_id").where(F.col("ord").between(F.col("first"), F.col("until")) & F.col("shown"))
    if links is not None:
        inside = inside.join(links.select("doc_id", "link", "target", "reason"), ["doc_id", "link"], "left")
    else:
        inside = inside.withColumn("target", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    told, dead = F.col("target").isNotNull(), F.col("reason").isNotNull()
    allowed = F.col("tag").isin(sorted(html.SHOWN))
    opened = (
        F.when((F.col("tag") == "a") & told, F.concat(F.lit('<a href="#/'), _escaped(F.col("target")), F.lit('">')))
        .when((F.col("tag") == "a") & dead, F.concat(F.lit('<span title="'), _escaped(F.col("reason")), F.lit('">')))
        .when(F.col("tag") == "a", F.lit("<span>"))
        .when(allowed & (F.col("tag") != "img"), F.concat(F.lit("<"), "tag", F.coalesce("spans", F.lit("")), F.lit(">")))
    )
    closed = F.when(F.col("tag") == "a", F.when(told, F.lit("</a>")).otherwise(F.lit("</span>"))).when(allowed & ~F.col("tag").isin(sorted(html.VOID)), F.concat(F.lit("</"), "tag", F.lit(">")))
    piece = F.when(F.col("kind") == "text", _escaped(F.col("text"), spelled)).when(F.col("kind") == "open", opened).otherwise(closed)
    pieces = inside.select("doc_id", "root", "ord", F.coalesce(piece, F.lit("")).alias("piece"))
    parts = pieces.groupBy("doc_id", "root").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("all"))  # one part of one page
    return parts.select("doc_id", F.col("root").alias("node_id"), F.array_join(F.transform("all", lambda one: one["piece"]), "").alias("markup"))


# ---------------------------------------------------------------- queries


def _events(spark, sf_dir, spelled: bool = False) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return reliable(html.events(spread(pages), spelled=spelled))


def q_node_selectors(spark, sf_dir) -> DataFrame:
    return selectors(_events(spark, sf_dir)).select(F.col("doc_id").alias("page_id"), F.col("node_id").cast("long").alias("node_id"), "tag", "selector")


def q_rendered_parts(spark, sf_dir) -> DataFrame:
    """The article of each page, its heading and its paragraphs, each written back; by tag how many there are and their least digest."""
    events = _events(spark, sf_dir, spelled=True)
    roots = nodes(events).where("tag IN ('h1', 'article', 'p')")
    rows = rendered(events, roots, spelled=True).join(roots.select("doc_id", "node_id", "tag"), ["doc_id", "node_id"])
    return rows.select(F.col("doc_id").alias("page_id"), "tag", F.md5(F.col("markup").cast("binary")).alias("digest")).groupBy("page_id", "tag").agg(F.count("*").alias("parts"), F.min("digest").alias("least"))


QUERIES = {"node_selectors": q_node_selectors, "rendered_parts": q_rendered_parts}

# Tags are walked with a list of what is open; paths are built down from the top.
_WALK = r"""WITH RECURSIVE h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<(script|style)[^>]*>).*?(</(script|style)>)', '\1\3', 'g') AS h FROM pages),
  t AS (SELECT page_id, regexp_extract_all(h, '</?[a-z][a-z0-9]*') AS tags FROM h),
  w AS (SELECT page_id, 0 AS k, 0 AS made, [0] AS ids, ['root'] AS open, CAST(NULL AS INT) AS node, CAST(NULL AS INT) AS parent, '' AS tag FROM t
    UNION ALL
    SELECT page_id, k + 1, CASE WHEN closes THEN made ELSE made + 1 END,
      CASE WHEN closes OR void THEN ids[:keep] ELSE list_append(ids[:keep], made + 1) END, CASE WHEN closes OR void THEN open[:keep] ELSE list_append(open[:keep], name) END,
      CASE WHEN closes THEN NULL ELSE made + 1 END, CASE WHEN closes THEN NULL ELSE ids[keep] END, name
    FROM (SELECT *, name IN ('meta', 'br') AS void, CASE
        WHEN closes THEN CASE WHEN list_contains(open, name) THEN len(open) - list_position(list_reverse(open), name) ELSE len(open) END
        WHEN name IN ('p', 'li', 'a') AND len(bar) > 0 AND list_contains(open[bar[-1] + 1:], name) THEN bar[-1] + list_position(open[bar[-1] + 1:], name) - 1
        ELSE len(open) END AS keep
      FROM (SELECT *, list_filter(range(1, len(open) + 1), lambda i: list_contains(CASE name WHEN 'li' THEN ['root', 'ul', 'ol'] WHEN 'p' THEN ['root', 'div', 'section', 'body'] ELSE ['root', 'body'] END, open[i])) AS bar
        FROM (SELECT w.*, starts_with(tags[k + 1], '</') AS closes, ltrim(tags[k + 1], '</') AS name FROM (SELECT page_id, k, made, ids, open FROM w) w JOIN t USING (page_id) WHERE k < len(tags))))),
  n AS (SELECT page_id, node, parent, tag, tag || ':nth-of-type(' || row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY node) || ')' AS piece FROM w WHERE node IS NOT NULL),
  s AS (SELECT page_id, node, tag, piece AS selector FROM n WHERE parent = 0 UNION ALL SELECT n.page_id, n.node, n.tag, s.selector || ' > ' || n.piece FROM n JOIN s ON n.page_id = s.page_id AND n.parent = s.node)"""

ORACLE_SQL = {
    "node_selectors": _WALK + " SELECT page_id, CAST(node AS BIGINT) AS node_id, tag, selector FROM s",
    # a paragraph may leave a mark open, which closes with it; a paragraph that is left open closes where the next begins
    "rendered_parts": r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(<h1>.*?</h1>)', 1) AS head, regexp_extract(html, '(?s)<article><h1>.*?</h1>(.*?)</article>', 1) AS body FROM pages),
      p AS (SELECT page_id, head, list_transform(string_split(body, '<p>')[2:], lambda x: '<p>' || replace(x, '</p>', '') || CASE WHEN starts_with(x, '<b>') THEN '</b>' ELSE '' END || '</p>') AS ps FROM a),
      r AS (SELECT page_id, 'h1' AS tag, head AS markup FROM p UNION ALL SELECT page_id, 'p', unnest(ps) FROM p UNION ALL SELECT page_id, 'article', '<article>' || head || array_to_string(ps, '') || '</article>' FROM p)
      SELECT page_id, tag, count(*) AS parts, min(md5(markup)) AS least FROM r GROUP BY 1, 2""",
}
