"""Joins, groups and positional operators over documents, pages, links and members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ids
from quire.functions import text as T
from quire.operators.pages import read_pages
from quire.operators.shards import SHARD_CHARS as SHARD_CHARS, shard_pack as shard_pack
from quire.plans.fixpoint import reliable
from quire.plans.prefix import running_sum

SHARED_CHARS = 80


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same_text_groups(docs: DataFrame, group: str = "source", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(group, text_sha256, members, first) of texts that several documents of a group share."""
    keyed = docs.select(group, id_column, F.sha2(text_column, 256).alias("text_sha256"))
    found = keyed.groupBy(group, "text_sha256").agg(F.count("*").alias("members"), F.min(id_column).alias("first"))
    return found.where("members > 1")


def shared_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, leader): documents that share a text of 80 characters or more, with the first that has it.

    Membership instead of pairs: rows grow with the documents, not with the
    square of a group.
    """
    long = docs.where(F.length(text_column) >= SHARED_CHARS).select(id_column, F.xxhash64(text_column).alias("h"), F.sha2(text_column, 256).alias("sha"))
    groups = long.groupBy("sha").agg(F.min(id_column).alias("leader"), F.count("*").alias("members")).where("members > 1")
    return long.join(groups, "sha").select(id_column, "leader")


def leads(docs: DataFrame, source: str = "source", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(relation, key, source, first, documents, sources): a summary of the texts and identifiers that sources share.

    Each side is a source with its smallest document and how many there are;
    ``lead_members`` names all of them, and has the mentions of titles.
    """
    text = docs.where(F.length(text_column) >= SHARED_CHARS).select(F.lit("same_text").alias("relation"), F.sha2(text_column, 256).alias("key"), source, id_column)
    parts = docs.select(F.lit("shared_part").alias("relation"), F.explode(T.identifiers(F.col(text_column))).alias("key"), source, id_column)
    sides = text.unionByName(parts).groupBy("relation", "key", source).agg(F.min(id_column).alias("first"), F.count("*").alias("documents"))
    shared = sides.groupBy("relation", "key").agg(F.count("*").alias("sources")).where("sources > 1")
    return sides.join(shared, ["relation", "key"]).select("relation", "key", source, "first", "documents", "sources")


#: Titles below this length are too common for a mention of them to be a lead.
TITLE_CHARS = 8


def title_mentions(docs: DataFrame, title_column: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, id): documents that say 'see' or 'refer to' a title of any document; key is the title, lower-cased.

    What follows the words meets the titles that begin with the same ``TITLE_CHARS``
    characters; of it a digest goes on for each length that these have, and is
    joined with the digests of titles. So no text meets a title that isn't there,
    and what is kept of a mention doesn't grow with the lengths of all titles.
    """
    titles = docs.select(F.trim(title_column).alias("title")).where(F.length("title") >= TITLE_CHARS)
    titles = titles.select(F.lower("title").alias("key"), F.length("title").alias("chars"), F.lower(F.substring("title", 1, TITLE_CHARS)).alias("start")).distinct()
    longest = titles.agg(F.max("chars")).first()[0]
    if not longest:
        return docs.select(F.lit("").alias("key"), id_column).limit(0)
    ahead = rf"(?isU)\b(?:see|refer to)\s+(?=(\S.{{0,{longest}}}))"
    rests = docs.select(id_column, F.explode(F.regexp_extract_all(text_column, F.lit(ahead), F.lit(1))).alias("rest"))
    rests = rests.withColumn("start", F.lower(F.substring("rest", 1, TITLE_CHARS)))
    cut = rests.join(titles.select("start", "chars").distinct(), "start").where(F.length("rest") >= F.col("chars"))
    # as \b after the title: of its last character and the next, one is part of a word
    last, after = F.expr("substring(rest, chars, 1)"), F.expr("substring(rest, chars + 1, 1)")
    cut = cut.where(last.rlike(r"(?U)\w") != after.rlike(r"(?U)\w"))
    said = cut.select(F.md5(F.lower(F.expr("substring(rest, 1, chars)")).cast("binary")).alias("digest"), id_column).distinct()
    return said.join(titles.select(F.md5(F.col("key").cast("binary")).alias("digest"), "key").distinct(), "digest").select("key", id_column)


def lead_members(docs: DataFrame, source: str = "source", id_column: str = "doc_id", text_column: str = "text", title_column: str | None = None) -> DataFrame:
    """(relation, key, side, source, id): every document behind a lead between two sources.

    Relations are same_text and shared_part, whose documents are all of side
    'member', and section_applies where a title column is given: 'mention' says
    see or refer to the title that 'target' has. Two documents of one relation and
    key, of different sources and, for section_applies, sides, are a lead; pairs of
    several relations count as same_text, then section_applies, then shared_part.
    Rows grow with the documents, not with the pairs.
    """
    text = docs.where(F.length(text_column) >= SHARED_CHARS).select(F.lit("same_text").alias("relation"), F.sha2(text_column, 256).alias("key"), F.lit("member").alias("side"), source, id_column)
    parts = docs.select(F.lit("shared_part").alias("relation"), F.explode(T.identifiers(F.col(text_column))).alias("key"), F.lit("member").alias("side"), source, id_column)
    rows = text.unionByName(parts)
    if title_column:
        title = F.trim(title_column)
        targets = docs.where(F.length(title) >= TITLE_CHARS).select(F.lit("section_applies").alias("relation"), F.lower(title).alias("key"), F.lit("target").alias("side"), source, id_column)
        found = title_mentions(docs, title_column, id_column, text_column).withColumnRenamed(id_column, "__id")
        of = docs.select(source, id_column).distinct()
        mentions = found.join(of, F.col("__id") == F.col(id_column)).select(F.lit("section_applies").alias("relation"), "key", F.lit("mention").alias("side"), source, id_column)
        rows = rows.unionByName(targets).unionByName(mentions)
    other = F.when(F.col("side") == "mention", "target").when(F.col("side") == "target", "mention").otherwise("member")
    spans = rows.groupBy("relation", "key", other.alias("side")).agg(F.min(F.struct(source)).alias("__low"), F.max(F.struct(source)).alias("__high"))
    # most keys are one source's own, which no member of theirs can cross
    several = ~F.col("__low").eqNullSafe(F.col("__high"))
    spans = spans.where(several | (F.col("side") != "member"))
    own = F.struct(source)
    met = rows.join(spans, ["relation", "key", "side"]).where(several | ~own.eqNullSafe(F.col("__low")))
    return met.select("relation", "key", "side", source, id_column)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, href) of every link of a page (page_id, html), in order, as the page parser reads them."""
    links = read_pages(pages).select("page_id", F.posexplode("page.links").alias("ord", "l"))
    return links.select("page_id", "ord", F.col("l.href").alias("href"))


def link_status(links: DataFrame, documents: DataFrame, members: DataFrame) -> DataFrame:
    """Links (path, reason, fragment) with a status: the first rule that holds.

    ``documents`` has path, available and anchors; ``members`` has the paths
    that the source holds besides.
    """
    targets = documents.select(F.col("path").alias("__path"), F.col("available").alias("__available"), F.col("anchors").alias("__anchors"))
    others = members.select(F.col("path").alias("__member")).distinct()
    joined = links.join(targets, F.col("path") == F.col("__path"), "left").join(others, F.col("path") == F.col("__member"), "left")
    known = F.col("__path").isNotNull()
    status = (
        F.when(F.col("reason").isNotNull(), "blocked")
        .when(known & ~F.col("__available"), "unavailable")
        .when(known & (F.coalesce(F.col("fragment"), F.lit("")) != "") & ~F.array_contains("__anchors", F.col("fragment")), "missing_fragment")
        .when(known, "resolved")
        .when(F.col("__member").isNotNull(), "unsupported")
        .otherwise("missing")
    )
    return joined.withColumn("status", status).drop("__path", "__available", "__anchors", "__member")


#: Sources of a target that are shown.
BACKLINK_CAP = 14


def backlinks(edges: DataFrame, most: int = BACKLINK_CAP) -> DataFrame:
    """(target, sources, linked): the first distinct sources that link to a target, itself left out, and how many there are.

    No more than ``most`` are gathered, however many pages link to one.
    """
    pairs = edges.where("source <> target").select("source", "target").distinct()
    first = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    shown = pairs.withColumn("__place", first).where(F.col("__place") <= most).groupBy("target").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    return shown.join(pairs.groupBy("target").agg(F.count("*").alias("linked")), "target")


def anchor_candidates(references: DataFrame, sections: DataFrame) -> DataFrame:
    """References (doc_id, path, href) with record_id, the decision of the section of the same page that they name, and reason.

    ``sections`` has doc_id, anchor and decision_id. Only a bare fragment, or one on
    the page's own name, names a section of it; all else has to be looked at on its own.
    """
    name, fragment = F.regexp_extract("href", r"^([^?#:]*)#(.+)$", 1), F.regexp_extract("href", r"^([^?#:]*)#(.+)$", 2)
    own = (fragment != "") & ((name == "") | (name == F.element_at(F.split("path", "/"), -1)))
    at = sections.select(F.col("doc_id").alias("__doc"), F.col("anchor").alias("__anchor"), F.col("decision_id").alias("record_id"))
    rows = references.withColumn("__fragment", F.when(own, F.url_decode(F.replace(fragment, F.lit("+"), F.lit("%2B")))))
    rows = rows.join(at, (F.col("doc_id") == F.col("__doc")) & (F.col("__fragment") == F.col("__anchor")), "left")
    reason = F.when(F.col("record_id").isNotNull(), "anchor of the same page; nothing else is reviewed").otherwise("destination needs a review of its own")
    return rows.withColumn("reason", reason).drop("__doc", "__anchor", "__fragment")


def navigation_labels(documents: DataFrame, routes: DataFrame) -> DataFrame:
    """(doc_id, labels): every route to a document, distinct, without empty labels.

    ``documents`` has doc_id, path, page (of a PDF, else null), title and
    breadcrumbs. Pages of a PDF lie under its name in hundreds; a document that
    no route (doc_id, labels) leads to lies under its breadcrumbs.
    """
    first = (F.floor((F.col("page") - 1) / 100) * 100 + 1).cast("string")
    last = (F.floor((F.col("page") - 1) / 100) * 100 + 100).cast("string")
    book = F.array(F.element_at(F.split("path", "/"), -1), F.concat(F.lit("Pages "), first, F.lit("-"), last), F.concat(F.lit("Page "), F.col("page").cast("string")))
    pages = documents.where("page is not null").select("doc_id", book.alias("labels"))
    led = documents.where("page is null").join(routes.select("doc_id", "labels"), "doc_id", "left")
    own = F.coalesce("labels", F.concat(F.coalesce("breadcrumbs", F.array().cast("array<string>")), F.array("title")))
    told = led.select("doc_id", F.filter(own, lambda x: F.coalesce(x, F.lit("")) != "").alias("labels")).where(F.size("labels") > 0)
    return pages.unionByName(told).distinct()


def landing_dedupe(records: DataFrame, entries: DataFrame, group: str) -> DataFrame:
    """Records with a role; those whose text is that of their group's entry page become landing pages."""
    entry = entries.select(F.col(group).alias("__group"), F.col("text_sha256").alias("__entry")).distinct()
    joined = records.join(entry, (F.col(group) == F.col("__group")) & (F.col("text_sha256") == F.col("__entry")), "left")
    return joined.withColumn("role", F.when(F.col("__entry").isNotNull(), F.lit("landing")).otherwise(F.col("role"))).drop("__group", "__entry")


def membership(scope_units: DataFrame) -> DataFrame:
    """(unit_id, signature): the sorted scopes that a unit is in; units of one signature share shards."""
    return scope_units.groupBy("unit_id").agg(F.array_join(F.sort_array(F.collect_set("scope")), ",").alias("signature"))


def carry_forward(rows: DataFrame, group: str, order: str, heading) -> DataFrame:
    """Rows with the last heading at or before them."""
    window = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last(heading, ignorenulls=True).over(window))


def sections(anchors: DataFrame, group: str, position: str) -> DataFrame:
    """Anchors with where their section ends: the next anchor's place, or null at the end."""
    return anchors.withColumn("until", F.lead(position).over(Window.partitionBy(group).orderBy(position)))


def chain_breaks(events: DataFrame, group: str, order: str) -> DataFrame:
    """Events whose ``parent_id`` is not the id of the event before them in their group."""
    before = F.lag("event_id").over(Window.partitionBy(group).orderBy(order))
    return events.withColumn("expected", before).where(~F.col("expected").eqNullSafe(F.col("parent_id")))


def contiguity_breaks(chunks: DataFrame, group: str) -> DataFrame:
    """Chunks that don't begin where the chunk before them ends."""
    end = F.lag(F.col("offset") + F.col("size")).over(Window.partitionBy(group).orderBy("offset"))
    return chunks.withColumn("previous_end", end).where(F.col("previous_end").isNotNull() & (F.col("previous_end") != F.col("offset")))


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(column, n) for every listed value, zero where no row has it."""
    listed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return listed.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def content_digest(members: DataFrame, group: str, row) -> DataFrame:
    """(group, digest) of members in whatever order they come.

    Members' own digests are gathered, sorted and hashed in 4,096 buckets by their
    first digits, and the buckets' digests again, so no task gathers a group.
    """
    own = members.select(group, F.sha2(row, 256).alias("own"))
    line = lambda column: F.sha2(F.array_join(F.sort_array(F.collect_list(column)), "\n"), 256)
    buckets = own.groupBy(group, F.substring("own", 1, 3).alias("b")).agg(line("own").alias("d"))
    return buckets.groupBy(group).agg(line(F.concat_ws(":", "b", "d")).alias("digest"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed rows, and for these the columns that differ."""
    columns = [c for c in before.columns if c != key]
    joined = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "full")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col(f"b.{key}").isNull(), "added").when(F.col(f"a.{key}").isNull(), "removed").when(F.size(differs) > 0, "changed")
    found = joined.select(F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key), change.alias("change"), F.array_join(differs, ",").alias("columns"))
    return found.where("change is not null").withColumn("columns", F.when(F.col("change") == "changed", F.col("columns")))


def captions(items: DataFrame, group: str, order: str) -> DataFrame:
    """Images with the caption that stands before them and that no image before took.

    A caption is used up by the first image after it, so an image looks back to
    the image before it only.
    """
    past = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = items.withColumn("__images", F.coalesce(F.count_if(F.col("kind") == "image").over(past), F.lit(0)))
    since = Window.partitionBy(group, "__images").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    said = F.last(F.when(F.col("kind") == "caption", F.col("label")), ignorenulls=True).over(since)
    return numbered.withColumn("caption", said).where("kind = 'image'").drop("__images")


def route_prefixes(routes: DataFrame, labels: str = "labels") -> DataFrame:
    """(parent, label, path, documents): the nodes of a navigation tree from routes of labels."""
    prefix = F.explode(F.sequence(F.lit(1), F.size(labels))).alias("depth")
    rows = routes.where(F.size(labels) > 0).select("doc_id", labels, prefix)
    path = F.array_join(F.slice(labels, 1, F.col("depth")), "/")
    parent = F.array_join(F.slice(labels, F.lit(1), F.col("depth") - 1), "/")
    nodes = rows.select(parent.alias("parent"), F.element_at(labels, F.col("depth")).alias("label"), path.alias("path"), "doc_id")
    return nodes.groupBy("parent", "label", "path").agg(F.count("*").alias("documents"))


# ---------------------------------------------------------------- queries


def q_same_text_groups(spark, sf_dir):
    return same_text_groups(load(spark, sf_dir, "documents"))


def q_shared_text(spark, sf_dir):
    return shared_text(load(spark, sf_dir, "documents"))


def q_shared_leads(spark, sf_dir):
    """Identifiers that cross sources, and a notice that every thirteenth document holds alone."""
    docs = load(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 13 == 0, F.lit("Notice: " + "this text is the same in several sources. " * 3)).otherwise(F.concat("text", F.lit("\nPART-"), F.col("doc_id") % 37 + 100))
    return leads(docs.withColumn("text", text))


def q_lead_members(spark, sf_dir):
    odd = F.col("doc_id") % 2 == 1
    part = F.when(odd, F.concat(F.lit("\nPART-"), F.col("doc_id") % 37 + 100)).otherwise("")
    mention = F.when(F.col("doc_id") % 6 == 3, F.concat(F.lit("\nRefer to  service NOTE "), F.col("doc_id") * 7 % 600, F.lit("."))).otherwise("")
    docs = load(spark, sf_dir, "documents").withColumn("text", F.concat("text", part, mention))
    return lead_members(docs.withColumn("title", F.concat(F.lit("Service note "), F.col("doc_id") % 500)), title_column="title")


def q_page_links(spark, sf_dir):
    return page_links(load(spark, sf_dir, "pages")).withColumn("ord", F.col("ord").cast("long"))


def _site_paths(spark, sf_dir):
    """Links between pages: a page's path is its first word, links go to words."""
    pages = load(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_extract("html", "<h1>([^< ]*)", 1), r"[^\p{L}]", "")
    docs = pages.select(F.concat(F.lit("/"), path).alias("path"), (F.col("page_id") % 9 != 0).alias("available"), F.array(F.lit("top")).alias("anchors"), "page_id")
    docs = docs.groupBy("path").agg(F.min("page_id").alias("page_id"), F.max("available").alias("available"), F.first("anchors").alias("anchors"))
    links = page_links(pages).withColumn("ord", F.col("ord").cast("long"))
    reason = F.when(F.col("href").contains(","), F.lit("punctuation in URL"))
    fragment = F.when((F.col("page_id") + F.col("ord")) % 5 == 0, F.lit("end")).otherwise(F.lit(""))
    return docs, links.withColumn("path", F.col("href")).withColumn("reason", reason).withColumn("fragment", fragment)


def q_link_status(spark, sf_dir):
    docs, links = _site_paths(spark, sf_dir)
    links = reliable(links)  # links and members are of one reading of the pages
    members = links.where("length(path) = 3").select("path")
    return link_status(links, docs, members).select("page_id", "ord", "status")


def q_navigation_labels(spark, sf_dir):
    """Documents as pages of a book, with routes, or with breadcrumbs alone."""
    key = F.col("doc_id")
    docs = load(spark, sf_dir, "documents")
    named = docs.select("doc_id", F.concat(F.lit("a/"), "source", F.lit(".pdf")).alias("path"), F.when(key % 3 == 0, key + 1).alias("page"), F.col("lang").alias("title"), F.when(key % 2 == 0, F.array("source", F.lit(""))).alias("breadcrumbs"))
    routes = docs.where("doc_id % 5 = 1").select("doc_id", F.explode(F.array(F.array("lang"), F.array(F.lit(""), F.col("source"), F.col("lang")), F.array("lang"))).alias("labels"))
    return navigation_labels(named, routes).select("doc_id", F.array_join("labels", "/").alias("labels"))


def q_anchor_candidates(spark, sf_dir):
    """Links of documents to sections of their own page, of other pages, and to what is none."""
    key = F.col("doc_id")
    docs = load(spark, sf_dir, "documents")
    forms = F.array(*[F.concat(F.lit(a), (key % 7).cast("string"), F.lit(b)) for a, b in (("#s", ""), ("p.html#s", ""), ("q.html#s", ""), ("http://e/p.html#s", ""), ("?x#s", ""), ("#", "%20s"), ("s", ""))])
    references = docs.select("doc_id", F.lit("a/p.html").alias("path"), F.explode(forms).alias("href"))
    sections = docs.where("doc_id % 7 < 4").select("doc_id", F.explode(F.array(F.concat(F.lit("s"), (key % 7).cast("string")), F.concat((key % 7).cast("string"), F.lit(" s")))).alias("anchor"), F.concat(F.lit("d"), key).alias("decision_id"))
    return anchor_candidates(references, sections).select("doc_id", "href", "record_id")


def q_backlinks(spark, sf_dir):
    docs, links = _site_paths(spark, sf_dir)
    edges = links.join(docs.select("path", F.col("page_id").alias("target")), "path").select(F.col("page_id").alias("source"), "target")
    return backlinks(edges).select("target", F.concat_ws(",", F.col("sources").cast("array<string>")).alias("sources"), "linked")


def q_landing_dedupe(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), F.lit("procedure").alias("role"))
    entry = docs.groupBy("source").agg(F.min_by("text_sha256", "doc_id").alias("text_sha256"))
    return landing_dedupe(docs, entry, "source").select("doc_id", "role")


def _scope_units(docs):
    scopes = F.filter(F.array(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.lit("even")), F.when(F.col("n_chars") > 1500, F.lit("long"))), lambda s: s.isNotNull())
    return docs.select(F.col("doc_id").alias("unit_id"), F.explode(scopes).alias("scope"))


def q_membership(spark, sf_dir):
    return membership(_scope_units(load(spark, sf_dir, "documents")))


def q_shard_pack(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    units = membership(_scope_units(docs)).join(docs.select(F.col("doc_id").alias("unit_id"), F.length("text").alias("chars")), "unit_id")
    return shard_pack(units)


def q_running_limit(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    total = running_sum(docs.select("doc_id", "n_chars"), "doc_id", "n_chars", "total")
    return total.select("doc_id", "total", (F.col("total") > 1_000_000).alias("over"))


def q_heading_carry(spark, sf_dir):
    talk = load(spark, sf_dir, "conversations")
    rows = carry_forward(talk, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")))
    return rows.select("conv_id", "turn", "heading")


def q_section_slices(spark, sf_dir):
    talk = load(spark, sf_dir, "conversations").where("role = 'user'")
    return sections(talk, "conv_id", "turn").select("conv_id", "turn", "until")


def q_next_step(spark, sf_dir):
    talk = load(spark, sf_dir, "conversations")
    following = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return talk.select("conv_id", "turn", following.alias("next_turn"))


def q_sequence_gaps(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    printed = F.col("event_id") % 4 + 1
    rows = events.select("user_id", "event_id", printed.alias("printed"), F.lag(printed).over(order).alias("before"))
    return rows.where("before is not null and printed <> before + 1").select("user_id", "event_id", "printed", "before")


def q_nth_of_type(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber")
    selector = F.concat("l_returnflag", F.lit(":nth-of-type("), F.row_number().over(order), F.lit(")"))
    return lines.select("l_orderkey", "l_linenumber", selector.alias("selector"))


def q_chain_breaks(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    parent = F.when(F.col("event_id") % 10 == 0, F.lit(-1)).otherwise(F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    return chain_breaks(events.select("user_id", "event_id", parent.alias("parent_id")), "user_id", "event_id")


def q_contiguity(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    chunks = lines.select("l_orderkey", (F.col("l_linenumber") * 10).alias("offset"), F.when(F.col("l_quantity") > 25, 10).otherwise(9).alias("size"))
    chunks = chunks.groupBy("l_orderkey", "offset").agg(F.max("size").alias("size"))
    return contiguity_breaks(chunks, "l_orderkey").select("l_orderkey", "offset", "previous_end")


def q_status_counts(spark, sf_dir):
    return zero_filled(load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"])


def q_content_digest(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    row = F.concat_ws("\n", F.col("doc_id").cast("string"), F.length("text").cast("string"), F.sha2("text", 256))
    return content_digest(docs, "source", row)


def q_snapshot_diff(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    after = part.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return snapshot_diff(part.where("p_partkey % 13 <> 0"), after, "p_partkey")


def q_set_operations(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    sets = docs.groupBy("source").agg(F.collect_set(F.col("doc_id") % 37).alias("a"), F.collect_set(F.col("n_chars") % 37).alias("b"))
    return sets.select(
        "source",
        F.size(F.array_intersect("a", "b")).cast("long").alias("both"),
        F.size(F.array_except("a", "b")).cast("long").alias("only_a"),
        F.size(F.array_union("a", "b")).cast("long").alias("any"),
        (F.size(F.array_except("a", "b")) == 0).alias("subset"),
    )


def q_captions(spark, sf_dir):
    talk = load(spark, sf_dir, "conversations")
    items = talk.select("conv_id", "turn", F.when(F.col("role") == "assistant", "image").otherwise("caption").alias("kind"), F.col("turn").cast("string").alias("label"))
    return captions(items, "conv_id", "turn").select("conv_id", "turn", "caption")


def q_navigation_tree(spark, sf_dir):
    routes = load(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source", (F.floor((F.col("doc_id") - 1) / 100) * 100 + 1).cast("string")).alias("labels"))
    return route_prefixes(routes)


def q_normalization_summary(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if(F.trim("text") != "").alias("searchable"),
        F.count_if(F.length("text") != F.col("n_chars")).alias("changed"),
        F.max(F.length("text")).cast("long").alias("longest"),
    )


QUERIES = {
    "same_text_groups": q_same_text_groups,
    "shared_text": q_shared_text,
    "shared_leads": q_shared_leads,
    "lead_members": q_lead_members,
    "page_links": q_page_links,
    "link_status": q_link_status,
    "backlinks": q_backlinks,
    "navigation_labels": q_navigation_labels,
    "anchor_candidates": q_anchor_candidates,
    "landing_dedupe": q_landing_dedupe,
    "membership_signature": q_membership,
    "shard_pack": q_shard_pack,
    "running_limit": q_running_limit,
    "heading_carry": q_heading_carry,
    "section_slices": q_section_slices,
    "next_step": q_next_step,
    "sequence_gaps": q_sequence_gaps,
    "nth_of_type": q_nth_of_type,
    "chain_breaks": q_chain_breaks,
    "contiguity_breaks": q_contiguity,
    "status_counts": q_status_counts,
    "content_digest": q_content_digest,
    "snapshot_diff": q_snapshot_diff,
    "set_operations": q_set_operations,
    "caption_as_of": q_captions,
    "navigation_tree": q_navigation_tree,
    "normalization_summary": q_normalization_summary,
}

_HREF = r'<a\s+href="([^"]*)"'
_NAME = r"lower(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1))"
_PATHS = rf"""links AS (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS ord FROM (SELECT page_id, regexp_extract_all(html, '{_HREF}', 1) AS h FROM pages)),
docs AS (SELECT '/' || regexp_replace(regexp_extract(html, '<h1>([^< ]*)', 1), '[^\p{{L}}]', '', 'g') AS path, min(page_id) AS page_id, bool_or(page_id % 9 <> 0) AS available FROM pages GROUP BY 1)"""
_SCOPES = """scopes AS (SELECT doc_id AS unit_id, unnest(list_filter([lang, CASE WHEN doc_id % 2 = 0 THEN 'even' END, CASE WHEN n_chars > 1500 THEN 'long' END], lambda s: s IS NOT NULL)) AS scope FROM documents)"""

ORACLE_SQL = {
    "same_text_groups": "SELECT source, sha256(text) AS text_sha256, count(*) AS members, min(doc_id) AS first FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "shared_text": f"SELECT doc_id, leader FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS leader, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE length(text) >= {SHARED_CHARS}) WHERE n > 1",
    "shared_leads": f"""WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 13 = 0 THEN 'Notice: ' || repeat('this text is the same in several sources. ', 3)
        ELSE text || chr(10) || 'PART-' || (doc_id % 37 + 100) END AS text FROM documents),
      x AS (SELECT 'same_text' AS relation, sha256(text) AS key, source, doc_id FROM d WHERE length(text) >= 80
        UNION ALL SELECT 'shared_part', unnest(list_distinct(list_filter(list_transform(regexp_extract_all(upper(text), '[A-Z0-9-]+'), lambda r: regexp_extract(r, '(?:^|-)([A-Z0-9]{{4,}}-[A-Z0-9-]{{3,}})$', 1)), lambda r: r <> ''))), source, doc_id FROM d),
      s AS (SELECT relation, key, source, min(doc_id) AS first, count(*) AS documents FROM x GROUP BY ALL)
      SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY relation, key) AS sources FROM s) WHERE sources > 1""",
    "lead_members": f"""WITH d AS (SELECT doc_id, source, 'service note ' || (doc_id % 500) AS title, text || CASE WHEN doc_id % 2 = 1 THEN chr(10) || 'PART-' || (doc_id % 37 + 100) ELSE '' END
        || CASE WHEN doc_id % 6 = 3 THEN chr(10) || 'Refer to  service NOTE ' || (doc_id * 7 % 600) || '.' ELSE '' END AS text FROM documents),
      x AS (SELECT 'same_text' AS relation, sha256(text) AS key, source, doc_id FROM d WHERE length(text) >= {SHARED_CHARS}
        UNION ALL SELECT 'shared_part', unnest(list_distinct(list_filter(list_transform(regexp_extract_all(upper(text), '[A-Z0-9-]+'), lambda r: regexp_extract(r, '(?:^|-)([A-Z0-9]{{4,}}-[A-Z0-9-]{{3,}})$', 1)), lambda r: r <> ''))), source, doc_id FROM d),
      m AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(text), '\\b(?:see|refer to)\\s+(service note [0-9]+)\\b', 1)) AS key FROM d)
      SELECT relation, key, 'member' AS side, source, doc_id FROM x WHERE EXISTS (SELECT 1 FROM x y WHERE y.relation = x.relation AND y.key = x.key AND y.source <> x.source)
      UNION ALL SELECT 'section_applies', key, 'mention', source, doc_id FROM m WHERE EXISTS (SELECT 1 FROM d WHERE title = key AND d.source <> m.source)
      UNION ALL SELECT 'section_applies', title, 'target', source, doc_id FROM d WHERE EXISTS (SELECT 1 FROM m WHERE key = title AND d.source <> m.source)""",
    "page_links": f"SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS ord FROM (SELECT page_id, regexp_extract_all(html, '{_HREF}', 1) AS h FROM pages)",
    "link_status": f"""WITH {_PATHS} SELECT l.page_id, ord, CASE WHEN contains(href, ',') THEN 'blocked' WHEN d.path IS NOT NULL AND NOT available THEN 'unavailable'
      WHEN d.path IS NOT NULL AND (l.page_id + ord) % 5 = 0 THEN 'missing_fragment' WHEN d.path IS NOT NULL THEN 'resolved' WHEN length(href) = 3 THEN 'unsupported' ELSE 'missing' END AS status
      FROM links l LEFT JOIN docs d ON href = d.path""",
    "backlinks": f"""WITH {_PATHS} SELECT target, string_agg(source, ',' ORDER BY source) FILTER (k <= 14) AS sources, count(*) AS linked
      FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source) AS k FROM (SELECT DISTINCT l.page_id AS source, d.page_id AS target FROM links l JOIN docs d ON href = d.path WHERE l.page_id <> d.page_id)) GROUP BY 1""",
    "navigation_labels": """SELECT doc_id, source || '.pdf/Pages ' || (doc_id // 100 * 100 + 1) || '-' || (doc_id // 100 * 100 + 100) || '/Page ' || (doc_id + 1) AS labels FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 3 > 0 AND doc_id % 5 = 1 UNION ALL SELECT doc_id, source || '/' || lang FROM documents WHERE doc_id % 3 > 0 AND doc_id % 5 = 1
      UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '/' ELSE '' END || lang FROM documents WHERE doc_id % 3 > 0 AND doc_id % 5 <> 1""",
    "anchor_candidates": """SELECT doc_id, href, CASE WHEN doc_id % 7 < 4 AND named THEN 'd' || doc_id END AS record_id FROM documents,
      LATERAL (SELECT unnest(['#s' || (doc_id % 7), 'p.html#s' || (doc_id % 7), 'q.html#s' || (doc_id % 7), 'http://e/p.html#s' || (doc_id % 7), '?x#s' || (doc_id % 7), '#' || (doc_id % 7) || '%20s', 's' || (doc_id % 7)]) AS href,
        unnest([true, true, false, false, false, true, false]) AS named)""",
    "landing_dedupe": "SELECT doc_id, CASE WHEN text = first_value(text) OVER (PARTITION BY source ORDER BY doc_id) THEN 'landing' ELSE 'procedure' END AS role FROM documents",
    "membership_signature": f"WITH {_SCOPES} SELECT unit_id, string_agg(scope, ',' ORDER BY scope) AS signature FROM scopes GROUP BY 1",
    # bins one after the other, as a recursion over each signature's units
    "shard_pack": f"""WITH RECURSIVE {_SCOPES}, g AS (SELECT unit_id, string_agg(scope, ',' ORDER BY scope) AS signature FROM scopes GROUP BY 1),
      u AS (SELECT unit_id, signature, length(text) AS chars, row_number() OVER (PARTITION BY signature ORDER BY unit_id) AS k FROM g JOIN documents ON doc_id = unit_id),
      r AS (SELECT signature, k, unit_id, CAST(0 AS BIGINT) AS bin, chars AS held FROM u WHERE k = 1
        UNION ALL SELECT u.signature, u.k, u.unit_id, r.bin + CASE WHEN held >= 96000 OR held + chars > 96000 THEN 1 ELSE 0 END,
          CASE WHEN held >= 96000 OR held + chars > 96000 THEN chars ELSE held + chars END FROM r JOIN u ON u.signature = r.signature AND u.k = r.k + 1)
      SELECT unit_id, signature, bin FROM r""",
    "running_limit": "SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS total, sum(n_chars) OVER (ORDER BY doc_id) > 1000000 AS over FROM documents",
    "heading_carry": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations",
    "section_slices": "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM conversations WHERE role = 'user'",
    "next_step": "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations",
    "sequence_gaps": """SELECT user_id, event_id, printed, before FROM (SELECT user_id, event_id, event_id % 4 + 1 AS printed, lag(event_id % 4 + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
      WHERE before IS NOT NULL AND printed <> before + 1""",
    "nth_of_type": "SELECT l_orderkey, l_linenumber, l_returnflag || ':nth-of-type(' || row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) || ')' AS selector FROM lineitem",
    "chain_breaks": """WITH e AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM events),
      p AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN -1 ELSE expected END AS parent_id FROM e) SELECT user_id, event_id, parent_id, expected FROM p WHERE parent_id IS DISTINCT FROM expected""",
    "contiguity_breaks": """WITH c AS (SELECT l_orderkey, l_linenumber * 10 AS "offset", max(CASE WHEN l_quantity > 25 THEN 10 ELSE 9 END) AS size FROM lineitem GROUP BY 1, 2),
      p AS (SELECT l_orderkey, "offset", lag("offset" + size) OVER (PARTITION BY l_orderkey ORDER BY "offset") AS previous_end FROM c) SELECT * FROM p WHERE previous_end <> "offset" """,
    "status_counts": "SELECT s.status, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY 1",
    "content_digest": "SELECT source, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b)) AS digest FROM (SELECT source, substr(own, 1, 3) AS b, sha256(string_agg(own, chr(10) ORDER BY own)) AS d FROM (SELECT source, sha256(doc_id || chr(10) || length(text) || chr(10) || sha256(text)) AS own FROM documents) GROUP BY 1, 2) GROUP BY 1",
    "snapshot_diff": """WITH b AS (SELECT * FROM part WHERE p_partkey % 13 <> 0), a AS (SELECT * FROM part WHERE p_partkey % 11 <> 0)
      SELECT coalesce(b.p_partkey, a.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN a.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
      CASE WHEN b.p_partkey IS NOT NULL AND a.p_partkey IS NOT NULL THEN 'p_size' END AS columns
      FROM b FULL JOIN a ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_partkey % 7 = 0""",
    "set_operations": """WITH s AS (SELECT source, list(DISTINCT doc_id % 37) AS a, list(DISTINCT n_chars % 37) AS b FROM documents GROUP BY 1)
      SELECT source, len(list_intersect(a, b)) AS both, len(a) - len(list_intersect(a, b)) AS only_a, len(list_distinct(list_concat(a, b))) AS any, len(a) = len(list_intersect(a, b)) AS subset FROM s""",
    "caption_as_of": """SELECT conv_id, turn, caption FROM (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w <> 'assistant' THEN lag(turn) OVER w::VARCHAR END AS caption
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant'""",
    "navigation_tree": """WITH d AS (SELECT doc_id, lang, source, CAST(CAST(floor((doc_id - 1) / 100) * 100 + 1 AS BIGINT) AS VARCHAR) AS b FROM documents)
      SELECT '' AS parent, lang AS label, lang AS path, count(*) AS documents FROM d GROUP BY ALL
      UNION ALL SELECT lang, source, lang || '/' || source, count(*) FROM d GROUP BY ALL
      UNION ALL SELECT lang || '/' || source, b, lang || '/' || source || '/' || b, count(*) FROM d GROUP BY ALL""",
    "normalization_summary": "SELECT source, count(*) AS documents, count(*) FILTER (trim(text) <> '') AS searchable, count(*) FILTER (length(text) <> n_chars) AS changed, max(length(text)) AS longest FROM documents GROUP BY 1",
}
