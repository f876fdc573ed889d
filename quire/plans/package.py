"""From a source's files to a normalised package: members, documents, links, figures, aliases, and the library of packages.

A source is a folder, a ZIP file or a single PDF. Its files are tables all along;
a package is a folder of Parquet tables with a record of what it was made from,
and appears under its name only when it is whole.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import ids
from quire.functions import text as T
from quire.plans import hashtree
from quire.plans.fixpoint import reliable
from quire.plans.store import files_of, read_text, write_text
from quire.sources import archives, files, html

PACKAGE = "quire-package-1"
LIBRARY = "quire-library-1"
_MODULES = ("functions/ids.py", "functions/text.py", "plans/package.py", "sources/archives.py", "sources/files.py", "sources/html.py", "sources/svg.py")


class Incomplete(RuntimeError):
    """A source with failures, or a package that isn't what its record says."""


@cache
def transform_revision() -> str:
    """A digest of the code that turns files into packages; caches are good for one revision."""
    root, value = Path(__file__).resolve().parent.parent, hashlib.sha256()
    for name in _MODULES:
        value.update(name.encode() + b"\0" + (root / name).read_bytes())
    return value.hexdigest()


# ---------------------------------------------------------------- sources


@dataclass
class Source:
    """members (ord, path, size, sha256, media_type, content), failures (path, code, message), status, digest."""

    members: DataFrame
    failures: DataFrame
    status: str
    digest: str


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content, error) of a source's files, by what the path names."""
    low = path.lower().rstrip("/")
    if low.endswith(".zip"):
        rows = archives.zip_members(spark, path)
        return rows.select(F.coalesce("name", F.lit("")).alias("path"), "size", "content", "error")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if low.endswith(".pdf"):
        rows = reader.load(path)
        return rows.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("size"), "content", F.lit(None).cast("string").alias("error"))
    # a file beyond the limit is never read as bytes: its length is a column of the listing
    listed, root = reader.load(path), path.rstrip("/") + "/"
    name = F.substring_index("path", root, -1).alias("path")
    fine = F.col("length") <= files.MOST_FILE_BYTES
    read = listed.where(fine).select(name, F.col("length").alias("size"), "content", F.lit(None).cast("string").alias("error"))
    return read.unionByName(listed.where(~fine).select(name, F.col("length").alias("size"), F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("error")))


def open_source(spark: SparkSession, path: str, most_files: int = files.MOST_FILES, most_bytes: int = files.MOST_BYTES) -> Source:
    """Read a folder, a ZIP file or a PDF; what can't be a member is a failure, and the source is partial then.

    Failures are unsafe names, names that differ in case or form only, files that
    can't be read, and what comes after the limits of number and size, in order of
    names. Without a member the source has failed.
    """
    rows = _raw(spark, path).where(~F.col("path").rlike(files.IGNORED))
    rows = rows.select("path", "size", F.sha2("content", 256).alias("sha256"), T.media_type(F.col("path")).alias("media_type"), "content", "error")
    # contents are read once for their digests, and again only by who asks for the members; they are never copied here
    seen = reliable(rows.select("path", "size", "sha256", "error", T.unsafe_path(F.col("path")).alias("unsafe")))
    clash = files.collisions(seen.where("unsafe is null").select("path").distinct()).withColumnRenamed("path", "of")
    twice = seen.groupBy(F.col("path").alias("again")).agg(F.count("*").alias("n")).where("n > 1")
    limits = files.over_limits(_numbered(seen.select("path", "size")), most_files, most_bytes).select(F.col("path").alias("over"), F.col("code").alias("limit")).dropDuplicates(["over"])
    joined = seen.join(clash, F.col("path") == F.col("of"), "left").join(twice, F.col("path") == F.col("again"), "left").join(limits, F.col("path") == F.col("over"), "left")
    problem = (
        F.when(F.col("unsafe").isNotNull(), F.struct(F.lit("unsafe_path").alias("code"), F.col("unsafe").alias("message")))
        .when(F.col("kept").isNotNull() | F.col("n").isNotNull(), F.struct(F.lit("path_collision").alias("code"), F.concat(F.lit("same as "), F.coalesce("kept", "path")).alias("message")))
        .when(F.col("error").isNotNull(), F.struct(F.lit("unreadable").alias("code"), F.col("error").alias("message")))
        .when(F.col("limit").isNotNull(), F.struct(F.col("limit").alias("code"), F.lit("the source is beyond its limits").alias("message")))
    )
    judged = reliable(joined.select("path", "size", "sha256", problem.alias("problem")))
    failures = judged.where("problem is not null").select("path", "problem.code", "problem.message")
    fine = judged.where("problem is null")
    lost = failures.select(F.col("path").alias("__lost")).distinct()
    members = rows.drop("error").join(lost, F.col("path") == F.col("__lost"), "left_anti")
    count, failed = fine.count(), failures.count()
    status = "failed" if not count else "partial" if failed else "complete"
    return Source(members, failures, status, files.source_digest(fine).first()["digest"])


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``ord``, their number in order of paths: ranges are counted first, then numbered inside."""
    ranged = rows.repartitionByRange("path").select("*", F.spark_partition_id().alias("__range"))
    ranged = reliable(ranged)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("path"))
    return ranged.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range").select("path", "size", (F.col("__before") + inside).alias("ord"))


def extract(spark: SparkSession, path: str, out: str) -> str:
    """Copy a source's members into a package of tables, hash them again there, and give it its name; the digest is returned.

    A source that isn't complete writes nothing; a copy that differs is an error,
    and the folder that was begun goes.
    """
    source = open_source(spark, path)
    if source.status != "complete":
        raise Incomplete(f"source is {source.status}")
    return _finish(spark, out, {"members": source.members}, {"source_sha256": source.digest}, {"members": _unchanged})


def _unchanged(members: DataFrame) -> None:
    if not members.where(F.sha2("content", 256) != F.col("sha256")).isEmpty():
        raise Incomplete("a member changed while it was copied")


def _finish(spark: SparkSession, out: str, tables: dict[str, DataFrame], record: dict, checks: dict) -> str:
    """Write tables beside their place, check them there, add the record and move the folder to its name."""
    system, place = files_of(spark, out)
    if system.exists(place):
        raise FileExistsError(out)
    stage = out.rstrip("/") + ".staged"
    try:
        digests = {}
        for name, table in tables.items():
            key = _key(table)
            # files hold ranges of the key, so that a reader opens, and checks, few of them
            dealt = table.repartitionByRange(key).sortWithinPartitions(key) if key else table
            dealt.write.mode("overwrite").parquet(f"{stage}/{name}")
            written = spark.read.parquet(f"{stage}/{name}")
            if name in checks:
                checks[name](written)
            digests[name] = table_digest(written)
        hashtree.write(spark, stage, {name: _key(table) for name, table in tables.items()})
        whole = {"contract": PACKAGE, "transform_revision": transform_revision(), "tables": digests, **record}
        revision = ids.canonical_digest(whole)
        write_text(spark, f"{stage}/record.json", json.dumps({**whole, "revision": revision}, sort_keys=True))
        if not system.rename(files_of(spark, stage)[1], place):
            raise Incomplete("package couldn't be moved to its name")
        return revision
    except Exception:
        system.delete(files_of(spark, stage)[1], True)
        raise


def table_digest(table: DataFrame) -> str:
    """A digest of a table that doesn't depend on the order of its rows."""
    # JSON holds nested columns, maps too; binary columns are hashed first
    plain = [F.sha2(c, 256).alias(c) if t == "binary" else F.col(c) for c, t in table.dtypes]
    own = table.select(F.sha2(F.to_json(F.struct(*plain)), 256).alias("own"))
    # digests are added up in four parts, so nothing is gathered however many rows there are
    parts = [F.sum(F.conv(F.substring("own", 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return ids.canonical_digest([str(x) for x in own.agg(F.count("*"), *parts).first()])


def _key(table: DataFrame) -> str | None:
    """The column by which a table's files are ranges: the first of paths and documents that it has."""
    return next((c for c in ("path", "source_path", "document_id") if c in table.columns), None)


def _record(spark: SparkSession, path: str) -> dict:
    record = json.loads(read_text(spark, f"{path.rstrip('/')}/record.json"))
    said = {k: v for k, v in record.items() if k != "revision"}
    if record.get("contract") != PACKAGE or record.get("revision") != ids.canonical_digest(said):
        raise Incomplete("package's record changed")
    return record


def open_package(spark: SparkSession, path: str) -> tuple[hashtree.Tree, dict]:
    """A package whose files are checked when they are opened, at the cost of what is opened, and its record."""
    return hashtree.Tree(spark, path), _record(spark, path)


def read_package(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """A package's tables and record, only after every table has been digested again."""
    record = _record(spark, path)
    tables = {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in record["tables"]}
    for name, table in tables.items():
        if table_digest(table) != record["tables"][name]:
            raise Incomplete(f"table changed: {name}")
    return tables, record


# ---------------------------------------------------------------- documents


def _doc_id(publication: Column, *place: Column) -> Column:
    return ids.stable_id("doc", publication, *place)


def _html_documents(members: DataFrame, legacy: bool) -> DataFrame:
    """Records of a publication's pages, parsed once; the entry page's text makes landing pages of its copies."""
    pages = members.where(F.lower("path").rlike(r"\.html?$"))
    parsed = reliable(html.parse(pages.select("publication_id", "entry_path", "path", "sha256", "content"), legacy=legacy).drop("content"))
    entry = parsed.where("path = entry_path and page.error is null").select(F.col("publication_id").alias("__of"), F.col("page.text_sha256").alias("__entry")).distinct()
    rows = parsed.join(entry, (F.col("publication_id") == F.col("__of")) & (F.col("page.text_sha256") == F.col("__entry")), "left")
    return rows.withColumn("landing", F.col("__entry").isNotNull()).drop("__of", "__entry")


def _pdf_documents(members: DataFrame, pages: DataFrame) -> DataFrame:
    """A document for each page of a PDF (path, page, text, provenance) that the source holds."""
    held = members.where(F.lower("path").endswith(".pdf")).select("publication_id", "path", "sha256")
    rows = pages.join(held, "path")
    return rows.select(
        _doc_id(F.col("publication_id"), F.col("path"), F.col("page")).alias("document_id"), "publication_id", "path", "page", F.col("sha256").alias("content_sha256"),
        F.concat("path", F.lit(" page "), F.col("page").cast("string")).alias("title"), F.lit("pdf_page").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.coalesce("text", F.lit("")) == "", "none").otherwise(F.col("provenance")).alias("provenance"), F.array().cast("array<string>").alias("anchors"),
    )


def normalize(members: DataFrame, pages: DataFrame, known_paths: DataFrame | None = None, legacy: bool = False) -> dict[str, DataFrame]:
    """The tables of a package: documents, links, figures, statements, routes, aliases, failures.

    ``members`` has publication_id, entry_path, path, sha256 and content; ``pages``
    are the texts of PDFs (path, page, text, provenance); ``known_paths`` (path) is
    what the whole source holds where these members are a selection of it.
    """
    read = _html_documents(members, legacy)
    fine = read.where("page.error is null")
    document = _doc_id(F.col("publication_id"), F.col("path"))
    role = F.when(F.col("landing"), "landing").otherwise(F.col("page.role"))
    text = F.when(role == "procedure", F.col("page.text")).otherwise("")
    records = fine.select(
        document.alias("document_id"), "publication_id", "path", F.lit(None).cast("int").alias("page"), F.col("sha256").alias("content_sha256"), "page.title",
        role.alias("role"), text.alias("text"), F.when(text == "", "none").otherwise("native").alias("provenance"), "page.anchors",
    )
    records = records.unionByName(_pdf_documents(members, pages))
    eligible = (F.col("text") != "") & F.col("role").isin("procedure", "pdf_page")
    records = records.withColumn("search_eligible", eligible).withColumn("text_sha256", F.when(F.col("text") != "", F.sha2("text", 256)))

    asked = fine.select(document.alias("document_id"), "publication_id", F.col("path").alias("source_path"), F.posexplode("page.links").alias("ord", "l"))
    links = reliable(resolve_links(asked.select("document_id", "publication_id", "source_path", "ord", "l.*"), records, members, known_paths))
    routes = _routes(fine, document, links)
    crumbs = routes.groupBy("target_id").agg(F.min_by("labels", F.struct("source_path", "ord")).alias("__labels")).withColumnRenamed("target_id", "__target")
    own = fine.select(document.alias("__own"), F.col("page.breadcrumbs").alias("__crumbs"))
    documents = records.join(own, F.col("document_id") == F.col("__own"), "left").join(crumbs, F.col("document_id") == F.col("__target"), "left")
    stated = F.coalesce("__crumbs", F.array().cast("array<string>"))
    documents = documents.withColumn("breadcrumbs", F.when(F.size(stated) > 0, stated).otherwise(F.coalesce("__labels", stated))).drop("__own", "__crumbs", "__target", "__labels")

    figures = fine.select(document.alias("document_id"), "publication_id", F.posexplode("page.figures").alias("ord", "f")).select("document_id", "publication_id", "ord", "f.*")
    statements = fine.select(document.alias("document_id"), F.explode("page.statements").alias("s")).select("document_id", "s.*")
    nodes = fine.select(document.alias("document_id"), F.explode("page.nodes").alias("n")).select("document_id", "n.*")
    failures = read.where("page.error is not null").select("publication_id", "path", F.lit("html_normalization_failed").alias("code"), F.col("page.error").alias("message"))
    return {
        "documents": documents,
        "links": links,
        "figures": files.figure_status(figures, members.select("path", "content").dropDuplicates(["path"])),
        "statements": statements,
        "nodes": nodes,
        "routes": routes,
        "aliases": aliases(documents, statements, figures, nodes, links),
        "failures": failures,
    }


def resolve_links(links: DataFrame, documents: DataFrame, members: DataFrame, known_paths: DataFrame | None = None) -> DataFrame:
    """Links (publication_id, path, fragment, reason) with status, why and target_id.

    A page of the same publication is a target, and so is the first page of a
    PDF; a fragment has to be an anchor of it. What the selection doesn't hold but
    the whole source does lies outside the selection.
    """
    at = documents.where("page is null or page = 1").select(
        F.col("publication_id").alias("__publication"), F.col("path").alias("__path"), F.col("document_id").alias("__id"), F.col("role").alias("__role"), F.col("anchors").alias("__anchors")
    )
    held = members.select(F.col("path").alias("__member")).distinct()
    known = (known_paths if known_paths is not None else held.select(F.col("__member").alias("path"))).select(F.col("path").alias("__known")).distinct()
    rows = (
        links.join(at, (F.col("publication_id") == F.col("__publication")) & (F.col("path") == F.col("__path")), "left")
        .join(held, F.col("path") == F.col("__member"), "left")
        .join(known, F.col("path") == F.col("__known"), "left")
    )
    found = F.col("__id").isNotNull()
    lost = (F.coalesce("fragment", F.lit("")) != "") & (F.col("__role") != "pdf_page") & ~F.coalesce(F.array_contains("__anchors", F.col("fragment")), F.lit(False))
    rules = [
        (F.col("reason").isNotNull(), "blocked", F.col("reason")),
        (found & (F.col("__role") == "unavailable"), "unavailable_by_source", F.lit("the publisher left this out")),
        (found & lost, "missing", F.lit("target has no such fragment")),
        (found, "resolved", F.lit(None).cast("string")),
        (F.col("__member").isNotNull(), "unsupported", F.lit("target isn't a page")),
        (F.col("__known").isNotNull(), "outside_selection", F.lit("the source holds the target outside the selection")),
    ]
    status, why = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, name, said in reversed(rules):
        status, why = F.when(holds, F.lit(name)).otherwise(status), F.when(holds, said).otherwise(why)
    rows = rows.withColumn("status", F.coalesce(status, F.lit("missing")))
    why = F.when(status.isNull(), F.lit("target is absent")).otherwise(why)
    return rows.select(*links.columns, "status", why.alias("why"), F.when(F.col("status") == "resolved", F.col("__id")).alias("target_id"))


def _routes(pages: DataFrame, document: Column, links: DataFrame) -> DataFrame:
    """(target_id, source_path, ord, labels, fragment): every route that leads to a document, those to its other names too."""
    told = pages.select(document.alias("document_id"), F.posexplode("page.routes").alias("ord", "r")).select("document_id", "ord", "r.labels", F.col("r.link").alias("link"))
    reached = links.where("status = 'resolved'").select(F.col("document_id").alias("__from"), F.col("ord").alias("__link"), "target_id", "source_path", "fragment")
    rows = told.join(reached, (F.col("document_id") == F.col("__from")) & (F.col("link") == F.col("__link")))
    return rows.select("target_id", "source_path", "ord", "labels", "fragment")


def aliases(documents: DataFrame, statements: DataFrame, figures: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(document_id, same_text_id, same_texts, context_id, same_contexts): procedures of a publication that share a text, and of these the ones that share all around it.

    Membership instead of lists: the first document of each group stands for it, so
    rows grow with the documents.
    """
    texts = documents.where("role = 'procedure' and text <> ''").select("document_id", "publication_id", "text_sha256", "title", "breadcrumbs")
    around = {
        "statements": statements.select("document_id", F.xxhash64("level", "statement", "selector").alias("h")),
        "figures": figures.select("document_id", F.xxhash64("ord", "caption", "path").alias("h")),
        "nodes": nodes.select("document_id", F.xxhash64("node_id", "parent_id", "tag", "rowspan", "colspan").alias("h")),
        "links": links.select("document_id", F.xxhash64("ord", "path", "fragment").alias("h")),
    }
    context = [F.to_json(F.struct("title", "breadcrumbs"))]
    rows = texts
    for name, parts in around.items():
        # sums of hashes fold any number of parts before the shuffle; two seeds make chance collisions negligible
        folded = parts.groupBy(F.col("document_id").alias("__of")).agg(
            F.concat_ws(":", F.count("*").cast("string"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string"), F.sum(F.xxhash64("h", F.lit(1)).cast("decimal(38,0)")).cast("string")).alias(name)
        )
        rows = rows.join(folded, F.col("document_id") == F.col("__of"), "left").drop("__of")
        context.append(F.coalesce(name, F.lit("")))
    rows = rows.select("document_id", "publication_id", "text_sha256", F.sha2(F.concat_ws("\n", *context), 256).alias("context"))
    same = rows.groupBy("publication_id", "text_sha256").agg(F.min("document_id").alias("same_text_id"), F.count("*").alias("same_texts"))
    near = rows.groupBy("publication_id", "text_sha256", "context").agg(F.min("document_id").alias("context_id"), F.count("*").alias("same_contexts"))
    found = rows.join(same, ["publication_id", "text_sha256"]).join(near, ["publication_id", "text_sha256", "context"])
    return found.where("same_texts > 1").select("document_id", "same_text_id", "same_texts", "context_id", "same_contexts")


def write_package(spark: SparkSession, tables: dict[str, DataFrame], source: Source, out: str) -> str:
    """Write a package's tables and the members they were made from; gives its revision."""
    if source.status != "complete":
        raise Incomplete(f"source is {source.status}")
    status = "complete" if tables["failures"].isEmpty() else "partial"
    return _finish(spark, out, {"members": source.members, **tables}, {"source_sha256": source.digest, "status": status}, {"members": _unchanged})


# ---------------------------------------------------------------- caches and libraries


def cached(spark: SparkSession, source: Source, root: str, build) -> tuple[dict[str, DataFrame], dict, bool]:
    """The package of a source by this code, from the cache where one is whole, else built by ``build(source)``; whether it was reused.

    The key is the source's digest with the transform's; a cached package that was
    changed is built anew under its name.
    """
    path = f"{root.rstrip('/')}/{ids.canonical_digest([source.digest, transform_revision()])[:32]}"
    system, place = files_of(spark, path)
    if system.exists(place):
        try:
            return *read_package(spark, path), True
        except Incomplete:
            system.delete(place, True)
    write_package(spark, build(source), source, path)
    return *read_package(spark, path), False


def same_evidence(kept: DataFrame, fresh: DataFrame) -> bool:
    """Whether evidence that was kept is what a fresh capture gives, row for row."""
    fresh = fresh.select(*kept.columns)
    return kept.exceptAll(fresh).isEmpty() and fresh.exceptAll(kept).isEmpty()


def library(packages: list[tuple[str, dict]], vocabulary_revision: str, review_revision: str, superseded: dict[str, str] | None = None) -> dict:
    """A library's record of packages (place, record): every occurrence stays, two of one source too.

    A package that another one supersedes names it; that one has to be active and
    of the same source. Packages that aren't complete are for looking at only.
    """
    superseded, rows = superseded or {}, []
    places = {place: record for place, record in packages}
    if len(places) != len(packages):
        raise ValueError("a place holds one package")
    for place, record in packages:
        if record.get("status", "complete") != "complete":
            raise Incomplete(f"package isn't complete: {place}")
        by = superseded.get(place)
        if by is not None and (by not in places or by in superseded or places[by]["source_sha256"] != record["source_sha256"] and record.get("source_id") != places[by].get("source_id")):
            raise ValueError(f"{place} can't be superseded by {by}")
        occurrence = "occ_" + ids.canonical_digest([record["source_sha256"], place])[:32]
        rows.append({"occurrence_id": occurrence, "place": place, "source_sha256": record["source_sha256"], "revision": record["revision"], "status": "superseded" if by else "active", "superseded_by": by})
    made = {"contract": LIBRARY, "vocabulary_revision": vocabulary_revision, "review_revision": review_revision, "packages": rows}
    return {**made, "revision": ids.canonical_digest(made)}
