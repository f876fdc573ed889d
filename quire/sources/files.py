"""Folders of manual files: inventory, limits, page counts, drawings and manifests."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from quire.functions import ids
from quire.functions import text as T
from quire.plans.prefix import running_sum
from quire.sources import svg

# Limits and ignored names.
MOST_FILES, MOST_FILE_BYTES, MOST_BYTES = 200_000, 1 << 30, 20 << 30
IGNORED = r"(^|/)(__MACOSX/|\.DS_Store$|Thumbs\.db$|\._)"


def inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(members, failures) of all files below a folder.

    Members have path (relative), size, sha256, media_type; failures have path,
    code, message: unsafe names, names that differ in case or form only, sizes
    and totals beyond the limits.
    """
    root = path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    tail = F.substring_index("path", root, -1)
    # a file beyond the limit is never read: its length is a column of the listing
    fine = F.col("length") <= MOST_FILE_BYTES
    rows = files.where(fine).select(tail.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    rows = rows.unionByName(files.where(~fine).select(tail.alias("path"), F.col("length").alias("size"), F.lit(None).cast("string").alias("sha256")))
    rows = rows.where(~F.col("path").rlike(IGNORED)).withColumn("unsafe", T.unsafe_path(F.col("path")))
    rows = rows.join(collisions(rows.where("unsafe is null")), "path", "left")
    problem = (
        F.when(F.col("unsafe").isNotNull(), F.struct(F.lit("unsafe_path").alias("code"), F.col("unsafe").alias("message")))
        .when(F.col("kept").isNotNull(), F.struct(F.lit("path_collision").alias("code"), F.concat(F.lit("same as "), "kept").alias("message")))
        .when(F.col("size") > MOST_FILE_BYTES, F.struct(F.lit("size_limit").alias("code"), F.lit("file is too large").alias("message")))
    )
    rows = rows.withColumn("problem", problem)
    members = rows.where("problem is null").select("path", "size", "sha256", T.media_type(F.col("path")).alias("media_type"))
    failures = rows.where("problem is not null").select("path", "problem.code", "problem.message")
    return members, failures


def prefixes(path: Column) -> Column:
    """A path's folders and itself, the shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def collisions(members: DataFrame) -> DataFrame:
    """(path, kept): paths of which a folder, or they themselves, differ from an earlier path's in case or form only.

    The path first in order keeps its spelling; a file and a folder of one name collide, too.
    """
    every = members.select("path", F.posexplode(prefixes(F.col("path"))).alias("k", "prefix"))
    keyed = every.withColumn("folded", collision_key("prefix"))
    first = keyed.groupBy("folded").agg(F.min(F.struct("path", "prefix")).alias("first"), F.countDistinct("prefix").alias("n")).where("n > 1")
    met = keyed.join(first, "folded").where(F.col("prefix") != F.col("first.prefix"))
    return met.groupBy("path").agg(F.min_by("first.prefix", "k").alias("kept"))


@F.pandas_udf(K.StringType())
def collision_key(path: pd.Series) -> pd.Series:
    """Names equal under Unicode composition and case folding are one."""
    return path.map(lambda p: unicodedata.normalize("NFC", p).casefold())


def over_limits(members: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, code) of members that come after a limit is reached, in order of an id column ``ord``."""
    counted = running_sum(running_sum(members.withColumn("one", F.lit(1)), "ord", "one", "files"), "ord", "size", "bytes")
    code = F.when(F.col("files") > most_files, "file_limit").when(F.col("bytes") > most_bytes, "total_size_limit")
    return counted.select("path", code.alias("code")).where("code is not null")


def source_digest(members: DataFrame) -> DataFrame:
    """One row: a digest of all members that doesn't depend on their order.

    Members are hashed to a fixed number of buckets, each bucket's own digests
    are sorted and hashed, and the bucket digests are hashed again.
    """
    own = members.select(ids.digest(F.concat_ws("\n", "path", F.col("size").cast("string"), "sha256")).alias("own"))
    buckets = own.groupBy(F.substring("own", 1, 3).alias("bucket")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("own")), "\n"), 256).alias("d"))
    return buckets.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "bucket", "d"))), "\n"), 256).alias("digest"))


def source_format(members: DataFrame) -> DataFrame:
    """(root, format): a folder with index.html beside pages/*.html is an HTML export, a PDF file is its own root."""
    html = members.where(F.lower("path").rlike(r"(^|/)index\.html$")).select(F.regexp_replace("path", "(?i)index\\.html$", "").alias("root"))
    pages = members.where(F.lower("path").rlike(r"(^|/)pages/[^/]+\.html?$")).select(F.regexp_replace("path", "(?i)pages/[^/]+$", "").alias("root"))
    found = html.join(pages, "root", "left_semi").select("root", F.lit("html_export").alias("format"))
    return found.unionByName(members.where(F.lower("path").endswith(".pdf")).select(F.col("path").alias("root"), F.lit("pdf").alias("format"))).distinct()


_PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")


def pdf_page_count(data: bytes) -> tuple[int | None, str | None]:
    """(pages, error) by the page objects that a PDF's bytes show."""
    if not data.startswith(b"%PDF-"):
        return None, "not a PDF"
    if b"/Encrypt" in data:
        return None, "encrypted"
    count = len(_PAGE.findall(data))
    if not count:
        return None, "pages are inside object streams" if b"/ObjStm" in data else "no pages"
    return count, None


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, pages, error) of every PDF below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(p, *pdf_page_count(bytes(d))) for p, d in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(found, columns=["path", "pages", "error"]).astype({"pages": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, pages int, error string")


def page_texts(documents: DataFrame, native: str = "native", ocr: str = "ocr") -> DataFrame:
    """(id, page, text, provenance): pages cut at form feeds, native text first, OCR where it is blank."""
    pages = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "\f")
    rows = documents.select("id", F.posexplode(F.arrays_zip(pages(native).alias("n"), pages(ocr).alias("o"))).alias("k", "p"))
    first, second = F.nullif(F.trim("p.n"), F.lit("")), F.nullif(F.trim("p.o"), F.lit(""))
    kind = F.when(first.isNotNull(), "native").when(second.isNotNull(), "ocr").otherwise("none")
    return rows.select("id", (F.col("k") + 1).alias("page"), F.coalesce(first, second, F.lit("")).alias("text"), kind.alias("provenance"))


# ---------------------------------------------------------------- drawings


@F.pandas_udf(K.StructType([K.StructField("svg", K.BinaryType()), K.StructField("reason", K.StringType())]))
def static_svg(content: pd.Series) -> pd.DataFrame:
    """The static subset of each drawing, or why it has none."""
    rows = []
    for data in content:
        try:
            rows.append((svg.safe_svg(bytes(data)), None))
        except svg.Refused as stopped:
            rows.append((None, str(stopped)))
    return pd.DataFrame(rows, columns=["svg", "reason"])


def described_vehicles(members: DataFrame) -> DataFrame:
    """(path, statement, selector, structured struct<year,name,engine>) of original drawings (path, content) that name a vehicle; refused ones give none."""

    @F.pandas_udf("array<struct<statement:string,selector:string,structured:struct<year:string,name:string,engine:string>>>")
    def run(content: pd.Series) -> pd.Series:
        def read(data) -> list[dict]:
            try:
                found = svg.described(bytes(data))
            except svg.Refused:
                return []
            return [{"statement": said, "selector": selector, "structured": dict(zip(("year", "name", "engine"), parts, strict=True))} for said, selector, parts in found]

        return content.map(read)

    drawings = members.where(F.lower("path").endswith(".svg"))
    return drawings.select("path", F.explode(run("content")).alias("s")).select("path", "s.*")


def image_pages(listings: DataFrame) -> DataFrame:
    """(path, page) of pages with a raster image, from the listings that ``pdfimages -list`` prints (path, listing)."""
    lines = F.slice(F.split("listing", r"\r?\n"), 3, 1 << 30)  # two lines are headings
    number = F.regexp_extract("line", r"^\s*([0-9]+)(?:\s|$)", 1)
    return listings.select("path", F.explode(lines).alias("line")).where(number != "").select("path", number.cast("int").alias("page")).distinct()


def figure_status(figures: DataFrame, members: DataFrame) -> DataFrame:
    """Figures (path, reason) with a status by what their file is, and ``svg``, what a safe drawing may show.

    ``detail`` says why a drawing isn't safe. Only drawings are parsed; of all
    other files the first bytes are read, which have to be those of their type.
    """
    drawing = F.lower("path").endswith(".svg")
    held = members.select(F.col("path").alias("__path"), F.hex(F.substring("content", 1, 8)).alias("__head"), F.when(drawing, F.col("content")).alias("__svg"))
    held = held.where("__svg is not null").withColumn("__safe", static_svg("__svg")).unionByName(
        held.where("__svg is null").withColumn("__safe", F.lit(None).cast("struct<svg:binary,reason:string>"))
    ).drop("__svg")
    rows = figures.join(held, F.col("path") == F.col("__path"), "left")
    kind = T.media_type(F.col("path"))
    raster = (
        ((kind == "image/png") & F.col("__head").startswith("89504E470D0A1A0A"))
        | ((kind == "image/jpeg") & F.col("__head").startswith("FFD8FF"))
        | ((kind == "image/gif") & F.col("__head").rlike("^474946383[79]61"))
    )
    status = (
        F.when(F.col("reason").isNotNull(), "blocked")
        .when(F.col("__path").isNull(), "missing")
        .when(F.col("__safe.svg").isNotNull(), "safe_svg")
        .when(raster, "raster")
        .otherwise("unsupported")
    )
    return rows.select(*figures.columns, status.alias("status"), F.col("__safe.svg").alias("svg"), F.col("__safe.reason").alias("detail"))


# ---------------------------------------------------------------- manifests and wiring


def _xml(text: str):
    """The root element; bare ampersands are escaped in a second try."""
    text = text.lstrip("﻿").strip()
    for markup in (text, re.sub(r"&(?!#?\w+;)", "&amp;", text)):
        try:
            return ET.fromstring(markup)
        except ET.ParseError:
            continue
    return None


def manifest(text: str) -> dict | None:
    """code, type, title and vehicles of a book's manifest, well-formed or not; None if it is none."""
    root = _xml(text)
    if root is not None:
        said = lambda node, tag: (node.findtext(tag) or "").strip()
        book = {k: said(root, k) for k in ("code", "type", "title")}
        book["vehicles"] = [{k: said(v, k) for k in ("year", "name", "engine")} for v in root.iter("vehicle")]
    else:
        head = re.split(r"(?i)<sections\b", text)[0]
        found = lambda tag: (re.search(rf"(?is)<{tag}>(.*?)</{tag}>", head) or ["", ""])[1].strip()
        book = {k: found(k) for k in ("code", "type", "title")}
        pairs = re.findall(r"(?is)<year>(.*?)</year>\s*<name>(.*?)</name>", text)
        book["vehicles"] = [{"year": y.strip(), "name": n.strip(), "engine": ""} for y, n in pairs]
    return book if book["code"] or book["type"] else None




def _strings(*names: str) -> list[K.StructField]:
    return [K.StructField(n, K.StringType()) for n in names]


MANIFEST = K.StructType([*_strings("code", "type", "title"), K.StructField("vehicles", K.ArrayType(K.StructType(_strings("year", "name", "engine"))))])


@F.pandas_udf(MANIFEST)
def manifests(text: pd.Series) -> pd.DataFrame:
    empty = {"code": None, "type": None, "title": None, "vehicles": None}
    return pd.DataFrame([manifest(t or "") or empty for t in text], columns=["code", "type", "title", "vehicles"])


PARTS = ("conn", "ground", "splice", "fuse")


WIRING = K.StructType(
    [*_strings("title", "type"), K.StructField("parts", K.ArrayType(K.StructType(_strings("kind", "name", "loc", "zone", "face", "view")))), *_strings("error")]
)


@F.pandas_udf(WIRING)
def wiring_pages(text: pd.Series) -> pd.DataFrame:
    """Parts of a circuit sheet's metadata; a malformed one keeps its row, with an error."""
    rows = []
    for markup in text:
        try:
            page = ET.fromstring(markup)
        except ET.ParseError as stopped:
            rows.append((None, None, [], str(stopped)))
            continue
        page = page if page.tag == "page" else page.find("page")
        if page is None:
            rows.append((None, None, [], "no page"))
            continue
        said = lambda node, tag: (node.findtext(tag) or "").strip()
        parts = [
            {"kind": kind, "name": said(p, "name"), "loc": said(p, "loc"), "zone": said(p, "zone"), "face": said(p, "face_view").lower(), "view": said(p, "loc_view").lower()}
            for kind in PARTS
            for p in page.iter(kind)
        ]
        rows.append((said(page, "title"), said(page, "type"), parts, None))
    return pd.DataFrame(rows, columns=["title", "type", "parts", "error"])


def wiring_parts(sheets: DataFrame) -> DataFrame:
    """A row for each part of each sheet (columns sheet, xml); views of sheets that don't exist are blanked."""
    read = sheets.withColumn("page", wiring_pages("xml"))
    parts = read.select("sheet", "page.title", F.explode("page.parts").alias("p")).select("sheet", "title", "p.*")
    known = sheets.select(F.lower("sheet").alias("view")).distinct().withColumn("__known", F.lit(True))
    return parts.join(known, "view", "left").withColumn("view", F.when(F.col("__known"), F.col("view")).otherwise("")).drop("__known")


def connectors(markup: str) -> list[dict]:
    """Faces with their pins; pins outside any face go to the first face."""
    root = _xml(markup)
    found = []
    for c in root.iter("Connector") if root is not None else ():
        pins = lambda holder: [{"cavity": p.get("Cavity", ""), "circuit": p.get("CircuitNumber", ""), "color": p.get("Color", "")} for p in holder.findall("./Pins/Pin")]
        faces = [{"file": (f.get("File") or "").lower(), "gender": f.get("Gender") or c.get("Gender", ""), "pins": pins(f)} for f in c.findall(".//Face")]
        loose = pins(c)
        if loose and not any(f["pins"] for f in faces):
            faces = faces or [{"file": "", "gender": c.get("Gender", ""), "pins": []}]
            faces[0]["pins"] = loose
        found.append({"name": c.get("CNumber", ""), "description": c.get("des", ""), "faces": faces})
    return found


CONNECTOR = "array<struct<name:string,description:string,faces:array<struct<file:string,gender:string,pins:array<struct<cavity:string,circuit:string,color:string>>>>>>"


def connector_table(sheets: DataFrame) -> DataFrame:
    """(sheet, name, description, faces, pins) of the connectors of each sheet (sheet, xml)."""

    def read(markup: pd.Series) -> pd.Series:
        return markup.map(lambda text: connectors(text or ""))

    rows = sheets.select("sheet", F.explode(F.pandas_udf(read, CONNECTOR)("xml")).alias("c")).select("sheet", "c.*")
    return rows.withColumn("pins", F.aggregate("faces", F.lit(0), lambda total, face: total + F.size(face["pins"])))


def wiring_index(parts: DataFrame, kind: str, containing: str = "") -> DataFrame:
    """(name, sheet, view) of the parts of one kind, of those whose name holds some letters; each once."""
    rows = parts.where((F.col("kind") == kind) & F.lower("name").contains(containing.strip().lower()))
    return rows.select("name", "sheet", "view").distinct()


def connector_sheets(parts: DataFrame, connectors_: DataFrame) -> DataFrame:
    """(name, sheet): the sheets on which each connector's number stands, whatever its letters' case."""
    on = parts.where("kind = 'conn'").select(F.lower("name").alias("__name"), F.col("sheet").alias("on")).distinct()
    return connectors_.select("name").distinct().join(on, F.lower("name") == F.col("__name")).select("name", F.col("on").alias("sheet"))


def toc(pages: DataFrame) -> DataFrame:
    """(doc_id, ord, heading, title, href) of a section list: items under the last heading before them.

    ``pages`` has doc_id and html; headings are ``h2``, items links in order.
    """
    items = F.regexp_extract_all("html", F.lit(r"(?is)(<h2[^>]*>.*?</h2>|<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)"), F.lit(1))
    rows = pages.select("doc_id", F.posexplode(items).alias("ord", "item"))
    plain = F.trim(F.regexp_replace("item", "<[^>]*>", ""))
    window = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.lower("item").startswith("<h2"), plain), ignorenulls=True).over(window)
    rows = rows.select("doc_id", "ord", heading.alias("heading"), plain.alias("title"), F.regexp_extract("item", r"(?i)href=\"([^\"]*)\"", 1).alias("href"), "item")
    return rows.where(F.lower("item").startswith("<a")).drop("item")
