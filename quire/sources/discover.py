"""What a folder holds, and the way each thing is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.relations import zero_filled
from quire.sources import archives, files

IMAGES = (".iso", ".img", ".bin", ".mdf", ".nrg")
STATES = ["recognized", "partial", "failed", "unsupported"]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, folder) of a folder's immediate children, by Spark's own file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in system.listStatus(place)]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0].casefold()), "name string, path string, folder boolean")


def routes(children: DataFrame, held: DataFrame) -> DataFrame:
    """Children with status and route; ``held`` has child and path of every file below a child.

    A folder with archives below ``content`` is a disc, as is an image; other
    folders, ZIP and PDF files are plain sources; the rest stays as unsupported.
    """
    lower = F.lower("path")
    below = held.groupBy("child").agg(
        F.max(lower.rlike(r"(^|/)content/.*\.arc$")).alias("disc"),
        F.max(lower.rlike(r"(^|/)index\.html$")).alias("index"),
        F.max(lower.rlike(r"(^|/)pages/[^/]+\.html?$")).alias("pages"),
        F.max(lower.endswith(".pdf")).alias("pdf"),
    )
    rows = children.join(below, children["name"] == below["child"], "left")
    name = F.lower("name")
    image = ~F.col("folder") & F.substring_index(name, ".", -1).isin(*[i[1:] for i in IMAGES])
    route = (
        F.when(F.col("folder") & F.col("disc"), "disc")
        .when(image, "disc")
        .when(F.col("folder") & ((F.col("index") & F.col("pages")) | F.col("pdf")), "folder")
        .when(~F.col("folder") & (name.endswith(".zip") | name.endswith(".pdf")), "file")
    )
    reason = F.when(F.col("folder"), "nothing that can be read").otherwise("unsupported file type")
    return rows.select("name", "path", F.when(route.isNotNull(), "recognized").otherwise("unsupported").alias("status"), route.alias("route"), F.when(route.isNull(), reason).alias("reason"))


def counts(found: DataFrame) -> DataFrame:
    return zero_filled(found, "status", STATES)


@dataclass
class Source:
    """Tables of one source: its members, its failures, its publications, its state."""

    members: DataFrame
    failures: DataFrame
    publications: DataFrame
    status: str
    digest: str


def inspect(spark: SparkSession, path: str) -> Source:
    """Read a folder, a ZIP file or a PDF: members, failures, publications by format; partial if some failed, failed if nothing is left.

    The limits of number and size hold; what is beyond them has failed. So has a
    member that belongs to no publication, or to two.
    """
    from quire.plans.package import open_source

    source = open_source(spark, path)
    publications = files.source_format(source.members)
    lost = source.members.select("path").join(publications, F.col("path").startswith(F.col("root")), "left").groupBy("path").agg(F.count("root").alias("n"))
    problem = F.when(F.col("n") == 0, "unassigned").when(F.col("n") > 1, "overlap")
    apart = lost.select("path", problem.alias("code"), F.concat(F.lit("belongs to publications: "), F.col("n").cast("string")).alias("message")).where("code is not null")
    failures = source.failures.unionByName(apart)
    broken = source.status == "partial" or not apart.isEmpty()
    status = "failed" if publications.isEmpty() else "partial" if broken else "complete"
    return Source(source.members, failures, publications, status, source.digest)


def probe(spark: SparkSession, path: str, sample: int = 25, seed: int = 0) -> DataFrame:
    """(archive, entries, checked, failed, errors): a sample of each archive's entries, decoded.

    The sample is the entries with the smallest hash of name and seed, so it is
    the same every time; payloads of the others aren't decoded.
    """
    from pyspark.sql import Window

    found = archives.entries(spark, path, payloads=False)
    order = Window.partitionBy("archive").orderBy(F.xxhash64("name", F.lit(seed)), "name")
    chosen = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("archive", "name")
    read = archives.entries(spark, path).join(chosen, ["archive", "name"], "left_semi")
    errors = F.slice(F.sort_array(F.collect_list("error")), 1, 5)
    checked = read.groupBy("archive").agg(F.count("*").alias("checked"), F.count("error").alias("failed"), errors.alias("errors"))
    return found.groupBy("archive").agg(F.count("name").alias("entries")).join(checked, "archive", "left")


def unpacked(spark: SparkSession, path: str, out: str) -> None:
    """All entries of all archives below a folder as a Parquet table, one folder an archive."""
    rows = archives.entries(spark, path).withColumn("book", F.regexp_extract("archive", r"([^/]+?)(\.[^./]*)?$", 1))
    rows.write.mode("errorifexists").partitionBy("book").parquet(out)


def attach_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages with the OCR text made for exactly these bytes and this many pages."""
    return pages.join(ocr, ["path", "sha256", "page_count"], "left")
