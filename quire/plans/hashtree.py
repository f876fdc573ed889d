"""Digests of a folder of tables as a tree, so that a reader checks what it opens and nothing else.

A leaf is a file of a table, with the digest of its bytes and, where the table has a
key, the range of that in it. Leaves are dealt to ``BUCKETS`` inner nodes by their names; a
node is the digest of its leaves, and the root that of all nodes. The nodes are one
small record, whatever the number of files. To open a part of a table its leaves are
chosen by their ranges, their nodes are checked against the record, and the files
against their leaves; other files aren't read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import canonical_digest
from quire.plans.fixpoint import reliable
from quire.plans.store import files_of, read_text, write_text

BUCKETS = 256
#: Files whose names are given to one scan; more are read as the whole table, whose files are all checked then.
MOST_NAMED = 10_000


class Damaged(RuntimeError):
    """A file, leaf or node that isn't what the one above it says."""


def _name(spark: SparkSession, column, root: str):
    """A file's name below the folder, however the folder's address is spelt."""
    folder = files_of(spark, root)[1].toUri().getPath().rstrip("/") + "/"
    return F.substring(column, F.locate(folder, column) + len(folder), F.length(column))


def _digests(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(file, size, sha256) of files, read where they lie."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(paths)
    return read.select(_name(spark, F.col("path"), root).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _nodes(leaves: DataFrame) -> dict[str, str]:
    """The digest of each node with leaves; ``BUCKETS`` rows at most are gathered."""
    line = F.concat_ws("\t", "file", "size", "sha256", F.coalesce("least", F.lit("")), F.coalesce("most", F.lit("")))
    # a node's leaves are one list in order; files are few beside rows, and a node has one of BUCKETS shares of them
    rows = leaves.select("bucket", line.alias("line")).groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256).alias("digest"))
    return {str(row["bucket"]): row["digest"] for row in rows.collect()}


def write(spark: SparkSession, root: str, keys: dict[str, str | None]) -> str:
    """Write the tree of a folder's tables, each with the column whose ranges its leaves tell or None; gives the root's digest."""
    leaves = None
    for table, key in keys.items():
        place = f"{root.rstrip('/')}/{table}"
        found = _digests(spark, root, [place]).withColumn("table", F.lit(table))
        if key:
            # only the key is read
            span = F.col(key).cast("string")
            named = _name(spark, F.url_decode(F.input_file_name()), root)
            found = found.join(spark.read.parquet(place).groupBy(named.alias("file")).agg(F.min(span).alias("least"), F.max(span).alias("most")), "file", "left")
        else:
            none = F.lit(None).cast("string")
            found = found.withColumn("least", none).withColumn("most", none)
        found = found.select("table", "file", "size", "sha256", "least", "most")
        leaves = found if leaves is None else leaves.unionByName(found)
    leaves = reliable(leaves.withColumn("bucket", (F.crc32(F.col("file").cast("binary")) % BUCKETS).cast("int")))
    leaves.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root.rstrip('/')}/leaves")
    nodes = _nodes(leaves)
    top = canonical_digest(nodes)
    write_text(spark, f"{root.rstrip('/')}/tree.json", json.dumps({"nodes": nodes, "root": top}, sort_keys=True))
    return top


class Tree:
    """A folder of tables whose files are checked when they are first opened."""

    def __init__(self, spark: SparkSession, root: str, expected: str | None = None):
        self.spark, self.root, self.checked = spark, root.rstrip("/"), set()
        said = json.loads(read_text(spark, f"{self.root}/tree.json"))
        if canonical_digest(said["nodes"]) != said["root"] or expected not in (None, said["root"]):
            raise Damaged("the tree's nodes aren't those of its root")
        self._nodes, self._sound = said["nodes"], set()

    def _leaves(self, table: str, low: str | None, high: str | None) -> list:
        """The leaves of a table whose ranges meet an interval, after their nodes are checked."""
        leaves = self.spark.read.parquet(f"{self.root}/leaves").where(F.col("table") == table)
        if low is not None or high is not None:
            leaves = leaves.where((F.lit(high).isNull() | (F.col("least") <= F.lit(high))) & (F.lit(low).isNull() | (F.col("most") >= F.lit(low))))
        found = leaves.select("file", "sha256", "bucket").collect()  # a row a file that is opened
        new = {row["bucket"] for row in found} - self._sound
        if new:
            whole = self.spark.read.parquet(f"{self.root}/leaves").where(F.col("bucket").isin(new))
            if _nodes(whole) != {str(b): self._nodes.get(str(b)) for b in new}:
                raise Damaged(f"leaves of {table} aren't those of their nodes")
            self._sound |= new
        return found

    def open(self, table: str, low: str | None = None, high: str | None = None) -> DataFrame:
        """A table, or its files that may hold keys from ``low`` to ``high``; ``Damaged`` if a file of these changed."""
        leaves = self._leaves(table, low, high)
        if not leaves:
            if low is None and high is None and self.spark.read.parquet(f"{self.root}/{table}").inputFiles():
                raise Damaged(f"{table} has files without a leaf")
            return self.spark.read.parquet(f"{self.root}/{table}").limit(0)
        if low is None and high is None:
            system, _ = files_of(self.spark, self.root)
            held = {name.rsplit("/", 1)[-1] for name in self.spark.read.parquet(f"{self.root}/{table}").inputFiles()}
            if not held <= {row["file"].rsplit("/", 1)[-1] for row in leaves}:
                raise Damaged(f"{table} has files without a leaf")
        whole = len(leaves) > MOST_NAMED
        leaves = self._leaves(table, None, None) if whole else leaves
        unseen = {row["file"]: row["sha256"] for row in leaves if row["file"] not in self.checked}
        if unseen:
            expected = self.spark.createDataFrame(list(unseen.items()), "file string, expected string")
            places = [f"{self.root}/{table}"] if whole else [f"{self.root}/{name}" for name in unseen]
            read = _digests(self.spark, self.root, places).join(F.broadcast(expected), "file", "right")
            bad = [row["file"] for row in read.where("sha256 IS NULL OR sha256 <> expected").select("file").limit(10).collect()]
            if bad:
                raise Damaged(f"changed since it was written: {', '.join(sorted(bad))}")
            self.checked |= set(unseen)
        if whole or low is None and high is None:
            return self.spark.read.parquet(f"{self.root}/{table}")
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{row['file']}" for row in leaves])
