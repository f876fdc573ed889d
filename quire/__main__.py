"""Command line: ``python -m quire COMMAND ...``; exit 0 for success, 1 for a partial result, 2 for a failure."""

from __future__ import annotations

import argparse
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quire").getOrCreate()


def _inspect(spark, given) -> int:
    from quire.sources.discover import inspect

    source = inspect(spark, given.path)
    print(f"{source.status} {source.digest}")
    source.publications.show(truncate=False)
    source.failures.show(truncate=False)
    return {"complete": 0, "partial": 1}.get(source.status, 2)


def _probe(spark, given) -> int:
    from quire.sources.discover import probe

    found = probe(spark, given.path, given.sample)
    found.show(truncate=False)
    return 0 if found.where("failed > 0").isEmpty() else 1


def _unpack(spark, given) -> int:
    from quire.sources.discover import unpacked

    unpacked(spark, given.path, given.out)
    return 0 if spark.read.parquet(given.out).where("error is not null").isEmpty() else 1


def _extract(spark, given) -> int:
    from quire.plans.package import extract

    print(extract(spark, given.path, given.out))
    return 0


def _normalize(spark, given) -> int:
    """One publication a source: its entry is the index.html nearest to the root, or the first file."""
    from pyspark.sql import functions as F

    from quire.plans.package import normalize, open_source, read_package, write_package

    source = open_source(spark, given.path)
    paths = source.members.select("path", (~F.lower("path").rlike(r"(^|/)index\.html$")).alias("other"), F.size(F.split("path", "/")).alias("depth"))
    entry = paths.orderBy("other", "depth", "path").first()
    pages = spark.createDataFrame([], "path string, page int, text string, provenance string")
    if given.texts:
        pages = spark.read.schema(pages.schema).json(given.texts)
    selected = source.members.withColumn("publication_id", F.lit("pub_" + source.digest[:32])).withColumn("entry_path", F.lit(entry and entry["path"]))
    print(write_package(spark, normalize(selected, pages, legacy=given.legacy), source, given.out))
    return 0 if read_package(spark, given.out)[1]["status"] == "complete" else 1


def _verify(spark, given) -> int:
    from quire.plans.package import read_package

    tables, record = read_package(spark, given.path)
    print(record["revision"], *sorted(tables))
    return 0


def _pages(spark, given) -> int:
    from quire.sources.html import parse

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.htm*").load(given.path)
    parse(files.select("path", "content"), legacy=given.legacy).drop("content").write.mode("errorifexists").parquet(given.out)
    return 0 if spark.read.parquet(given.out).where("page.error is not null").isEmpty() else 1


def _search(spark, given) -> int:
    from quire.plans.publish import open_current, search

    folder, _ = open_current(spark, given.library, given.review)
    search(spark, folder, given.scope, given.query, given.limit).show(given.limit, truncate=False)
    return 0


def _query(spark, given) -> int:
    from quire.plans.catalog import QUERIES

    QUERIES[given.name](spark, given.tables).show(given.limit, truncate=80)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name, run, *arguments):
        one = commands.add_parser(name)
        one.set_defaults(run=run)
        for argument, options in arguments:
            one.add_argument(argument, **options)

    path, out, limit = ("path", {}), ("out", {}), ("--limit", {"type": int, "default": 20})
    command("inspect", _inspect, path)
    command("probe", _probe, path, ("--sample", {"type": int, "default": 25}))
    command("unpack", _unpack, path, out)
    command("extract", _extract, path, out)
    command("normalize", _normalize, path, out, ("--texts", {}), ("--legacy", {"action": "store_true"}))
    command("verify", _verify, path)
    command("pages", _pages, path, out, ("--legacy", {"action": "store_true"}))
    command("search", _search, ("library", {}), ("scope", {}), ("query", {}), ("--review", {"required": True}), limit)
    command("query", _query, ("name", {}), ("tables", {}), limit)
    return top


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    try:
        return given.run(_session(), given)
    except Exception as stopped:  # noqa: BLE001  the command line reports and ends
        print(f"quire: {stopped}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
