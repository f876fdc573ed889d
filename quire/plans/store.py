"""Small files in whatever store the paths name."""

from __future__ import annotations

from pyspark.sql import SparkSession


def files_of(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename over it, so a reader sees the old or the new file."""
    system, place = files_of(spark, path)
    beside = place.suffix(".next")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    how = spark._sc._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, place, how)


def read_text(spark: SparkSession, path: str) -> str:
    system, place = files_of(spark, path)
    stream = system.open(place)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text
