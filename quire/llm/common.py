"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.fixpoint import reliable as reliable
from quire.sources.html import slices as slices

#: Code points handled at once inside one text; longer texts go window by window.
WINDOW_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(id_column: str | Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def held_out(id_column: str | Column) -> Column:
    return id_remainder(id_column) == 0


_BLANK = {str: re.compile(r"\s"), bytes: re.compile(rb"\s")}


def word_windows(text, width: int, window: int = WINDOW_CHARS) -> Iterator[list]:
    """Words of a text or byte string, a window at a time, for its runs of ``width`` words.

    Windows end between words and begin with the last width - 1 words of the one
    before, so each run is in exactly one of them. A text of fewer words gives
    them all in one window, one without words gives none.
    """
    kept, at, given = [], 0, False
    while at < len(text):
        end = at + window
        if end < len(text):
            stop = _BLANK[type(text)].search(text, end)
            end = stop.start() if stop else len(text)
        words = kept + text[at:end].split()
        at = end
        if len(words) >= width or at >= len(text) and words and not given:
            yield words
            given, kept = True, words[len(words) - width + 1 :]
        else:
            kept = words


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until it is the beginning of no column's."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name = "_" + name
    return name
