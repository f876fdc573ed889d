"""Hashed character n-grams, their document frequencies, and bounded samples.

Defined results: a null or empty text has no feature and counts as a row; texts
are read whole, window by window; an empty table has no counts and no sample;
rows without a label are not for these functions, callers leave them out; null
and repeated ids are sampled like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WINDOW_CHARS, reliable, slices

_SHORT = 4096
#: Labels up to which their counts are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 10_000


def gram_counts(text: str, orders: tuple[int, ...], bits: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers below 2**bits and how often each occurs in the whole text.

    Features are hashes of runs of n code points, n in ``orders``; ``fold``
    lower-cases first. Long texts are counted window by window.
    """
    if fold:
        text = text.lower()
    dense, found = None, []
    longest = max(orders)
    for begin in range(0, len(text), WINDOW_CHARS):
        # the last code points of the window before are part of the first runs of this one
        early = min(begin, longest - 1)
        codes = np.frombuffer(text[begin - early : begin + WINDOW_CHARS].encode("utf-32-le", "surrogatepass"), "<u4")
        for order in orders:
            skip = early - (order - 1) if early else 0
            if codes.size - skip < order:
                continue
            runs = codes.size - skip - order + 1
            value = np.full(runs, order, np.uint32)
            for step in range(order):
                value = value * np.uint32(0x01000193) + codes[skip + step : skip + step + runs]
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x2C1B3C6D)
            value ^= value >> np.uint32(12)
            found.append(value >> np.uint32(32 - bits))
        if begin + WINDOW_CHARS < len(text) or dense is not None:
            counts = np.bincount(np.concatenate(found), minlength=1 << bits) if found else 0
            dense, found = counts if dense is None else dense + counts, []
    if dense is None:
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        values = np.concatenate(found)
        if values.size < _SHORT:
            return np.unique(values, return_counts=True)
        dense = np.bincount(values, minlength=1 << bits)
    where = np.flatnonzero(dense)
    return where, dense[where]


def document_frequencies(docs: DataFrame, orders: tuple[int, ...], bits: int, fold: bool) -> tuple[np.ndarray, int]:
    """In how many rows of column ``text`` each feature occurs, and the number of rows.

    Counted over all rows; what comes to the driver is one number for each
    feature, 2**bits at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total[gram_counts(text.as_py() or "", orders, bits, fold)[0]] += 1
                rows += 1
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(where, -1)), pa.array(np.append(total[where], rows))], ["feature", "n"]
        )

    counted = docs.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    out, rows = np.zeros(1 << bits, np.int64), 0
    for feature, n in counted.collect():
        if feature < 0:
            rows = n
        else:
            out[feature] = n
    return out, rows


def inverse_frequencies(counts: np.ndarray, rows: int) -> np.ndarray:
    return np.log((1.0 + rows) / (1.0 + counts)).astype(np.float32) + np.float32(1.0)


def weighted(text: str, orders: tuple[int, ...], bits: int, fold: bool, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF vector of unit length: feature numbers and weights."""
    where, counts = gram_counts(text, orders, bits, fold)
    values = (1.0 + np.log(counts)).astype(np.float32) * idf[where]
    norm = float(np.sqrt((values * values).sum()))
    return where, values / norm if norm else values


def bounded_sample(keys: DataFrame, label: str, per_label: int, in_all: int, *parts: str) -> DataFrame:
    """About ``per_label`` rows of each label, or all where there are fewer, and about ``in_all`` of all labels.

    Rows equal in the columns ``parts`` count as one and are drawn together, by a
    hash of these, so the same rows every time. With very many labels each has a
    smaller share of ``in_all``, but its row with the smallest hash is always drawn,
    so no label is lost.
    """
    spot = F.xxhash64(F.lit(7), *parts)
    # a sketch of the distinct hashes, so rows aren't dealt out to be counted
    sizes = keys.groupBy(label).agg(F.approx_count_distinct(spot, 0.02).alias("__rows"), F.min(F.pmod(spot, F.lit(1 << 30))).alias("__least"))
    sizes = reliable(sizes)
    labels = max(1, sizes.count())
    if labels <= BROADCAST_LABELS:
        # else the rows, texts and all, would be dealt out by label
        sizes = F.broadcast(sizes)
    share = F.lit(min(float(per_label), in_all / labels)) / F.col("__rows")
    place = F.pmod(spot, F.lit(1 << 30))
    drawn = (place < F.least(F.lit(1.0), share) * (1 << 30)) | (place == F.col("__least"))
    return keys.join(sizes, label).where(drawn).drop("__rows", "__least")


def sample_vectors(rows: DataFrame, vector: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """[(id, label, features, weights)] of a bounded sample (columns id, label, text), by id.

    ``vector`` makes sparse vectors of a bounded size, however long a text is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, 2)):
            where, values = [], []
            for text in batch.column(2):
                a, b = vector(text.as_py() or "")
                where.append(a.astype("<u4").tobytes())
                values.append(b.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(where, pa.binary()), pa.array(values, pa.binary())],
                ["id", "label", "features", "weights"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = rows.select("id", "label", "text").mapInArrow(
        run, f"id {kinds['id']}, label {kinds['label']}, features binary, weights binary"
    )
    got = [(r[0], r[1], np.frombuffer(r[2], "<u4"), np.frombuffer(r[3], "<f4")) for r in found.collect()]
    got.sort(key=lambda r: (r[0] is None, r[0], r[1], r[2].tobytes(), r[3].tobytes()))
    return got
