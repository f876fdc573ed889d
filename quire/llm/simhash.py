"""Near-duplicates: SimHash by deletion-variant signatures, or verified resemblance.

``op2_simhash`` is what follows. ``cluster`` and ``keep_one`` as such, and so the
pipeline's stage, hold candidates to five-word resemblance (``quire.llm.resemblance``):
all fingerprints that the links below connect are candidates, and so are texts that
share minima, since a resemblance of 0.8 may differ in more bits than three.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that
differ in three bits or fewer differ in one bit at most in one of the segments,
so they share a variant of that segment with one bit masked. All 2 x 32 variants
of each distinct fingerprint are indexed, equal variants meet, and the whole
fingerprints are compared there.

What meets in a bucket is never multiplied out: a breadth-first walk over the
bucket gives a spanning forest of its links, at most one edge for each member.
Buckets beyond ``BUCKET_ROWS`` members are cut into blocks, and each pair of
blocks is walked in a task of its own, so no link is lost and no task grows.
Buckets whose members all agree on the masked bit repeat another bucket (the one
that masks bit 0) and are skipped. Copies are folded into one fingerprint first.

Defined results: a null or blank text has fingerprint zero; it is linked
like any other by bits, with texts of no words only by resemblance; a null id keeps its row and doesn't count for the smallest id of its
component, unless no other is there; repeated rows stay; an empty table gives an
empty table. Other columns are ignored (``fingerprints``, ``cluster``) or kept
(``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import resemblance
from quire.llm.common import partitions, reliable, table, unused, word_windows
from quire.llm.graph import components
from quire.plans.sizes import dealt, small

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Members of a bucket that one task compares; larger buckets go block by block.
BUCKET_ROWS = 8192


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    counts, shingles, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    # bytes.lower() folds A-Z, and bytes.split() cuts at 0x20 and 0x09-0x0D
    for words in word_windows((text or "").encode("utf-8", "surrogatepass").lower(), width):
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        reach = min(width, len(words))
        spots = zip(starts[: len(words) - reach + 1].tolist(), ends[reach - 1 :].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spots], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        shingles += hashes.size
    return int(_POWERS[counts * 2 > shingles].sum(dtype=np.uint64)) if shingles else 0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row's text as a signed long; no shuffle."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "fp"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints, breadth first."""
    left, right = [], []
    rest = members
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= MAX_BITS
            if near.any():
                found = rest[near]
                left.append(np.full(found.size, one))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each bucket; its rows follow one another, ordered by (key, i, j)."""
    held, name = [], None

    def edges(parts: list[np.ndarray]) -> pa.RecordBatch | None:
        u, v = _forest(np.unique(np.concatenate(parts)))
        if u.size:
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
        return None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
        fps = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(fps)]
        out_u, out_v = [], []
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            this = tuple(keys[begin].tolist())
            if this != name and held:
                if (made := edges(held)) is not None:
                    out_u.append(made.column(0))
                    out_v.append(made.column(1))
                held = []
            name = this
            held.append(fps[begin:end])
        if out_u:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(out_u), pa.concat_arrays(out_v)], ["u", "v"])
    if held and (made := edges(held)) is not None:
        yield made


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect all that are near."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    variants = [
        F.struct(
            F.lit((segment * 32 + bit) << 32).bitwiseOR(part.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit)))).alias("key"),
            F.shiftrightunsigned(part, bit).bitwiseAND(F.lit(1)).cast("byte").alias("masked"),
        )
        for segment, part in enumerate((low, high))
        for bit in range(32)
    ]
    # each fingerprint becomes 64 rows, so they are dealt to all tasks before
    spread = distinct.select("fp").repartition(partitions(distinct), "fp")
    keyed = spread.select("fp", F.explode(F.array(*variants)).alias("x")).select("fp", "x.key", "x.masked")
    bit = F.shiftrightunsigned("key", 32) % 32
    sizes = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("masked").alias("a"), F.max("masked").alias("b"))
        .where((F.col("n") > 1) & ((bit == 0) | (F.col("a") != F.col("b"))))
        .select("key", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("blocks"))
    )
    # few buckets are told to all tasks, so variants that meet nothing aren't dealt out again
    met = keyed.select("key", "fp").join(small(reliable(sizes)), "key")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.select("key", "fp", block.alias("block"), other.alias("other")).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp"
    )
    met = met.repartition(partitions(distinct), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(_walk, "u bigint, v bigint")


def _near_signs(prints: DataFrame) -> DataFrame:
    """(fp, key): shingle sets by the component of their texts' fingerprints (column sign), as ``op2_simhash`` links these."""
    signs = reliable(prints.select("fp", "sign").distinct())
    roots = components(links(reliable(signs.select(F.col("sign").alias("fp")).distinct())))
    named = signs.join(dealt(roots.select(F.col("u").alias("sign"), F.col("v").alias("root"))), "sign", "left")
    return reliable(named.select("fp", F.xxhash64(F.coalesce("root", "sign"), F.lit("sign")).alias("key")).distinct())


def cluster(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int | None = None) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that near links reach.

    Near are texts whose five-word resemblance is 0.8 or more (``resemblance``;
    fp names the shingle set) or, given ``bits``, texts whose SimHash
    fingerprints of three words differ in that many bits, which must be three.
    """
    if bits is None:
        prints = reliable(resemblance.prints(docs, id_column, text_column, fingerprint))
        sized = prints.select("id", "fp", "bands", (F.length("shingles") / 4).cast("long").alias("size"))
        distinct = reliable(sized.groupBy("fp").agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"), F.first("size").alias("size")))
        roots = components(resemblance.links(prints, distinct, groups=_near_signs(prints)))
    elif bits == MAX_BITS:
        prints = reliable(fingerprints(docs, id_column, text_column))
        distinct = reliable(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
        roots = components(links(distinct))
    else:
        raise ValueError(f"links are cut for {MAX_BITS} bits")
    reach = roots.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    reach = reach.unionByName(reach.select(F.col("root").alias("fp"), "root").distinct())
    least = (
        reach.join(dealt(distinct), "fp")
        .groupBy("root")
        .agg(F.min("first_id").alias("least_id"))
        .join(dealt(reach), "root")
        .select("fp", "least_id")
    )
    # computed anew, fp no longer carries the layout of its table: both sides are then
    # dealt out by the join itself, which can split a fingerprint that very many rows share
    anew = F.coalesce("fp", F.lit(0).cast("long")).alias("fp")
    named = distinct.join(dealt(least), "fp", "left").select(anew, F.coalesce("least_id", "first_id").alias("component_id"))
    return prints.join(dealt(named), "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def hex_digits(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their text's component, all columns kept.

    Each row is decided by its own text: of an id that stands for several texts,
    those stay that have no near text of a smaller id. Rows that repeat a kept id
    and text all stay: ids name documents, so they are copies of one decision.
    Rows without an id stay too.
    """
    groups = cluster(docs, id_column, text_column).select(F.col(id_column).alias("id"), "fp", "component_id")
    gone = F.col("id") != F.col("component_id")
    name, mark = unused(docs, "gone"), unused(docs, "name")
    decided = reliable(
        groups.where("id is not null").groupBy(F.col("id").alias(name)).agg(F.max(gone).alias("some"), F.min(gone).alias("all")).where("some")
    )
    kept = docs.join(decided.select(name), docs[id_column] == F.col(name), "left_anti")
    torn = decided.where("not all").select(name)
    if torn.isEmpty():
        return kept
    # few ids stand for several texts; only their rows are read again
    doubtful = docs.join(torn, docs[id_column] == F.col(name), "left_semi").withColumn(mark, resemblance.name(text_column))
    lost = groups.where(gone).join(torn, F.col("id") == F.col(name), "left_semi").select(F.col("id").alias(name), "fp").distinct()
    lost = lost.withColumnRenamed("fp", f"{mark}_lost")
    own = doubtful.join(lost, (F.col(id_column) == F.col(name)) & (F.col(mark) == F.col(f"{mark}_lost")), "left_anti")
    return kept.unionByName(own.drop(mark))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return cluster(table(spark, sf_dir, "documents"), bits=MAX_BITS).select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
