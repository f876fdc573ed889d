"""Maximum inner product search with score-aware anisotropic quantisation.

Vectors are scaled to unit length and cut into pairs of components; each pair is
stored as one of sixteen codewords, four bits. Codewords and codes minimise the
residual with its part parallel to the vector weighted ``eta`` times, since that
part is what changes large inner products. A query is scanned against four-bit
tables (two codes a byte, so one table of 256 sums for each byte), and the
``RERANK`` best of each block are ranked again by exact inner products in double
precision; where more lie within the error seen among these of the k-th best,
all of them are.

Codewords are learnt on a bounded sample (``SAMPLE_ROWS``); every vector is
indexed. Queries and vectors meet block by block: a group holds at most about one
block of queries and one block of vectors, whatever the table's size, and gives
the best ``k`` of its block for each query; these are then ranked over all blocks.
Vectors and codes travel as packed arrays of many vectors a row, in the width
that the table has, once for each block of ``QUERY_ROWS`` queries.

Defined results: vectors that are null, zero, of another length than most, or
hold a null or non-finite component take no part, neither do rows with a null
id; a query's own row is no candidate; equal products are ordered by id; products
that overflow are infinite, and any that are then no number rank last; of rows
that repeat an id the first by components stays; fewer candidates than ``k`` are
all returned; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import partitions, reliable, table

PAIR, CODEWORDS = 2, 16
#: Bound of the sample that codewords are learnt on.
SAMPLE_ROWS = 8192
ROUNDS = 8
#: Cosine from which on inner products should be kept right; sets the parallel weight.
TARGET_COSINE = 0.3
#: Queries, and vectors, of a block; blocks have fewer vectors, LEAST_ROWS at least, where there are tasks for more blocks.
QUERY_ROWS, BLOCK_ROWS, LEAST_ROWS = 65536, 65536, 4096
#: Bytes, as doubles, of the vectors of a block and of the sample, so wider vectors mean fewer rows.
BLOCK_BYTES = 32 << 20
K, RERANK = 20, 400


@dataclass
class Codebook:
    words: np.ndarray  # pairs x 16 x 2
    eta: float

    @property
    def width(self) -> int:
        return self.words.shape[0] * PAIR

    def padded(self, vectors: np.ndarray) -> np.ndarray:
        return np.pad(vectors, ((0, 0), (0, self.width - vectors.shape[1])))

    def encode(self, vectors: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows x pairs) by coordinate descent on the anisotropic loss."""
        vectors = self.padded(vectors)
        parts = vectors.reshape(len(vectors), -1, PAIR)
        ways = _directions(vectors).reshape(parts.shape)
        codes = np.stack([((parts[:, p, None] - self.words[p]) ** 2).sum(-1).argmin(1) for p in range(parts.shape[1])], axis=1)
        parallel = self._parallel(parts, ways, codes)
        for _ in range(rounds):
            for p in range(parts.shape[1]):
                rest = parts[:, p, None] - self.words[p]  # rows x 16 x 2
                along = (rest * ways[:, p, None]).sum(-1)
                others = parallel - along[np.arange(len(codes)), codes[:, p]]
                loss = (rest**2).sum(-1) + (self.eta - 1) * (others[:, None] + along) ** 2
                codes[:, p] = loss.argmin(1)
                parallel = others + along[np.arange(len(codes)), codes[:, p]]
        return codes

    def _parallel(self, parts, ways, codes) -> np.ndarray:
        chosen = self.words[np.arange(parts.shape[1])[None], codes]
        return ((parts - chosen) * ways).sum((1, 2))

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        """Two four-bit codes of each vector's direction in each byte."""
        codes = self.encode(_directions(vectors))
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Sums for each byte of a packed code (bytes x 256)."""
        sums = (self.words * self.padded(query[None]).reshape(-1, 1, PAIR)).sum(-1)  # pairs x 16
        if len(sums) % 2:
            sums = np.pad(sums, ((0, 1), (0, 0)))
        return (sums[1::2, :, None] + sums[::2, None, :]).reshape(-1, CODEWORDS * CODEWORDS)


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, however long or short these are."""
    scaled = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 5e-324)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def learn(sample: np.ndarray, target: float = TARGET_COSINE, seed: int = 3) -> Codebook:
    """Codewords that minimise the anisotropic loss on the directions of a sample, pair by pair in turn."""
    width = -(-sample.shape[1] // PAIR) * PAIR
    vectors = np.pad(_directions(sample), ((0, 0), (0, width - sample.shape[1])))
    eta = max(1.0, (width - 1) * target**2 / (1 - target**2))
    parts = vectors.reshape(len(vectors), -1, PAIR)
    ways = _directions(vectors).reshape(parts.shape)
    random = np.random.default_rng(seed)
    book = Codebook(parts[random.choice(len(parts), (CODEWORDS,), replace=len(parts) < CODEWORDS)].transpose(1, 0, 2).copy(), eta)
    for _ in range(ROUNDS):
        codes = book.encode(vectors, rounds=1)
        parallel = book._parallel(parts, ways, codes)
        for p in range(parts.shape[1]):
            own, way = parts[:, p], ways[:, p]
            others = parallel - ((own - book.words[p, codes[:, p]]) * way).sum(1)
            for c in range(CODEWORDS):
                rows = codes[:, p] == c
                count = int(rows.sum())
                if not count:
                    continue
                w, x = way[rows], own[rows]
                left = count * np.eye(PAIR) + (eta - 1) * w.T @ w
                right = x.sum(0) + (eta - 1) * ((others[rows] + (w * x).sum(1))[:, None] * w).sum(0)
                book.words[p, c] = np.linalg.solve(left, right)
            parallel = others + ((own - book.words[p, codes[:, p]]) * way).sum(1)
    return book


def _best(scores: np.ndarray, count: int) -> np.ndarray:
    """Positions of the largest scores; of equal ones at the edge the first stay."""
    if scores.size <= count:
        return np.arange(scores.size)
    edge = np.partition(scores, scores.size - count)[scores.size - count]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: count - above.size]])


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for equal rows wherever they stand."""
    return (vectors * query).sum(axis=1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, book: Codebook, k: int, rerank: int):
    """(query ids, ids, scores): the k nearest of one block of vectors for each of one block of queries."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, codes = ids[order], vectors[order].astype(float), codes[order].T.astype(np.intp)
    lengths = np.linalg.norm(vectors, axis=1)
    asked, found, products = [], [], []
    for query_id, query in zip(query_ids.tolist(), queries.astype(float), strict=True):
        tables = book.tables(query)
        scores = tables[0].take(codes[0])
        for byte in range(1, len(codes)):
            scores += tables[byte].take(codes[byte])
        scores = scores * lengths
        scores[ids == query_id] = -np.inf
        near = _best(scores, rerank)
        near = near[ids[near] != query_id]
        exactly = exact(vectors[near], query)
        if near.size > k:
            # many vectors as near as the k-th: rank all that the error seen so far leaves in doubt
            doubt = np.partition(exactly, -k)[-k] - np.abs(scores[near] - exactly).max()
            wide = np.flatnonzero(scores >= doubt)
            if wide.size > near.size:
                near = np.union1d(near, wide)
                near = near[ids[near] != query_id]
                exactly = exact(vectors[near], query)
        first = np.lexsort((ids[near], -exactly))[:k]
        asked.append(np.full(first.size, query_id))
        found.append(ids[near[first]])
        products.append(exactly[first])
    return np.concatenate(asked), np.concatenate(found), np.concatenate(products)


def search(rows: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query row."""
    spark = rows.sparkSession
    narrow = rows.schema[vector_column].dataType.simpleString() == "array<float>"
    kind, width = ("float", "<f4") if narrow else ("double", "<f8")
    vectors = rows.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast(f"array<{kind}>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], f"query_id bigint, rank int, {id_column} bigint, score double")
    if sizes is None:
        return empty
    fitting = max(CODEWORDS, BLOCK_BYTES // (8 * sizes["n"]))
    blocks = max(-(-sizes["count"] // min(BLOCK_ROWS, fitting)), min(partitions(rows), -(-sizes["count"] // LEAST_ROWS)))
    # rows of an id are where its block is
    dealt = vectors.where(F.size("vector") == sizes["n"]).repartition(blocks, "id")
    vectors = reliable(dealt.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")))
    total, asked = vectors.agg(F.count("*"), F.count_if("asks")).first()
    if not asked:
        return empty
    spot = F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1 << 30))
    drawn = vectors.where(spot < int(min(1.0, min(SAMPLE_ROWS, fitting) / total) * (1 << 30))).select("id", "vector").collect() or vectors.select("id", "vector").limit(CODEWORDS).collect()
    drawn.sort()
    book = spark.sparkContext.broadcast(learn(np.array([r[1] for r in drawn], float)))

    def chunks(batches: Iterator[pa.RecordBatch], packed: Callable) -> Iterator[pa.RecordBatch]:
        """A row of packed arrays for each block in each batch (block, id, vector)."""
        for batch in batches:
            if batch.num_rows:
                block, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                parts = [(b, np.flatnonzero(block == b)) for b in np.unique(block)]
                columns = [[x.tobytes() for x in (ids[r].astype("<i8"), flat[r].astype(width), *packed(flat[r]))] for _, r in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in parts], pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*columns, strict=True)]], names=["block", "ids", "vectors", "codes"][: 1 + len(columns[0])]
                )

    number = F.pmod(F.hash("id"), F.lit(blocks)).cast("int").alias("block")
    indexed = vectors.select(number, "id", "vector").mapInArrow(
        lambda batches: chunks(batches, lambda flat: [book.value.packed(flat.astype(float))]), "block int, ids binary, vectors binary, codes binary"
    )
    query_blocks = -(-asked // min(QUERY_ROWS, fitting))
    part = F.pmod(spot, F.lit(query_blocks)).cast("int").alias("block")
    asking = vectors.where("asks").select(part, "id", "vector").mapInArrow(lambda batches: chunks(batches, lambda _: []), "block int, ids binary, vectors binary")
    left = asking.select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "ids", "vectors")
    right = indexed.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), F.col("block").alias("b"), "ids", "vectors", "codes")

    def meet(queries: pa.Table, block: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if queries.num_rows and block.num_rows:
            read = lambda side, name, kind: np.frombuffer(b"".join(side.column(name).to_pylist()), kind)
            query_ids, ids = (read(side, "ids", "<i8") for side in (queries, block))
            of_queries, of_block = (read(side, "vectors", width).reshape(n, -1) for side, n in ((queries, query_ids.size), (block, ids.size)))
            found = nearest(of_queries, query_ids, of_block, ids, read(block, "codes", np.uint8).reshape(ids.size, -1), book.value, k, rerank)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(meet, "query_id bigint, id bigint, score double")
    sorting = F.when(F.isnan("score"), F.lit(None)).otherwise(F.col("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(sorting.desc_nulls_last(), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, by inner product."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op5_ann": op5_ann}
