"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

Texts are TF-IDF vectors of hashed character n-grams (case kept), beside terms
for the text's shape (how many words repeat the one or two before, how many are
upper case, how many have no letter), projected to ``LATENT`` dimensions by a
truncated singular-value decomposition. The labelled vectors, ``SAMPLE_PER_LABEL``
for each label at most and so of a bounded size, are broadcast. Every document's
cosine with every one of them is computed exactly, in blocks, and the nearest
ones vote, each with its similarity (its cosine, or 0 below that) as weight.

How many neighbours vote is chosen while learning, from ``NEIGHBOURS``: the number
whose scores have the least log loss on the sample's own rows, each left out once
and both labels counting the same. No other label is ever looked at.

Defined results: null and empty texts have no feature; they get the share of
label 1 among the labelled rows (0.5 with none), as do texts that resemble no
labelled one; rows with a null label or id are not learnt from; repeated label
rows count once; of documents that repeat an id the first text is learnt from;
labels without a document are ignored, they are neither counted nor sampled; an
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq, methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out, table, word_windows
from quire.llm.features import bounded_sample, document_frequencies, inverse_frequencies, sample_vectors, weighted

ORDERS, BITS = (1, 2, 3), 13
#: Bound of the labelled sample: about so many rows of each label.
SAMPLE_PER_LABEL = 1500
LATENT, OVERSAMPLE, POWER_STEPS = 64, 16, 2
#: Numbers of neighbours to choose from, the first of those that do equally well.
NEIGHBOURS = (3, 5, 9, 25)
THRESHOLD = 0.3
#: Cosines that differ by no more are the same.
TIE = 1e-5
#: Length of the shape terms against the n-gram terms, and where their steps lie.
SHAPE_WEIGHT = 1.0
SHAPE_STEPS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
SHAPES = 3
TERMS = (1 << BITS) + SHAPES * len(SHAPE_STEPS)
_TRIM = methodcaller("strip", ".,;:!?\"'()-")
#: Documents scored at once.
BLOCK_ROWS = 512


def truncated_svd(matrix: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """Right singular vectors (columns x rank) by a randomised range finder."""
    rank = max(1, min(rank, *matrix.shape))
    width = min(rank + OVERSAMPLE, min(matrix.shape))
    found = matrix @ np.random.default_rng(seed).standard_normal((matrix.shape[1], width), np.float32)
    for _ in range(POWER_STEPS):
        found = matrix @ (matrix.T @ np.linalg.qr(found)[0])
    base = np.linalg.qr(found)[0]
    return np.linalg.svd(base.T @ matrix, full_matrices=False)[2][:rank].T.astype(np.float32)


def shape_terms(text: str) -> np.ndarray:
    """Numbers of the shape terms that a text has, one for each measure."""
    repeats = upper = bare = total = 0
    for words in word_windows(text, 1):
        total += len(words)
        repeats += sum(map(eq, words, words[1:])) + sum(map(eq, words, words[2:]))
        upper += sum(map(str.isupper, words))
        bare += len(words) - sum(map(str.isalpha, map(_TRIM, words)))
    shares = np.array([repeats, upper, bare]) / max(1, total)
    return (1 << BITS) + np.arange(SHAPES) * len(SHAPE_STEPS) + np.searchsorted(SHAPE_STEPS, shares, side="right") - 1


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of unit length over n-gram and shape terms; empty for an empty text."""
    where, values = weighted(text, ORDERS, BITS, False, idf)
    if not where.size:
        return where, values
    shape = shape_terms(text)
    values = np.concatenate([values, np.full(SHAPES, SHAPE_WEIGHT / SHAPES**0.5, np.float32)])
    return np.concatenate([where, shape]), values / np.float32((1 + SHAPE_WEIGHT**2) ** 0.5)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


@dataclass
class NeighbourModel:
    idf: np.ndarray
    basis: np.ndarray  # features x latent
    vectors: np.ndarray  # labelled x latent, unit length
    labels: np.ndarray
    prior: float
    neighbours: int

    def latent(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        for row, text in enumerate(texts):
            where, values = vector(text, self.idf)
            if where.size:
                out[row] = values @ self.basis[where]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled rows, 0 to 1."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        vectors = self.latent(texts)
        filled = np.flatnonzero(np.abs(vectors).sum(axis=1) > 0)
        if not filled.size:
            return out
        out[filled] = votes(_unit(vectors[filled]) @ self.vectors.T, self.labels, self.neighbours, self.prior)
        return out


def votes(cosines: np.ndarray, labels: np.ndarray, count: int, prior: float) -> np.ndarray:
    """Share of label 1 among the nearest ``count`` of each row, weighted by similarity; those that tie for the last places share them."""
    count, (rows, width) = min(count, len(labels)), cosines.shape
    edge = np.partition(cosines, width - count, axis=1)[:, width - count]
    row, column = np.nonzero(cosines >= edge[:, None] - TIE)
    found = cosines[row, column]
    tied = found <= edge[row] + TIE
    sure, tie = np.bincount(row, ~tied, rows), np.bincount(row, tied, rows)
    weights = np.maximum(found, 0.0) * np.where(tied, ((count - sure) / np.maximum(tie, 1))[row], 1.0)
    total, ones = np.bincount(row, weights, rows), np.bincount(row, weights * labels[column], rows)
    return np.where(total > 0, np.clip(ones / np.where(total > 0, total, 1.0), 0.0, 1.0), prior)


def choose_neighbours(vectors: np.ndarray, labels: np.ndarray, prior: float) -> int:
    """The number of neighbours whose scores lose least on the rows themselves, each left out once."""
    if len(labels) < 2:
        return NEIGHBOURS[0]
    scores = {count: [] for count in NEIGHBOURS}
    for begin in range(0, len(labels), BLOCK_ROWS):
        cosines = vectors[begin : begin + BLOCK_ROWS] @ vectors.T
        rows = np.arange(len(cosines))
        cosines[rows, begin + rows] = -1.0  # nobody votes on itself
        for count in NEIGHBOURS:
            scores[count].append(votes(cosines, labels, min(count, len(labels) - 1), prior))

    def loss(count: int) -> float:
        score = np.concatenate(scores[count])
        lost = -np.log(np.maximum(np.where(labels == 1, score, 1 - score), 0.01))
        return float(np.mean([lost[labels == k].mean() for k in np.unique(labels)]))

    return min(NEIGHBOURS, key=loss)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> NeighbourModel:
    """Learn from the labels of these documents."""
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label")).where("id is not null and label in (0, 1)").distinct()
    # only labels that have a document count, so the sample is drawn from these
    known = known.join(texts.select("id"), "id", "left_semi")
    counts, total = document_frequencies(texts, ORDERS, BITS, False)
    idf = inverse_frequencies(counts, total)
    shares = {r[0]: r[1] for r in known.groupBy("label").agg(F.count("*")).collect()}
    chosen = F.broadcast(bounded_sample(known, "label", SAMPLE_PER_LABEL, 2 * SAMPLE_PER_LABEL, "id"))  # bounded by SAMPLE_PER_LABEL
    # an id that very many rows repeat doesn't break the sample's bound
    found = texts.join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    sample = [row for row in sample_vectors(found, lambda text: vector(text, idf)) if row[2].size]
    prior = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    if not sample:
        return NeighbourModel(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior, NEIGHBOURS[0])
    matrix = np.zeros((len(sample), TERMS), np.float32)
    for row, (_, _, where, values) in enumerate(sample):
        matrix[row, where] = values
    basis = truncated_svd(matrix, LATENT)
    marks = np.array([row[1] for row in sample], np.float64)
    vectors = _unit(matrix @ basis)
    return NeighbourModel(idf, basis, vectors, marks, prior, choose_neighbours(vectors, marks, prior))


def score(docs: DataFrame, model: NeighbourModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row, in one pass without a shuffle."""
    kind = docs.schema[id_column].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(begin, BLOCK_ROWS)
                found = given.value.score([text.as_py() or "" for text in block.column(1)])
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, score double"
    ).withColumnRenamed("id", id_column)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    model = fit(docs.where(~held_out("doc_id")), labels)
    return score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op3_quality": op3_quality}
