"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams. Document frequencies
come from all rows that may be learnt from; weights are learnt with
follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) on a
bounded sample of them, ``SAMPLE_PER_LANGUAGE`` rows of each language and
``SAMPLE_ROWS`` in all; the temperature that scales the scores is then fitted on
rows of the sample that the training left out. Weights are kept sparse, so the
model that is broadcast grows with the weights that the L1 penalty leaves; with
more than ``CELLS`` >> BITS languages n-grams share fewer features.

Defined results: a text that is null or has no letter is ``und`` with score 0;
languages are those seen in the sample, which holds every one unless there are
more than ``SAMPLE_ROWS``; with none, every row is ``und``; rows that repeat an
id, a language and a text are learnt from once and scored each; null ids are
learnt from like others; texts are read whole; an empty table gives an empty
table. Other columns are ignored (``predict``) or kept (``keep_identified``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out, slices, table
from quire.llm.features import bounded_sample, document_frequencies, inverse_frequencies, sample_vectors, weighted

ORDERS, BITS = (1, 2, 3), 16
#: Bounds of the training sample: about so many rows of each language, and of all.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 1500, 8000
#: Bound of the learner's state: features times languages.
CELLS = 1 << 24
#: Every so-many-th row of the sample fits the temperature.
CALIBRATE_EVERY = 5
EPOCHS = 3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic regression."""

    features: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z = np.zeros((self.features, self.classes))
        self.n = np.zeros((self.features, self.classes))

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        pull = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) > self.l1, pull / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, where: np.ndarray, values: np.ndarray, label: int) -> None:
        z, n = self.z[where], self.n[where]
        weights = self._weights(z, n)
        error = softmax(values @ weights)
        error[label] -= 1.0
        gradient = values[:, None] * error
        grown = n + gradient * gradient
        self.z[where] = z + gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * weights
        self.n[where] = grown

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n)


def softmax(values: np.ndarray) -> np.ndarray:
    raised = np.exp(values - values.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section.

    Targets are smoothed by one pseudo-row of each class, so that scores which
    separate the sample fully don't drive the temperature to zero.
    """
    if not len(labels):
        return 1.0
    classes = scores.shape[1]
    targets = np.full(scores.shape, 1.0 / (len(labels) + classes))
    targets[np.arange(len(labels)), labels] = 1.0 - (classes - 1.0) / (len(labels) + classes)

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return float(-(targets * np.log(np.maximum(p, 1e-12))).sum(axis=1).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Sparse:
    """The weights other than zero, feature by feature."""

    def __init__(self, dense: np.ndarray):
        rows, self.columns = np.nonzero(dense)
        self.values, self.classes = dense[rows, self.columns], dense.shape[1]
        self.starts = np.searchsorted(rows, np.arange(len(dense) + 1))

    def scores(self, where: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sum over a text's features, for each class."""
        begin, sizes = self.starts[where], self.starts[where + 1] - self.starts[where]
        ends = np.cumsum(sizes)
        spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)
        return np.bincount(self.columns[spots], np.repeat(values, sizes) * self.values[spots], self.classes)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: Sparse
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        bits = len(self.idf).bit_length() - 1
        where, values = weighted(text, ORDERS, bits, True, self.idf)
        return softmax(self.weights.scores(where, values) / self.temperature)


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """Learn from the rows that have a text and a language."""
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(lang_column).alias("label"), F.col(text_column).alias("text")
    ).where(F.col("label").isNotNull() & F.col("text").isNotNull())
    chosen = bounded_sample(rows, "label", SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, "id", "text")
    # rows that repeat are one, however many there are
    chosen = chosen.groupBy("id", "label", F.xxhash64("text")).agg(F.min("text").alias("text"))
    labels = min(SAMPLE_ROWS, max(1, rows.select("label").distinct().count()))
    bits = min(BITS, (CELLS // labels).bit_length() - 1)
    counts, total = document_frequencies(rows, ORDERS, bits, True)
    idf = inverse_frequencies(counts, total)
    sample = sample_vectors(chosen, lambda text: weighted(text, ORDERS, bits, True, idf))
    languages = sorted({label for _, label, _, _ in sample})
    number = {label: k for k, label in enumerate(languages)}
    order = np.random.default_rng(11).permutation(len(sample))
    learner = Ftrl(1 << bits, max(1, len(languages)))
    kept = [i for i in order if i % CALIBRATE_EVERY]
    rest = [i for i in order if not i % CALIBRATE_EVERY]
    for _ in range(EPOCHS):
        for i in kept:
            _, label, where, values = sample[i]
            learner.learn(where, values, number[label])
    weights = Sparse(learner.weights().astype(np.float32))
    scores = np.array([weights.scores(sample[i][2], sample[i][3]) for i in rest]).reshape(len(rest), max(1, len(languages)))
    return LanguageModel(languages, idf, weights, fit_temperature(scores, np.array([number[sample[i][1]] for i in rest], int)))


def _predictor(spark, model: LanguageModel):
    given = spark.sparkContext.broadcast(model)

    def predict_all(texts) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for value in texts:
            text = value.as_py()
            if not text or not given.value.languages or not _LETTER.search(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = given.value.probabilities(text)
            best = int(p.argmax())
            names.append(given.value.languages[best])
            scores.append(float(p[best]))
        return names, scores

    return predict_all


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, in one pass without a shuffle."""
    kind = docs.schema[id_column].dataType.simpleString()
    predict_all = _predictor(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict_all(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"]
            )

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double"
    ).withColumnRenamed("id", id_column)


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float, text_column: str = "text") -> DataFrame:
    """The rows, all columns kept, whose language is known with at least this score."""
    at = docs.columns.index(text_column)
    predict_all = _predictor(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, at)):
            names, scores = predict_all(batch.column(at))
            keep = pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def op1_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id")))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_langid": op1_langid}
