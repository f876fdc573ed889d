"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that the next stage
takes as its docs; all but the last keep the columns of ``documents``. ``run``
applies them in order to ``documents``, with a reliable checkpoint between stages
where a caller of single stages may write Parquet.

1. language_id: documents whose language isn't recognised go
2. near_dedup: of each group of near-duplicates the document with the smallest id stays
3. secrets: secret spans are replaced by a mark, n_chars follows
4. mixing: smaller sources are repeated up to twice
5. packing: pieces of documents in sequences of 1024 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, mixing, packing, secrets, simhash
from quire.llm.common import held_out, reliable, table

#: Calibrated score under which a document counts as of no known language.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known with ``LEAST_SCORE`` at least stay, repeated rows each.

    A null or empty text, or one without letters, has no language and goes; rows with
    a null id or language are kept by their text like any other. Without a row to
    learn from nothing is known, so nothing stays.
    """
    model = langid.fit(docs.where(~held_out("doc_id")))
    return langid.keep_identified(docs, model, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the rows of the smallest id stay.

    Null and empty texts are one group; rows that repeat a kept id and text stay;
    of a null id see ``simhash.keep_one``. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become a mark and ``n_chars``, where there is such a column, the new length; no row goes.

    A null text stays null, and so does its n_chars.
    """
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once, those of smaller sources up to twice; a null source is the empty one."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences; a null text is empty and has the id 0 alone."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secrets", secret_scan),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The first stage learns a model, which SQL cannot express; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result a checkpoint in the shared folder but the last."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = reliable(docs)
    return docs
