"""Reliable checkpoints for iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder in the one that ``spark.checkpoint.dir`` names.

    Where the session names none and runs on one machine, as in tests, a temporary
    folder is made; on a cluster that is an error, since executors share no such folder.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
