"""Review logs as streams: the current state of every key, kept while events arrive.

The engine's logs are batch tables; this is an addition for logs that arrive
continuously. State is one row a key, folded by event time and sequence, so late
and repeated events change nothing that is newer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def current_states(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key of a stream, as an update-mode aggregation."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def windowed_counts(events: DataFrame, time: str, length: str, late: str, column: str) -> DataFrame:
    """Events a window and value, with a watermark for late ones."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), column).agg(F.count("*").alias("n"))


def keep(states: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Write each batch's changed states as a version of a Parquet table; a batch that runs again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()
