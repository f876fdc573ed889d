"""Review logs as keyed state: what is current, what is pending and what is stale, while events arrive.

A log of any kind (units, quality of records, continuations) is a stream of events
with a key. Of a key are kept its last event, its proposals that no event has
closed, and the events that closed a proposal which hasn't come yet. So events may
come in any order, late or twice, and after the last of them the state is that of
the whole log, however it was cut (``states_of`` gives it from a table).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

EVENT = ("event_id", "seq", "key", "action", "prior_event_id", "evidence_revision")
STATE = "key string, seq long, event_id string, action string, stale boolean, pending array<string>, stale_pending array<string>"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ReviewState(StatefulProcessor):
    """The state of one key; ``revision`` is the evidence's that is current, other events are stale."""

    def __init__(self, revision: str | None):
        self.revision = revision

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seq long, event_id string, action string, evidence_revision string")
        self.open = handle.getMapState("open", "event_id string", "evidence_revision string")
        self.closed = handle.getMapState("closed", "event_id string", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = tuple(self.last.get()) if self.last.exists() else None
        for row in rows:
            if last is None or (row["seq"], row["event_id"]) > last[:2]:
                last = (row["seq"], row["event_id"], row["action"], row["evidence_revision"])
            if row["prior_event_id"] is not None:
                self.closed.updateValue((row["prior_event_id"],), (row["seq"],))
                if self.open.containsKey((row["prior_event_id"],)):
                    self.open.removeKey((row["prior_event_id"],))
            if row["action"] == "propose" and not self.closed.containsKey((row["event_id"],)):
                self.open.updateValue((row["event_id"],), (row["evidence_revision"],))
        self.last.update(last)
        pending = sorted((k[0], v[0]) for k, v in self.open.iterator())
        yield Row(
            key=key[0], seq=last[0], event_id=last[1], action=last[2], stale=last[3] != self.revision,
            pending=[name for name, _ in pending], stale_pending=[name for name, made in pending if made != self.revision],
        )

    def close(self) -> None:
        pass


def states(events: DataFrame, revision: str | None) -> DataFrame:
    """The state of each key whose events came in a batch of the stream."""
    rows = events.select(*EVENT)
    return rows.groupBy("key").transformWithState(statefulProcessor=ReviewState(revision), outputStructType=STATE, outputMode="Update", timeMode="None")


def states_of(log: DataFrame, revision: str | None) -> DataFrame:
    """The same from a whole log as a table, by aggregates and an anti join."""
    last = log.groupBy("key").agg(F.max(F.struct("seq", "event_id", "action", "evidence_revision")).alias("last"))
    closed = log.where("prior_event_id IS NOT NULL").select("key", F.col("prior_event_id").alias("event_id")).distinct()
    open_ = log.where("action = 'propose'").join(closed, ["key", "event_id"], "left_anti").select("key", "event_id", "evidence_revision").distinct()
    stale = ~F.col("evidence_revision").eqNullSafe(F.lit(revision))
    named = lambda rule: F.array_sort(F.collect_set(F.when(rule, F.col("event_id"))))
    pending = open_.groupBy("key").agg(named(F.lit(True)).alias("pending"), named(stale).alias("stale_pending"))
    none = F.array().cast("array<string>")
    return last.join(pending, "key", "left").select(
        "key",
        "last.seq",
        "last.event_id",
        "last.action",
        (~F.col("last.evidence_revision").eqNullSafe(F.lit(revision))).alias("stale"),
        F.coalesce("pending", none).alias("pending"),
        F.coalesce("stale_pending", none).alias("stale_pending"),
    )


def follow(events: DataFrame, revision: str | None, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the states of a stream of events as versions below ``path``; a batch that runs again overwrites its own.

    The state store is set to the one that such state needs, for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states(events, revision).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The state of every key as its last batch left it."""
    rows = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in ("key", "batch")]
    return rows.groupBy("key").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("key", "s.*")


# ---------------------------------------------------------------- queries


def review_log(spark, sf_dir: str) -> DataFrame:
    """Events of users as a review log: a kind of event a key, every third proposes, others close the one before or go on."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = lambda at: F.concat(F.lit("e"), at.cast("string"))
    at = F.col("event_id")
    action = F.element_at(F.array(F.lit("propose"), F.lit("accept"), F.lit("note")), (at % 3 + 1).cast("int"))
    prior = F.when((at % 3 == 1) & (at % 4 != 0), name(at - 1))
    return events.select(
        name(at).alias("event_id"), at.cast("long").alias("seq"), F.concat(F.lit("k"), (F.floor(at / 3) % 997).cast("string")).alias("key"),
        action.alias("action"), prior.alias("prior_event_id"), F.when(at % 5 > 0, "r1").otherwise("r0").alias("evidence_revision"),
    )


def q_review_states(spark, sf_dir):
    rows = states_of(review_log(spark, sf_dir), "r1")
    return rows.select("key", "seq", "event_id", "action", "stale", F.size("pending").cast("long").alias("pending"), F.size("stale_pending").cast("long").alias("stale_pending"))


QUERIES = {"review_states": q_review_states}

ORACLE_SQL = {
    "review_states": """WITH l AS (SELECT event_id AS no, 'k' || ((event_id // 3) % 997) AS key FROM events),
      o AS (SELECT p.key, p.no, p.no % 5 = 0 AS stale FROM l p WHERE p.no % 3 = 0 AND NOT EXISTS (SELECT 1 FROM l c WHERE c.no = p.no + 1 AND c.key = p.key AND c.no % 4 <> 0)),
      n AS (SELECT key, count(*) AS pending, count(*) FILTER (stale) AS stale_pending FROM o GROUP BY 1),
      m AS (SELECT key, max(no) AS no FROM l GROUP BY 1)
      SELECT m.key, no AS seq, 'e' || no AS event_id, ['propose', 'accept', 'note'][no % 3 + 1] AS action, no % 5 = 0 AS stale, coalesce(pending, 0) AS pending, coalesce(stale_pending, 0) AS stale_pending
      FROM m LEFT JOIN n USING (key)""",
}
