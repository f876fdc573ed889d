"""Writing review logs: appends that are checked against the log as it stands.

A log is a folder of numbered commits, each naming the Parquet folder of its
events. An append writes its events first and then creates the next commit, which
only one writer can do: the others find that the log has moved, and what they
wrote is never read. Events are never rewritten.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import canonical_digest
from quire.operators.events import violations
from quire.plans.store import files_of, read_text

SCHEMA = "event_id string, seq bigint, key string, action string, prior_event_id string, ts timestamp, reviewer string, reason string, relation string, targets array<string>, bindings array<string>, evidence_revision string"


class Moved(RuntimeError):
    """The log isn't at the revision that the append was made against."""


def _commits(spark: SparkSession, path: str) -> list[str]:
    """The folders of a log's appends, in order; one a commit, as few as reviewers made."""
    system, place = files_of(spark, f"{path}/commits")
    names = sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []
    return [read_text(spark, f"{path}/commits/{name}") for name in names if name.isdigit()]


def read(spark: SparkSession, path: str) -> DataFrame:
    """All events of a log, those of every commit and of nothing else."""
    held = _commits(spark, path)
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/events/{name}" for name in held]) if held else spark.createDataFrame([], SCHEMA)


def revision(log: DataFrame) -> str:
    """A digest of a log that doesn't depend on the order of its rows."""
    sums = log.agg(F.count("*").alias("n"), F.sum(F.xxhash64("event_id", "seq").cast("decimal(38,0)")).alias("s")).first()
    return canonical_digest([sums["n"], str(sums["s"])])


def event(key: str, action: str, ts, reviewer: str, reason: str, prior: str | None = None, **more) -> dict:
    """An event with an id made from what it says."""
    said = {"key": key, "action": action, "ts": ts.isoformat(), "reviewer": reviewer, "reason": reason, "prior_event_id": prior, **more}
    if not reviewer.strip() or not reason.strip():
        raise ValueError("an event has a reviewer and a reason")
    return {**said, "ts": ts, "event_id": "rev_" + canonical_digest(said)[:32]}


def append(spark: SparkSession, path: str, events: list[dict], expected: str) -> str:
    """Add events (as ``event`` makes them) after those of the log; gives the new revision."""
    number = len(_commits(spark, path)) + 1
    log = read(spark, path)
    if revision(log) != expected:
        raise Moved("log has changed since it was read")
    at = log.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    rows = [{**dict.fromkeys(names), **one, "seq": at + 1 + k} for k, one in enumerate(events)]
    added = spark.createDataFrame([tuple(row[n] for n in names) for row in rows], SCHEMA)
    both = log.unionByName(added)
    # only what follows the new events has to be looked at, but a prior event may be any old one
    wrong = violations(both.select("event_id", "seq", "key", "action", "prior_event_id", "ts")).join(added.select("event_id"), "event_id", "left_semi")
    if found := wrong.limit(5).collect():
        raise ValueError("; ".join(f"{r['event_id']}: {r['reason']}" for r in found))
    if both.groupBy("event_id").count().where("count > 1").limit(1).collect():
        raise ValueError("an event is already in the log")
    name = uuid.uuid4().hex
    added.coalesce(1).write.parquet(f"{path}/events/{name}")
    commit(spark, path, number, name)
    return revision(both)


def commit(spark: SparkSession, path: str, number: int, name: str) -> None:
    """Make an append the log's next one; an error if another was first."""
    system, place = files_of(spark, f"{path}/commits/{number:012d}")
    try:
        out = system.create(place, False)  # fails where the file exists
    except Py4JJavaError as stopped:
        system.delete(files_of(spark, f"{path}/events/{name}")[1], True)
        raise Moved("another append was first") from stopped
    out.write(bytearray(name.encode()))
    out.close()


def stale(log: DataFrame, current_revision: str) -> DataFrame:
    """The log with whether each event was made against other evidence than the current."""
    return log.withColumn("stale", ~F.col("evidence_revision").eqNullSafe(F.lit(current_revision)))


def rebase(log: DataFrame, kept: DataFrame, current_revision: str) -> DataFrame:
    """Stale proposals whose bindings are all among the kept assertions, made against the current evidence."""
    open_ = stale(log, current_revision).where("stale and action = 'propose'")
    bound = open_.select("event_id", F.explode("bindings").alias("assertion_id"))
    lost = bound.join(kept.select("assertion_id").distinct(), "assertion_id", "left_anti").select("event_id").distinct()
    return open_.join(lost, "event_id", "left_anti").drop("stale").withColumn("evidence_revision", F.lit(current_revision))
