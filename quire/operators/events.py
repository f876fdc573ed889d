"""Append-only review logs: current state, pending events, transitions and admission."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.sizes import small

# Which action may follow which.
TRANSITIONS = {"accept": "propose", "reject": "propose", "approve": "propose", "revoke": "accept,approve", "supersede": "accept"}


def current(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key.

    An aggregation with partial sums, so a key with very many events is folded
    before the shuffle.
    """
    rest = [c for c in events.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return events.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def pending(events: DataFrame) -> DataFrame:
    """Proposals that no later event names as its prior one."""
    closed = events.where("prior_event_id is not null").select(F.col("prior_event_id").alias("event_id")).distinct()
    return events.where("action = 'propose'").join(closed, "event_id", "left_anti")


def violations(events: DataFrame) -> DataFrame:
    """(event_id, reason) of events that break the log's rules.

    Events have event_id, seq, key, action, prior_event_id, ts.
    """
    prior = events.select(F.col("event_id").alias("__id"), F.col("seq").alias("__seq"), F.col("key").alias("__key"), F.col("action").alias("__action"), F.col("ts").alias("__ts"))
    proposes = F.col("action") == "propose"
    unknown = ~proposes & ~F.col("action").isin(*TRANSITIONS)
    # what names no event before has nothing to meet; kept with the others, all of it would be one group
    alone = events.where("prior_event_id IS NULL").withColumn("reason", F.when(unknown, "unknown action").when(proposes, F.lit(None)).otherwise("no earlier event to follow"))
    named = events.where("prior_event_id IS NOT NULL")
    rows = named.join(prior, F.col("prior_event_id") == F.col("__id"), "left")
    allowed = F.create_map(*[F.lit(x) for pair in TRANSITIONS.items() for x in pair])
    follows = F.array_contains(F.split(F.try_element_at(allowed, F.col("action")), ","), F.col("__action"))
    reason = (
        F.when(unknown, "unknown action")
        .when(proposes, "a proposal follows nothing")
        .when(F.col("__id").isNull() | (F.col("__seq") >= F.col("seq")), "no earlier event to follow")
        .when(F.col("__key") != F.col("key"), "follows an event of another key")
        .when(~F.coalesce(follows, F.lit(False)), "transition is not allowed")
        .when(F.col("ts") < F.col("__ts"), "goes back in time")
    )
    first = F.row_number().over(Window.partitionBy("prior_event_id").orderBy("seq"))
    again = F.when(first > 1, "the event before is closed already")
    rows = rows.withColumn("reason", F.coalesce(reason, again))
    return rows.select("event_id", "reason").unionByName(alone.select("event_id", "reason")).where("reason IS NOT NULL")


# What may follow what in the reviews of quality and of continuations.
QUALITY = {"approve": "propose", "reject": "propose", "revoke": "approve"}
CONTINUATION = {"propose": "reject,revoke", "approve": "propose", "reject": "propose", "revoke": "approve"}
READABLE = "readable_reference"
STEPPED = ("procedure_step", "diagnostic_node", "diagnostic_edge")


def _follows(table: dict[str, str]):
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_contains(F.split(F.try_element_at(pairs, F.col("action")), ","), F.col("__action"))


def _reasons(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    said = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(text)) for text, broken in rules]))
    return rows.select("event_id", F.explode(said).alias("reason"))


def quality_violations(events: DataFrame, records: DataFrame) -> DataFrame:
    """(event_id, reason) of decisions on the quality of records that break the log's rules, every reason of each.

    Events have event_id, seq, record_id, sha, use, purpose, action,
    prior_event_id, ts, reviewer_kind, checks map<string,boolean> and bindings
    array<struct<record_id,sha>>, what the record depends on; records, all that
    were ever reviewed, have record_id, sha, type, complete and graph_complete.
    """
    key = ["record_id", "use", "purpose"]
    order = Window.partitionBy(*key).orderBy("seq")
    held = records.select(F.col("record_id").alias("__id"), F.col("sha").alias("__sha"), "type", "complete", "graph_complete").dropDuplicates(["__id", "__sha"])
    rows = events.select("*", *[F.lag(c).over(order).alias(f"__{c}") for c in ("event_id", "action", "ts", "bindings")], F.lag("sha").over(order).alias("__sha_before"))
    rows = rows.join(held, (F.col("record_id") == F.col("__id")) & (F.col("sha") == F.col("__sha")), "left")
    needs = events.select("event_id", F.explode("bindings").alias("b")).select("event_id", "b.*")
    met = needs.join(held, (F.col("record_id") == F.col("__id")) & (F.col("sha") == F.col("__sha")), "left")
    met = met.groupBy(F.col("event_id").alias("__of")).agg(F.max(F.col("__id").isNull()).alias("__lost"), F.max(~F.coalesce("complete", F.lit(False))).alias("__open"))
    rows = rows.join(met, F.col("event_id") == F.col("__of"), "left")
    proposes, approves = F.col("action") == "propose", F.col("action") == "approve"
    check = lambda name: F.coalesce(F.try_element_at("checks", F.lit(name)), F.lit(False))
    instructs = approves & (F.col("use") != READABLE)
    later = ~proposes & F.col("__event_id").isNotNull()
    rules = [
        ("unknown action", ~proposes & ~F.col("action").isin(*QUALITY)),
        ("record isn't kept", F.col("__id").isNull()),
        ("a dependency isn't kept", F.coalesce("__lost", F.lit(False))),
        ("a proposal follows nothing", proposes & F.col("prior_event_id").isNotNull()),
        ("doesn't follow the current decision", ~proposes & ~F.coalesce(F.col("prior_event_id") == F.col("__event_id"), F.lit(False))),
        ("transition is not allowed", later & ~F.coalesce(_follows(QUALITY), F.lit(False))),
        ("record or dependencies changed on the way", later & ~(F.col("sha").eqNullSafe(F.col("__sha_before")) & F.col("bindings").eqNullSafe(F.col("__bindings")))),
        ("goes back in time", later & (F.col("ts") < F.col("__ts"))),
        ("approval without a look at the original", approves & ~(check("original_compared") & check("source_resolves"))),
        ("instruction isn't complete and checked", instructs & ~(F.coalesce("complete", F.lit(False)) & F.forall(F.map_values("checks"), lambda c: F.coalesce(c, F.lit(False))))),
        ("depends on what isn't complete", instructs & F.coalesce("__open", F.lit(False))),
        ("its graph isn't complete", instructs & F.coalesce(F.col("type").isin(*STEPPED), F.lit(False)) & ~F.coalesce("graph_complete", F.lit(False))),
        ("production needs a human reviewer", approves & (F.col("purpose") == "production") & ~F.col("reviewer_kind").eqNullSafe(F.lit("human"))),
    ]
    again = events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id", F.lit("event is repeated").alias("reason"))
    return _reasons(rows, rules).unionByName(again)


def continuation_violations(events: DataFrame) -> DataFrame:
    """(event_id, reason) of reviews of continuations that break their rules, every reason of each.

    Events have event_id, seq (from 0, without gaps), parent_id, link_id, action,
    binding struct<source,target,reference,configuration_ids>, reviewer_kind, ts and
    checks map<string,boolean>. Each event names the one before it in the whole log.
    """
    before = events.select((F.col("seq") + 1).alias("__next"), F.col("event_id").alias("__before"))
    order = Window.partitionBy("link_id").orderBy("seq")
    rows = events.select("*", F.lag("action").over(order).alias("__action"), F.lag("binding").over(order).alias("__binding"))
    rows = rows.join(before, F.col("seq") == F.col("__next"), "left")
    own = F.concat(F.lit("link_"), F.substring(F.sha2(F.concat_ws("\0", "binding.source", "binding.target", "binding.reference", F.array_join(F.array_sort("binding.configuration_ids"), ",")), 256), 1, 32))
    ids = F.col("binding.configuration_ids")
    first = F.col("__action").isNull()
    rules = [
        ("chain is broken", ~F.col("parent_id").eqNullSafe(F.col("__before"))),
        ("link isn't that of its binding", F.col("link_id") != own),
        ("configurations are missing or repeated", (F.size(ids) < 1) | (F.size(F.array_distinct(ids)) < F.size(ids))),
        ("unknown reviewer", ~F.col("reviewer_kind").isin("human", "agent")),
        ("transition is not allowed", F.when(first, F.col("action") != "propose").otherwise(~F.coalesce(_follows(CONTINUATION), F.lit(False)))),
        ("binding changed during its review", ~first & (F.col("action") != "propose") & ~F.col("binding").eqNullSafe(F.col("__binding"))),
        ("approval without all checks", (F.col("action") == "approve") & ~F.forall(F.map_values("checks"), lambda c: F.coalesce(c, F.lit(False)))),
    ]
    return _reasons(rows, rules)


def link_id(source: str, target: str, reference: str, configuration_ids: list[str]) -> str:
    """The id of a continuation between two records, for these configurations."""
    said = "\0".join([source, target, reference, ",".join(sorted(configuration_ids))])
    return "link_" + hashlib.sha256(said.encode()).hexdigest()[:32]


def quality_state(records: DataFrame, events: DataFrame) -> DataFrame:
    """(record_id, use, state, approved): the last decision on each record and use, stale if the record changed."""
    last = current(events.select("record_id", "use", "seq", "action", "sha"), ["record_id", "use"], ["seq"])
    uses = last.select("use").distinct()
    rows = records.crossJoin(small(uses)).join(last.withColumnRenamed("sha", "__sha"), ["record_id", "use"], "left")
    state = F.when(F.col("action").isNull(), "unreviewed").when(F.col("__sha") != F.col("sha"), "stale").otherwise(F.col("action"))
    return rows.select("record_id", "use", state.alias("state"), (state == "approve").alias("approved"))


def admission(records: DataFrame, decisions: DataFrame, quality: DataFrame) -> DataFrame:
    """(record_id, admitted): a record needs a confirmed decision on its unit and an approved quality."""
    gate = decisions.where("state = 'confirmed'").select("unit_id").distinct()
    fine = quality.where("approved").select("record_id").distinct().withColumn("__fine", F.lit(True))
    rows = records.join(gate.withColumn("__gate", F.lit(True)), "unit_id", "left").join(fine, "record_id", "left")
    return rows.select("record_id", (F.col("__gate").isNotNull() & F.col("__fine").isNotNull()).alias("admitted"))


# ---------------------------------------------------------------- queries


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark, sf_dir):
    """Events as a review log: users are keys, every action follows the user's event before."""
    events = load(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    number = F.row_number().over(order)
    action = F.element_at(F.array(*[F.lit(a) for a in ("propose", "accept", "revoke", "propose", "reject")]), ((number - 1) % 5 + 1).cast("int"))
    prior = F.when(((number - 1) % 5).isin(1, 2, 4), F.when(F.col("event_id") % 23 == 0, F.lag("event_id", 2).over(order)).otherwise(F.lag("event_id").over(order)))
    return events.select("event_id", F.col("event_id").alias("seq"), F.col("user_id").alias("key"), action.alias("action"), prior.alias("prior_event_id"), "ts")


def q_current_event(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return current(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def q_pending_events(spark, sf_dir):
    return pending(_log(spark, sf_dir)).select("event_id", "key")


def q_log_violations(spark, sf_dir):
    return violations(_log(spark, sf_dir))


def q_quality_state(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    log = events.select(
        (F.col("user_id") % 100).alias("record_id"), F.col("event_type").alias("use"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, "approve").otherwise("reject").alias("action"), (F.col("event_id") % 3).cast("string").alias("sha"),
    )
    records = spark.range(120).select(F.col("id").alias("record_id"), (F.col("id") % 3).cast("string").alias("sha"))
    return quality_state(records, log)


def q_admission(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    records = docs.select(F.col("doc_id").alias("record_id"), F.col("source").alias("unit_id"))
    decisions = docs.select(F.col("source").alias("unit_id"), F.when(F.col("source").isin("src1", "src2", "src3"), "confirmed").otherwise("excluded").alias("state"))
    quality = docs.select(F.col("doc_id").alias("record_id"), (F.col("doc_id") % 2 == 0).alias("approved"))
    return admission(records, decisions, quality)


QUERIES = {
    "current_event": q_current_event,
    "pending_events": q_pending_events,
    "log_violations": q_log_violations,
    "quality_state": q_quality_state,
    "diagnostic_admission": q_admission,
}

_LOG = """WITH n AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS l1, lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS l2 FROM events),
  g AS (SELECT event_id, event_id AS seq, user_id AS key, ts, ['propose', 'accept', 'revoke', 'propose', 'reject'][k % 5 + 1] AS action,
    CASE WHEN k % 5 IN (1, 2, 4) THEN CASE WHEN event_id % 23 = 0 THEN l2 ELSE l1 END END AS prior FROM n)"""

ORACLE_SQL = {
    "current_event": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "pending_events": _LOG + " SELECT event_id, key FROM g WHERE action = 'propose' AND event_id NOT IN (SELECT prior FROM g WHERE prior IS NOT NULL)",
    "log_violations": _LOG
    + """, j AS (SELECT g.*, p.event_id AS pid, p.action AS paction, p.ts AS pts, row_number() OVER (PARTITION BY g.prior ORDER BY g.seq) AS nth FROM g LEFT JOIN g p ON g.prior = p.event_id),
      r AS (SELECT event_id, CASE WHEN action = 'propose' THEN NULL WHEN pid IS NULL THEN 'no earlier event to follow'
        WHEN NOT ((action IN ('accept', 'reject') AND paction = 'propose') OR (action = 'revoke' AND paction = 'accept')) THEN 'transition is not allowed'
        WHEN ts < pts THEN 'goes back in time' WHEN nth > 1 THEN 'the event before is closed already' END AS reason FROM j)
      SELECT event_id, reason FROM r WHERE reason IS NOT NULL""",
    "quality_state": """WITH l AS (SELECT user_id % 100 AS record_id, event_type AS use, CASE WHEN event_id % 2 = 0 THEN 'approve' ELSE 'reject' END AS action, event_id % 3 AS sha,
        row_number() OVER (PARTITION BY user_id % 100, event_type ORDER BY event_id DESC) AS k FROM events),
      r AS (SELECT range AS record_id, range % 3 AS sha, use FROM range(120), (SELECT DISTINCT event_type AS use FROM events)),
      s AS (SELECT r.record_id, r.use, CASE WHEN action IS NULL THEN 'unreviewed' WHEN l.sha <> r.sha THEN 'stale' ELSE action END AS state FROM r LEFT JOIN l ON l.record_id = r.record_id AND l.use = r.use AND k = 1)
      SELECT record_id, use, state, state = 'approve' AS approved FROM s""",
    "diagnostic_admission": "SELECT doc_id AS record_id, source IN ('src1', 'src2', 'src3') AND doc_id % 2 = 0 AS admitted FROM documents",
}
