"""Rules of the logs of quality and of continuations: one case for each reason."""

import datetime as dt

import pytest

from quire.operators import events as E

DAY = dt.datetime(2024, 1, 1)
QUALITY = (
    "event_id string, seq long, record_id string, sha string, use string, purpose string, action string, prior_event_id string, ts timestamp, "
    "reviewer_kind string, checks map<string,boolean>, bindings array<struct<record_id:string,sha:string>>"
)
RECORDS = "record_id string, sha string, type string, complete boolean, graph_complete boolean"
FINE = {"original_compared": True, "source_resolves": True, "context": True}


def quality(seq, action, prior=None, record="r", sha="1", use="instruction", purpose="trial", day=None, kind="agent", checks=FINE, bindings=()):
    return (f"e{seq}", seq, record, sha, use, purpose, action, prior, DAY + dt.timedelta(seq if day is None else day), kind, checks, list(bindings))


def reasons(spark, rows, records=(("r", "1", "specification", True, None), ("d", "1", "region", True, None))):
    got = E.quality_violations(spark.createDataFrame(rows, QUALITY), spark.createDataFrame(list(records), RECORDS)).collect()
    return {(r["event_id"], r["reason"]) for r in got}


@pytest.mark.parametrize(("rows", "expected"), [
    ([quality(1, "propose"), quality(2, "approve", "e1"), quality(3, "revoke", "e2"), quality(4, "propose")], set()),
    ([quality(1, "propose"), quality(2, "reject", "e1")], set()),
    ([quality(1, "propose", "e0")], {("e1", "a proposal follows nothing")}),
    ([quality(1, "approve")], {("e1", "doesn't follow the current decision")}),
    ([quality(1, "propose"), quality(2, "reject", "e1"), quality(3, "approve", "e1")], {("e3", "doesn't follow the current decision"), ("e3", "transition is not allowed")}),
    ([quality(1, "propose"), quality(2, "revoke", "e1")], {("e2", "transition is not allowed")}),
    ([quality(1, "propose"), quality(2, "drop", "e1")], {("e2", "unknown action"), ("e2", "transition is not allowed")}),
    ([quality(1, "propose", sha="9")], {("e1", "record isn't kept")}),
    ([quality(1, "propose", bindings=[("d", "2")])], {("e1", "a dependency isn't kept")}),
    ([quality(1, "propose", bindings=[("d", "1")]), quality(2, "approve", "e1")], {("e2", "record or dependencies changed on the way")}),
    ([quality(1, "propose"), quality(2, "approve", "e1", day=0)], {("e2", "goes back in time")}),
    ([quality(1, "propose", use=E.READABLE), quality(2, "approve", "e1", use=E.READABLE, checks={"original_compared": True})], {("e2", "approval without a look at the original")}),
    ([quality(1, "propose", use=E.READABLE), quality(2, "approve", "e1", use=E.READABLE, checks={**FINE, "context": False})], set()),
    ([quality(1, "propose"), quality(2, "approve", "e1", checks={**FINE, "context": False})], {("e2", "instruction isn't complete and checked")}),
    ([quality(1, "propose", purpose="production"), quality(2, "approve", "e1", purpose="production")], {("e2", "production needs a human reviewer")}),
    ([quality(1, "propose", purpose="production"), quality(2, "approve", "e1", purpose="production", kind="human")], set()),
    ([quality(1, "propose"), quality(1, "propose")], {("e1", "event is repeated")}),
])
def test_quality(spark, rows, expected):
    assert reasons(spark, rows) == expected


def test_quality_of_open_records(spark):
    rows = [quality(1, "propose", bindings=[("d", "1")]), quality(2, "approve", "e1", bindings=[("d", "1")])]
    records = [("r", "1", "procedure_step", False, False), ("d", "1", "region", False, None)]
    assert reasons(spark, rows, records) == {("e2", "instruction isn't complete and checked"), ("e2", "depends on what isn't complete"), ("e2", "its graph isn't complete")}


def continuation(seq, action, parent="same", link=None, configurations=("c1",), checks=FINE, kind="agent", reference="go to 5"):
    link = link or E.link_id("s", "t", reference, list(configurations))
    return (f"e{seq}", seq, (f"e{seq - 1}" if seq else None) if parent == "same" else parent, link, action, ("s", "t", reference, list(configurations)), kind, DAY, checks)


CONTINUATION = (
    "event_id string, seq long, parent_id string, link_id string, action string, binding struct<source:string,target:string,reference:string,configuration_ids:array<string>>, "
    "reviewer_kind string, ts timestamp, checks map<string,boolean>"
)


@pytest.mark.parametrize(("rows", "expected"), [
    ([continuation(0, "propose"), continuation(1, "approve"), continuation(2, "revoke"), continuation(3, "propose"), continuation(4, "reject"), continuation(5, "propose")], set()),
    ([continuation(0, "approve")], {("e0", "transition is not allowed")}),
    ([continuation(0, "propose"), continuation(1, "approve", parent="e9")], {("e1", "chain is broken")}),
    ([continuation(0, "propose", parent="e9")], {("e0", "chain is broken")}),
    ([continuation(0, "propose"), continuation(1, "propose")], {("e1", "transition is not allowed")}),
    ([continuation(0, "propose"), continuation(1, "approve", checks={"a": True, "b": False})], {("e1", "approval without all checks")}),
    ([continuation(0, "propose", link="link_x")], {("e0", "link isn't that of its binding")}),
    ([continuation(0, "propose", configurations=())], {("e0", "configurations are missing or repeated")}),
    ([continuation(0, "propose", configurations=("c", "c"))], {("e0", "configurations are missing or repeated")}),
    ([continuation(0, "propose", kind="robot")], {("e0", "unknown reviewer")}),
])
def test_continuations(spark, rows, expected):
    got = E.continuation_violations(spark.createDataFrame(rows, CONTINUATION)).collect()
    assert {(r["event_id"], r["reason"]) for r in got} == expected


def test_events_that_follow_nothing_are_no_group(spark):
    """Of a log of proposals none is dealt to one task by its missing prior event; reasons are those of the rules."""
    rows = [(k, k, 1, "propose", None, DAY) for k in range(10)]
    rows += [(20, 20, 1, "accept", 3, DAY), (21, 21, 1, "reject", 3, DAY), (22, 22, 1, "accept", None, DAY), (23, 23, 1, "odd", None, DAY), (24, 24, 1, "propose", 4, DAY), (25, 25, 2, "accept", 5, DAY), (26, 26, 1, "odd", 99, DAY), (27, 27, 1, None, None, DAY)]
    log = spark.createDataFrame(rows, "event_id long, seq long, key long, action string, prior_event_id long, ts timestamp")
    wrong = E.violations(log)
    assert {tuple(r) for r in wrong.collect()} == {
        (21, "the event before is closed already"), (22, "no earlier event to follow"), (23, "unknown action"), (24, "a proposal follows nothing"),
        (25, "follows an event of another key"), (26, "unknown action"), (27, "no earlier event to follow"),
    }
    plan = wrong._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(prior_event_id" in plan[plan.index("Window") :]
