"""Applicability decisions: one case for each reason."""

import pytest

from quire.operators import decision_cases as D
from quire.operators import matching as M
from quire.operators.decision_cases import assertion, unit


def run(spark, units=None, assertions=(), events=(), selection=D.FULL, qualifiers=None, mode="confirmed", reference=False, kind="procedure", configurations=None):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    configurations = configurations or [("c", *D.FULL, {})]
    got = M.decide(
        frame(units or [unit()], D.UNITS),
        frame([("p", kind)], "publication_id string, kind string"),
        frame(assertions, D.ASSERTIONS),
        frame(configurations, D.CONFIGURATIONS),
        frame([("s", *selection, qualifiers or {}, mode, reference)], D.SCOPES),
        frame(events, D.EVENTS),
    ).collect()
    return {r["unit_id"]: (r["state"], r["reason"], r["search_eligible"]) for r in got}


def test_decisions(spark):
    """All cases in one run, a document and a scope for each."""
    decided = M.decide(*D.tables(spark.range(len(D.NAMES)).withColumnRenamed("id", "doc_id"))).where("unit_id = scope_id || ':u'")
    got = {D.NAMES[int(r["scope_id"])]: (r["state"], r["reason"], r["search_eligible"]) for r in decided.collect()}
    assert got == {name: expected for name, (_, expected) in D.CASES.items()}


@pytest.mark.parametrize("name", ["explicit", "stale", "heading proves engine"])
def test_decision_alone(spark, name):
    given, expected = D.CASES[name]
    assert run(spark, **given)["u"] == expected


def test_parent_contradiction_closes_a_nested_unit(spark):
    units = [unit("u", parent="v"), unit("v")]
    got = run(spark, units=units, assertions=[assertion("a1"), assertion("a2", subject="v", alternatives=[D.OTHER])])
    assert got["u"] == ("excluded", "conflicting_child", False)
    assert got["v"] == ("excluded", "excluded_by_source", False)


def test_cycle_is_an_error(spark):
    units = spark.createDataFrame([unit("u", parent="v"), unit("v", parent="u")], D.UNITS)
    with pytest.raises(ValueError):
        M.ancestry(units).count()


def test_every_reason_has_a_case():
    assert {reason for _, (_, reason, _) in D.CASES.values()} == {
        "explicit_source", "reviewed", "generic_reference", "incomplete_selection", "missing_make", "missing_model", "missing_year", "missing_engine", "missing_qualifier",
        "excluded_by_source", "conflicting_child", "mixed_content", "stale_review", "pending_cross_make", "unknown_identity", "no_eligible_units",
    }


def test_deep_parents(spark):
    """A chain of a hundred units: every subject, nearest first."""
    chain = [unit(f"u{k}", parent=f"u{k + 1}" if k < 99 else None) for k in range(100)]
    rows = M.ancestry(spark.createDataFrame(chain, D.UNITS)).where("unit_id = 'u0'").collect()
    assert sorted((r["depth"], r["subject_id"]) for r in rows) == [*[(k, f"u{k}") for k in range(100)], (100, "d"), (101, "p")]


def test_units_with_the_same_evidence_are_decided_once(spark):
    """A thousand units of few classes: one of each meets the scopes, and all get what each alone would get."""
    from pyspark.sql import functions as F

    docs = spark.range(4 * len(D.NAMES)).withColumnRenamed("id", "doc_id")
    tables = D.tables(docs)
    members, decided = M.decision_classes(*tables)
    classes = members.select("class").distinct().count()
    assert decided.count() == classes * len(D.NAMES) and classes < members.count() / 2
    rows = {(r["unit_id"], r["scope_id"]): r.asDict() for r in M.decide(*tables).collect()}
    assert len(rows) == members.count() * len(D.NAMES)
    units, publications, assertions, configurations, scopes, events = tables
    alone = M._decide(units, M.ancestry(units), assertions, configurations, scopes, events).collect()
    for r in alone:
        given = rows[r["unit_id"], r["scope_id"]]
        assert given["evidence_ids"] == sorted(r["evidence_ids"]) and given["review_event_ids"] == r["accepted"]
        if not r["nothing"] and given["reason"] not in ("generic_reference", "mixed_content"):
            assert (given["state"], given["reason"]) == tuple(r["verdict"])
    counted = {(r["scope_id"], r["state"]): (r["units"], r["no_content"]) for r in M.class_counts(members, decided).collect()}
    assert counted == {(r["scope_id"], r["state"]): (r["units"], r["no_content"]) for r in M.scope_counts(M.decide(*tables)).collect()}
    assert members.select(F.size("evidence")).distinct().count() > 1


def test_browsing_everything(spark):
    """A scope without a selection that browses all shows all that has text, as possible, with no evidence."""
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    units = [unit("u"), unit("v", state="metadata_only"), unit("w", publication="r")]
    scopes = [("all", None, None, None, None, {}, "include_possible", False, True), ("sure", None, None, None, None, {}, "confirmed", False, True), ("empty", None, None, None, None, {}, "include_possible", False, False)]
    got = M.decide(
        frame(units, D.UNITS), frame([("p", "procedure"), ("r", "reference")], "publication_id string, kind string"), frame([assertion("a1")], D.ASSERTIONS),
        frame([("c", *D.FULL, {})], D.CONFIGURATIONS), frame(scopes, D.SCOPES + ", browse_all boolean"), frame([D.event("e1")], D.EVENTS),
    ).collect()
    rows = {(r["scope_id"], r["unit_id"]): (r["state"], r["reason"], r["search_eligible"], r["evidence_ids"], r["review_event_ids"]) for r in got}
    browsed = ("possible", "incomplete_selection")
    assert all(rows["all", u] == (*browsed, u != "v", [], []) for u in "uvw") and all(rows["sure", u] == (*browsed, False, [], []) for u in "uvw")
    assert rows["empty", "u"][:3] == ("excluded", "no_eligible_units", False)
