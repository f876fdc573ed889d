"""Applicability: which units apply to a scope, decided by relational steps.

Tables
------
units           unit_id, document_id, publication_id, parent_unit_id, kind,
                search_state, mixed, citation struct<kind,path,page>
publications    publication_id, kind
assertions      assertion_id, subject_id, ord, intent, derivation, provenance,
                support, to_descendants, selector, citation, alternatives
                array<struct<make,model,year,engine: P, qualifiers map<string,P>>>
                with P = struct<state,value,start,end>
configurations  configuration_id, make_id, model_id, model_year, engine_id,
                qualifiers map<string,string>
scopes          scope_id, make_id, model_id, model_year, engine_id, qualifiers,
                mode, include_reference, and browse_all if any scope is one
events          event_id, subject_id, relation, action, prior_event_id, targets
                array<string>, bindings array<string>, stale

``decide`` gives one row for each unit and scope. Subjects of a unit are the
unit, its parents, its document and its publication, nearest first (depth 0 on).
Units whose evidence says the same at the same depths are a class
(``evidence_classes``), and one of a class is decided for all: every assertion on
its subjects is evaluated against every scope with array functions; each depth is
summed up on its own; the nearest depth at which a closing rule fires decides,
else one ordered chain over the sums of all depths does. So what meets every scope
is classes, not units; units come in where the rows are given out, with their own
assertions' ids. There is no loop over units and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.fixpoint import reliable
from quire.plans.sizes import small

FIELDS = {"make": "make_id", "model": "model_id", "year": "model_year", "engine": "engine_id"}
PREDICATE = "struct<state:string,value:string,start:int,end:int>"
ALTERNATIVES = f"array<struct<{','.join(f'{f}:{PREDICATE}' for f in FIELDS)},qualifiers:map<string,{PREDICATE}>>>"
EXPLICIT = ("explicit_text", "explicit_structured")


def predicate(p: Column, selected: Column) -> Column:
    """match, different, unknown or missing: how a predicate meets the selected value."""
    text = selected.cast("string")
    within = text.try_cast("int").between(p["start"], p["end"])
    return (
        F.when(p["state"] == "not_applicable", "match")
        .when(p["state"] == "unknown", "unknown")
        .when(selected.isNull(), "missing")
        .when(p["state"] == "all_in_scope", "match")
        .when(p["state"] == "range", F.when(within, "match").otherwise("different"))
        .when(p["value"] == text, "match")
        .otherwise("different")
    )


def alternative(alt: Column, scope: dict[str, Column], qualifiers: Column) -> Column:
    """struct(cost, unknown, missing, qualifiers) of one conjunction, null if any part differs."""
    parts = F.array(*[F.struct(F.lit(f).alias("name"), predicate(alt[f], scope[f]).alias("is")) for f in FIELDS])
    extra = F.transform(
        F.map_entries(alt["qualifiers"]),
        lambda e: F.struct(e["key"].alias("name"), predicate(e["value"], F.try_element_at(qualifiers, e["key"])).alias("is")),
    )
    extra = F.coalesce(extra, F.array().cast("array<struct<name:string,is:string>>"))
    named = lambda rows, *kinds: F.transform(F.filter(rows, lambda r: r["is"].isin(*kinds)), lambda r: r["name"])
    unknown, missing = named(parts, "unknown"), named(parts, "missing")
    open_ = F.array_sort(named(extra, "unknown", "missing"))
    differs = F.exists(F.concat(parts, extra), lambda r: r["is"] == "different")
    cost = F.size(unknown) + F.size(missing) + F.size(open_)
    return F.when(~differs, F.struct(cost.alias("cost"), unknown.alias("unknown"), missing.alias("missing"), open_.alias("qualifiers")))


def assertion_outcome(alternatives: Column, scope: dict[str, Column], qualifiers: Column) -> Column:
    """The cheapest alternative that can hold, or null."""
    return F.array_min(F.filter(F.transform(alternatives, lambda a: alternative(a, scope, qualifiers)), lambda x: x.isNotNull()))


def ancestry(units: DataFrame) -> DataFrame:
    """(unit_id, subject_id, depth, inner, length): subjects of each unit, nearest first.

    ``inner`` marks the unit and its parents, the rest are document and publication.
    """
    jump = reliable(units.where("parent_unit_id is not null").select(F.col("unit_id").alias("__child"), F.col("parent_unit_id").alias("__parent")))
    found, length = units.select("unit_id", F.col("unit_id").alias("subject_id"), F.lit(0).alias("depth")), 1
    while not jump.isEmpty():
        # parents up to ``length`` are known; jumps of that length reach as far again
        above = found.join(jump, F.col("subject_id") == F.col("__child")).select("unit_id", F.col("__parent").alias("subject_id"), (F.col("depth") + length).alias("depth"))
        found = reliable(found.unionByName(above))
        if not found.where("depth > 0 and unit_id = subject_id").isEmpty():
            raise ValueError("unit parents form a cycle")
        further = jump.select(F.col("__child").alias("__middle"), F.col("__parent").alias("__end"))
        jump = reliable(jump.join(further, F.col("__parent") == F.col("__middle")).select("__child", F.col("__end").alias("__parent")))
        length *= 2
    last = found.groupBy("unit_id").agg(F.max("depth").alias("last"))
    outer = units.join(last, "unit_id").select(
        "unit_id",
        F.posexplode(F.array("document_id", "publication_id")).alias("k", "subject_id"),
        "last",
    )
    outer = outer.select("unit_id", "subject_id", (F.col("last") + 1 + F.col("k")).alias("depth"), F.lit(False).alias("inner"))
    return found.withColumn("inner", F.lit(True)).unionByName(outer).join(last.select("unit_id", (F.col("last") + 3).alias("length")), "unit_id")


def scope_configurations(scopes: DataFrame, configurations: DataFrame) -> DataFrame:
    """(scope_id, known, configuration_id): whether a full selection fits a configuration, and the most qualified one it names in full."""
    fits = scopes.alias("s").join(small(configurations).alias("c"), [F.col(f"s.{k}").cast("string") == F.col(f"c.{k}").cast("string") for k in FIELDS.values()])
    chosen = F.coalesce(F.col("s.qualifiers"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    held = F.map_entries(F.coalesce(F.col("c.qualifiers"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    compatible = F.forall(held, lambda e: F.coalesce(F.try_element_at(chosen, e["key"]) == e["value"], F.lit(True)))
    complete = F.forall(held, lambda e: F.coalesce(F.try_element_at(chosen, e["key"]) == e["value"], F.lit(False)))
    best = F.max(F.when(complete, F.struct(F.size(held).alias("n"), F.col("c.configuration_id").alias("id"))))
    return fits.where(compatible).groupBy(F.col("s.scope_id").alias("scope_id")).agg(F.lit(True).alias("known"), best["id"].alias("configuration_id"))


def review_state(events: DataFrame, subjects: DataFrame, chosen: DataFrame) -> DataFrame:
    """(unit_id, scope_id, accepted, own_accepted, pending, stale): live events of each unit in each scope."""
    closed = events.where("prior_event_id is not null").select(F.col("prior_event_id").alias("event_id")).distinct()
    live = events.where("relation = 'section_applies'").join(closed, "event_id", "left_anti")
    named = live.select("event_id", "subject_id", "action", "stale", F.explode("targets").alias("configuration_id")).distinct()
    met = named.join(chosen.where("configuration_id is not null"), "configuration_id").join(subjects, "subject_id")
    kept = lambda rule: F.array_sort(F.collect_set(F.when(rule, F.col("event_id"))))
    accepted = (F.col("action") == "accept") & ~F.col("stale")
    return met.groupBy("unit_id", "scope_id").agg(
        kept(accepted).alias("accepted"),
        kept(accepted & (F.col("depth") == 0)).alias("own_accepted"),
        kept((F.col("action") == "propose") & ~F.col("stale")).alias("pending"),
        kept((F.col("action") == "accept") & F.col("stale")).alias("stale"),
    )


def _proofs(units, assertions, subjects, events, scopes, review) -> DataFrame:
    """(unit_id, scope_id, proofs): sets of fields that an accepted review of the unit itself proves."""
    own = review.select("unit_id", "scope_id", F.explode("own_accepted").alias("event_id"))
    bound = events.select("event_id", F.explode("bindings").alias("assertion_id"))
    rows = own.join(bound, "event_id").join(assertions.drop("ord"), "assertion_id")
    rows = rows.join(units.select("unit_id", F.col("kind").alias("unit_kind"), F.col("citation").alias("place")), "unit_id")
    rows = rows.join(scopes, "scope_id")
    inside = subjects.select("unit_id", "subject_id").withColumn("inside", F.lit(True))
    rows = rows.join(inside, ["unit_id", "subject_id"], "left")
    scope = {f: F.col(k) for f, k in FIELDS.items()}
    native = (F.col("intent") == "include") & (F.col("provenance") == "native")
    near = F.col("citation.page").between(F.col("place.page"), F.col("place.page") + 1)
    by_page = (F.col("unit_kind") == "region") & (F.col("place.kind") == "page") & (F.col("citation.kind") == "page")
    by_page &= (F.col("support") == "source_supported") & (F.col("citation.path") == F.col("place.path")) & near
    stated = F.col("derivation").isin(*EXPLICIT) | ((F.col("derivation") == "title_hint") & F.coalesce(F.col("selector") == "heading", F.lit(False)))
    by_heading = (F.col("unit_kind") == "section") & (F.col("place.kind") == "path") & F.col("inside").isNotNull() & stated

    def exact(alternatives):
        fields = lambda a: F.filter(
            F.array(*[F.when((a[f]["state"] == "exact") & (a[f]["value"] == scope[f].cast("string")), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull()
        )
        return F.array_distinct(F.flatten(F.transform(alternatives, fields)))

    viable = F.filter("alternatives", lambda a: alternative(a, scope, F.col("qualifiers")).isNotNull())
    shown = F.when(native & by_page, exact(F.col("alternatives"))).when(native & by_heading, exact(viable))
    proved = rows.withColumn("proved", shown).where("proved is not null")
    proved = proved.groupBy("unit_id", "scope_id", "event_id").agg(F.array_distinct(F.flatten(F.collect_list("proved"))).alias("proved"))
    return proved.groupBy("unit_id", "scope_id").agg(F.collect_list("proved").alias("proofs"))


def evidence_classes(units: DataFrame, assertions: DataFrame, subjects: DataFrame, events: DataFrame) -> DataFrame:
    """(unit_id, class, evidence): units of one class have the same evidence but for names, and so the same decisions on it.

    A class is a digest of the unit's assertions in order of depth, place and id,
    each with all that decisions read of it, and of the live reviews on what is
    above the unit. A unit with a review of its own is a class of its own, since
    such a review may prove what the unit's citation shows. ``evidence`` has the
    assertions' ids in the class's order.
    """
    told = F.to_json(F.struct("intent", "derivation", "provenance", "support", "alternatives"))
    lines = subjects.join(assertions, "subject_id").where("depth = 0 or to_descendants").withColumn("says", F.concat_ws("|", "inner", told))
    listed = lines.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("depth", "ord", "assertion_id", "says"))).alias("all"))  # what one unit inherits
    # of places only their order is read, and whether two are the same
    tied = lambda one, k: (k > 0) & F.coalesce(F.get("all", k - 1)["depth"].eqNullSafe(one["depth"]) & F.get("all", k - 1)["ord"].eqNullSafe(one["ord"]), F.lit(False))
    line = lambda one, k: F.concat_ws("|", one["depth"].cast("string"), tied(one, k).cast("string"), one["says"])
    listed = listed.select("unit_id", F.transform("all", line).alias("lines"), F.transform("all", lambda one: one["assertion_id"]).alias("evidence"))
    closed = events.where("prior_event_id is not null").select(F.col("prior_event_id").alias("event_id")).distinct()
    live = events.where("relation = 'section_applies'").join(closed, "event_id", "left_anti").select("event_id", "subject_id").distinct()
    named = subjects.join(small(live), "subject_id").groupBy("unit_id").agg(F.array_sort(F.collect_set("event_id")).alias("events"), F.min("depth").alias("nearest"))
    own = F.when(F.col("nearest") == 0, F.col("unit_id"))
    nested = subjects.where("depth = 0").select("unit_id", (F.col("length") > 3).alias("nested"))
    rows = units.select("unit_id").join(nested, "unit_id").join(listed, "unit_id", "left").join(named, "unit_id", "left")
    digest = F.sha2(F.to_json(F.struct("nested", "lines", "events", own.alias("own"))).cast("binary"), 256)
    return rows.select("unit_id", digest.alias("class"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def decide(units: DataFrame, publications: DataFrame, assertions: DataFrame, configurations: DataFrame, scopes: DataFrame, events: DataFrame) -> DataFrame:
    """(unit_id, scope_id, state, reason, search_eligible, evidence_ids, review_event_ids) of every unit in every scope."""
    members, decided = decision_classes(units, publications, assertions, configurations, scopes, events)
    rows = members.join(small(decided), "class")
    verdict, eligible = _given(rows)
    named = F.array_sort(F.transform("places", lambda place: F.element_at("evidence", place.cast("int"))))
    none = F.array().cast("array<string>")
    browsed = F.col("browse_all")
    return rows.select(
        "unit_id",
        "scope_id",
        verdict["state"].alias("state"),
        verdict["reason"].alias("reason"),
        eligible.alias("search_eligible"),
        F.when(browsed, none).otherwise(named).alias("evidence_ids"),
        F.when(browsed, none).otherwise(F.col("accepted")).alias("review_event_ids"),
    )


def _outcome(state, reason) -> Column:
    state = F.lit(state) if isinstance(state, str) else state
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(state.alias("state"), reason.alias("reason"))


def _given(rows: DataFrame) -> tuple[Column, Column]:
    """The verdict on a unit, from its class's and what is the unit's own; and whether a search may show it."""
    verdict = (
        F.when(F.col("browse_all"), _outcome("possible", "incomplete_selection"))
        .when(F.col("nothing"), _outcome("excluded", "no_eligible_units"))
        .when((F.col("publication_kind") == "reference") & F.col("include_reference"), _outcome("reference", "generic_reference"))
        .when(F.col("publication_kind") == "reference", _outcome("excluded", "generic_reference"))
        .when((F.col("search_state") == "metadata_only") & F.col("mixed"), _outcome("excluded", "mixed_content"))
        .otherwise(F.col("verdict"))
    )
    may = (verdict["state"] == "possible") & (F.col("mode") == "include_possible")
    return verdict, (verdict["state"].isin("confirmed", "reference") | may) & (F.col("search_state") != "metadata_only")


def decision_classes(units: DataFrame, publications: DataFrame, assertions: DataFrame, configurations: DataFrame, scopes: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units with their class and what is their own; and a decision for each class and scope.

    (unit_id, class, evidence, publication_kind, search_state, mixed) and (class,
    scope_id, mode, include_reference, browse_all, nothing, verdict, places,
    accepted); ``places`` are those of the evidence among a member's.
    """
    subjects = reliable(ancestry(units))
    classes = reliable(evidence_classes(units, assertions, subjects, events))
    first = reliable(classes.groupBy("class").agg(F.min(F.struct("unit_id", "evidence")).alias("first")).select("class", "first.unit_id", F.col("first.evidence").alias("of_first")))
    one = first.select("unit_id")
    decided = _decide(units.join(one, "unit_id", "left_semi"), subjects.join(one, "unit_id", "left_semi"), assertions, configurations, scopes, events).join(first, "unit_id")
    places = F.transform("evidence_ids", lambda name: F.array_position("of_first", name))
    kinds = publications.select("publication_id", F.col("kind").alias("publication_kind"))
    members = units.select("unit_id", "publication_id", "search_state", "mixed").join(small(kinds), "publication_id").drop("publication_id").join(classes, "unit_id")
    return members, decided.select("class", "scope_id", "mode", "include_reference", "browse_all", "nothing", "verdict", places.alias("places"), "accepted")


def _decide(units: DataFrame, subjects: DataFrame, assertions: DataFrame, configurations: DataFrame, scopes: DataFrame, events: DataFrame) -> DataFrame:
    """What the evidence of each unit says in each scope: (unit_id, scope_id, ..., nothing, verdict, evidence_ids, accepted)."""
    scopes = scopes if "browse_all" in scopes.columns else scopes.withColumn("browse_all", F.lit(False))
    scopes = small(scopes)
    chosen = small(reliable(scope_configurations(scopes, configurations)))
    review = review_state(events, subjects, chosen)
    scope = {f: F.col(k) for f, k in FIELDS.items()}

    # every assertion of these units, one a class, against every scope; scopes are a small table of selections
    applied = subjects.join(assertions, "subject_id").where("depth = 0 or to_descendants").crossJoin(scopes)
    applied = applied.withColumn("outcome", assertion_outcome(F.col("alternatives"), scope, F.col("qualifiers")))
    holds, include = F.col("outcome").isNotNull(), F.col("intent") == "include"
    supported = F.col("support") == "source_supported"
    named = F.flatten(F.transform("alternatives", lambda a: F.coalesce(F.map_entries(a["qualifiers"]), F.array().cast(f"array<struct<key:string,value:{PREDICATE}>>"))))
    restricts = (F.col("provenance") == "native") & F.col("derivation").isin(*EXPLICIT) & (F.size(named) > 0)
    open_ = F.exists(named, lambda e: e["value"]["state"] == "unknown") | F.coalesce(F.size("outcome.qualifiers") > 0, F.lit(False))
    closing = F.when(restricts & open_, "missing_qualifier").when(restricts & include & ~holds, "excluded_by_source")
    order = F.struct((~include).alias("late"), F.col("ord"))
    depths = applied.groupBy("unit_id", "scope_id", "depth", "inner", "length").agg(
        F.min(F.when(closing.isNotNull(), F.struct(order.alias("order"), closing.alias("reason"), F.col("assertion_id").alias("id")))).alias("restriction"),
        F.min(F.when(~include & supported & holds, F.struct(order.alias("order"), F.col("assertion_id").alias("id")))).alias("barred"),
        F.count_if(include & supported).alias("supported"),
        F.count_if(include & supported & holds).alias("supported_hold"),
        F.count_if(include).alias("includes"),
        F.count_if(include & holds).alias("hold"),
        F.min(
            F.when(include & holds, F.struct((~supported).alias("hint"), F.col("outcome.cost").alias("cost"), F.col("ord"), F.col("assertion_id").alias("id"), F.col("outcome")))
        ).alias("best"),
    )
    against = (F.col("supported") > 0) & (F.col("supported_hold") == 0)
    contradicted = against | ((F.col("includes") > 0) & (F.col("supported") == 0) & (F.col("hold") == 0))
    child = F.when(F.col("inner"), "conflicting_child").otherwise("excluded_by_source")
    closed = (
        F.when(F.col("restriction").isNotNull(), F.struct("depth", F.col("restriction.reason").alias("reason"), F.col("restriction.id").alias("id")))
        .when(F.col("barred").isNotNull(), F.struct("depth", child.alias("reason"), F.col("barred.id").alias("id")))
        .when(against & F.col("inner") & (F.col("length") > 3), F.struct("depth", F.lit("conflicting_child").alias("reason"), F.lit(None).cast("string").alias("id")))
    )
    hint, basis = F.col("best.hint"), F.col("best").isNotNull()
    gathered = lambda rule, column: F.array_distinct(F.flatten(F.collect_list(F.when(rule, F.col(column)))))
    sums = depths.groupBy("unit_id", "scope_id").agg(
        F.min(closed).alias("closed"),
        F.max(contradicted).alias("contradicted"),
        F.max(F.coalesce(~hint, F.lit(False))).alias("positive"),
        F.max(F.coalesce(hint, F.lit(False))).alias("proposal"),
        gathered(basis & ~hint, "best.outcome.unknown").alias("source_missing"),
        gathered(basis & hint, "best.outcome.unknown").alias("hint_missing"),
        gathered(basis & ~hint, "best.outcome.qualifiers").alias("source_qualifiers"),
        gathered(basis & hint, "best.outcome.qualifiers").alias("hint_qualifiers"),
        F.max(F.coalesce(F.array_contains("best.outcome.unknown", "make"), F.lit(False))).alias("unknown_make"),
        F.max(F.col("depth") == 0).alias("has_own"),
        F.array_sort(F.collect_set("best.id")).alias("basis"),
    )
    rows = units.select("unit_id").crossJoin(scopes)
    rows = rows.join(chosen, "scope_id", "left").join(sums, ["unit_id", "scope_id"], "left").join(review, ["unit_id", "scope_id"], "left")
    rows = rows.join(_proofs(units, assertions, subjects, events, scopes, review), ["unit_id", "scope_id"], "left")

    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    some = lambda name: F.coalesce(F.size(name) > 0, F.lit(False))
    positive, proposal, accepted, pending = flag("positive"), flag("proposal"), some("accepted"), some("pending")
    missing = F.when(positive, F.col("source_missing")).otherwise(F.col("hint_missing"))
    qualifiers = F.when(positive, F.col("source_qualifiers")).otherwise(F.col("hint_qualifiers"))
    lacks, unqualified = F.coalesce(F.size(missing) > 0, F.lit(False)), F.coalesce(F.size(qualifiers) > 0, F.lit(False))
    filled = F.coalesce(F.exists("proofs", lambda p: F.size(F.array_except(missing, p)) == 0), F.lit(False))
    first_missing = F.coalesce(*[F.when(F.array_contains(missing, f), F.lit(f"missing_{f}")) for f in FIELDS], F.lit("missing_qualifier"))
    empty = F.coalesce(*[F.col(k).cast("string") for k in FIELDS.values()]).isNull() & ~some("qualifiers")
    full = F.col("make_id").isNotNull() & F.col("model_id").isNotNull() & F.col("model_year").isNotNull() & F.col("engine_id").isNotNull()
    may = F.when(F.col("mode") == "include_possible", "possible").otherwise("excluded")

    reason = F.col("closed.reason")
    verdict = (
        F.when(reason == "missing_qualifier", _outcome(may, "missing_qualifier"))
        .when(reason.isNotNull(), _outcome("excluded", reason))
        .when(~accepted & some("stale"), _outcome("excluded", "stale_review"))
        .when(~accepted & pending & ~positive & ~proposal, _outcome("excluded", "pending_cross_make"))
        .when(~accepted & flag("contradicted"), _outcome("excluded", "excluded_by_source"))
        .when(accepted & flag("contradicted") & flag("has_own") & ~some("own_accepted"), _outcome("excluded", "conflicting_child"))
        .when((flag("unknown_make") & ~positive & ~accepted) | (~positive & ~proposal & ~accepted), _outcome("unmapped", "unknown_identity"))
        .when(accepted & flag("has_own") & (unqualified | (lacks & ~filled)), _outcome(may, F.when(unqualified, F.lit("missing_qualifier")).otherwise(first_missing)))
        .when(accepted, _outcome("confirmed", "reviewed"))
        .when(~positive, _outcome(may, first_missing))
        .when(~full, _outcome(may, "incomplete_selection"))
        .when(unqualified, _outcome(may, "missing_qualifier"))
        .when(lacks, _outcome(may, first_missing))
        .otherwise(_outcome("confirmed", "explicit_source"))
    )
    none = F.array().cast("array<string>")
    return rows.select(
        "unit_id",
        "scope_id",
        "mode",
        "include_reference",
        "browse_all",
        (empty | (full & ~flag("known"))).alias("nothing"),
        verdict.alias("verdict"),
        F.coalesce(F.when(F.col("closed.id").isNotNull(), F.array("closed.id")), F.col("basis"), none).alias("evidence_ids"),
        F.coalesce("accepted", none).alias("accepted"),
    )


def class_counts(members: DataFrame, decided: DataFrame) -> DataFrame:
    """``scope_counts`` of the two tables of ``decision_classes``: members are counted by class first, so units don't meet scopes."""
    own = ["class", "publication_kind", "search_state", "mixed"]
    rows = members.groupBy(*own).agg(F.count("*").alias("members")).join(decided, "class")
    verdict, eligible = _given(rows)
    rows = rows.select("scope_id", verdict["state"].alias("state"), eligible.alias("search_eligible"), "members")
    content = rows.groupBy("scope_id").agg((~F.max("search_eligible")).alias("no_content"))
    return rows.groupBy("scope_id", "state").agg(F.sum("members").alias("units")).join(content, "scope_id")


def scope_counts(decisions: DataFrame) -> DataFrame:
    """(scope_id, state, units, no_content)."""
    content = decisions.groupBy("scope_id").agg((~F.max("search_eligible")).alias("no_content"))
    return decisions.groupBy("scope_id", "state").agg(F.count("*").alias("units")).join(content, "scope_id")


# ---------------------------------------------------------------- queries


def _p(state: str, value=None, start=None, end=None) -> Column:
    value = value if value is not None else F.lit(None)
    start, end = (x if x is not None else F.lit(None) for x in (start, end))
    return F.struct(F.lit(state).alias("state"), value.cast("string").alias("value"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _tables(spark, sf_dir):
    """Documents as units: language, source and id stand in for make, model, year and engine."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    key = F.col("doc_id").cast("string")
    citation = F.struct(F.lit("path").alias("kind"), F.col("source").alias("path"), F.lit(None).cast("int").alias("page"))
    units = docs.select(
        F.concat(F.lit("u"), key).alias("unit_id"), F.concat(F.lit("d"), key).alias("document_id"), F.concat(F.lit("p"), F.col("source")).alias("publication_id"),
        F.lit(None).cast("string").alias("parent_unit_id"), F.lit("section").alias("kind"),
        F.when(F.col("doc_id") % 17 == 0, "metadata_only").otherwise("whole").alias("search_state"), (F.col("doc_id") % 34 == 0).alias("mixed"), citation.alias("citation"),
    )
    publications = docs.select(F.concat(F.lit("p"), F.col("source")).alias("publication_id"), F.when(F.col("source") == "src1", "reference").otherwise("procedure").alias("kind")).distinct()
    year = 1990 + F.col("doc_id") % 30
    alternatives = F.array(F.struct(
        _p("exact", F.col("lang")).alias("make"), _p("all_in_scope").alias("model"), _p("range", None, year, year + 5).alias("year"),
        F.when(F.col("doc_id") % 5 == 0, _p("unknown")).otherwise(_p("not_applicable")).alias("engine"), F.lit(None).cast(f"map<string,{PREDICATE}>").alias("qualifiers"),
    )).cast(ALTERNATIVES)
    assertions = docs.where("doc_id % 7 <> 0").select(
        F.concat(F.lit("a"), key).alias("assertion_id"), F.concat(F.lit("u"), key).alias("subject_id"), F.lit(0).alias("ord"),
        F.when(F.col("doc_id") % 11 == 0, "exclude").otherwise("include").alias("intent"), F.lit("explicit_text").alias("derivation"), F.lit("native").alias("provenance"),
        F.when(F.col("doc_id") % 3 == 0, "candidate").otherwise("source_supported").alias("support"), F.lit(True).alias("to_descendants"), F.lit(None).cast("string").alias("selector"),
        citation.alias("citation"), alternatives.alias("alternatives"),
    )
    configurations = spark.createDataFrame([("c1", "en", "m", 2000, "e", {})], "configuration_id string, make_id string, model_id string, model_year int, engine_id string, qualifiers map<string,string>")
    scopes = spark.createDataFrame(
        [("s1", "en", "m", 2000, "e", {}, "confirmed", True), ("s2", "en", "m", None, None, {}, "include_possible", False), ("s3", "fr", "m", 2000, "e", {}, "confirmed", False), ("s4", None, None, None, None, {}, "confirmed", False)],
        "scope_id string, make_id string, model_id string, model_year int, engine_id string, qualifiers map<string,string>, mode string, include_reference boolean",
    )
    events = spark.createDataFrame([], "event_id string, subject_id string, relation string, action string, prior_event_id string, targets array<string>, bindings array<string>, stale boolean")
    return units, publications, assertions, configurations, scopes, events


def q_unit_decisions(spark, sf_dir):
    return decide(*_tables(spark, sf_dir)).select("unit_id", "scope_id", "state", "reason", "search_eligible")


def q_scope_state_counts(spark, sf_dir):
    return class_counts(*decision_classes(*_tables(spark, sf_dir)))


QUERIES = {"unit_decisions": q_unit_decisions, "scope_state_counts": q_scope_state_counts}

_DECIDED = """WITH s(scope_id, make, year, full_one, mode, reference) AS (VALUES ('s1', 'en', 2000, true, 'confirmed', true), ('s2', 'en', NULL, false, 'include_possible', false),
    ('s3', 'fr', 2000, true, 'confirmed', false), ('s4', NULL, NULL, false, 'confirmed', false)),
  x AS (SELECT *, doc_id % 7 <> 0 AS asserted, doc_id % 11 = 0 AS excludes, doc_id % 3 <> 0 AS supported, doc_id % 5 = 0 AS open,
    lang = make AND (year IS NULL OR year BETWEEN 1990 + doc_id % 30 AND 1995 + doc_id % 30) AS holds FROM documents, s),
  v AS (SELECT doc_id, scope_id, mode, CASE
    WHEN make IS NULL OR scope_id = 's3' THEN 'excluded no_eligible_units'
    WHEN source = 'src1' THEN CASE WHEN reference THEN 'reference' ELSE 'excluded' END || ' generic_reference'
    WHEN doc_id % 34 = 0 THEN 'excluded mixed_content'
    WHEN NOT asserted THEN 'unmapped unknown_identity'
    WHEN excludes THEN CASE WHEN supported AND holds THEN 'excluded conflicting_child' ELSE 'unmapped unknown_identity' END
    WHEN NOT holds THEN 'excluded excluded_by_source'
    WHEN NOT supported THEN CASE WHEN open THEN CASE WHEN mode = 'include_possible' THEN 'possible' ELSE 'excluded' END || ' missing_engine'
      ELSE CASE WHEN mode = 'include_possible' THEN 'possible' ELSE 'excluded' END || ' missing_qualifier' END
    WHEN NOT full_one THEN 'possible incomplete_selection'
    WHEN open THEN 'excluded missing_engine'
    ELSE 'confirmed explicit_source' END AS verdict FROM x),
  d AS (SELECT 'u' || doc_id AS unit_id, scope_id, split_part(verdict, ' ', 1) AS state, split_part(verdict, ' ', 2) AS reason,
    (split_part(verdict, ' ', 1) IN ('confirmed', 'reference') OR split_part(verdict, ' ', 1) = 'possible' AND mode = 'include_possible') AND doc_id % 17 <> 0 AS search_eligible FROM v)"""

ORACLE_SQL = {
    "unit_decisions": _DECIDED + " SELECT * FROM d",
    "scope_state_counts": _DECIDED + ", c AS (SELECT scope_id, NOT bool_or(search_eligible) AS no_content FROM d GROUP BY 1) SELECT scope_id, state, count(*) AS units, no_content FROM d JOIN c USING (scope_id) GROUP BY ALL",
}
