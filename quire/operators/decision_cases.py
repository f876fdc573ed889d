"""Hand-made cases of applicability, one at least for each reason, and a query that decides them for every document.

A case is its units, assertions and events, a selection with its mode, and the
state, reason and eligibility that unit ``u`` must have, written down by hand from
the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import matching as M
from quire.operators.cases import listed


def pred(state, value=None, start=None, end=None):
    return {"state": state, "value": value, "start": start, "end": end}


def exact(value):
    return pred("exact", value)


FITS = {"make": exact("mk"), "model": exact("md"), "year": pred("range", None, 2000, 2010), "engine": exact("en"), "qualifiers": {}}


def alt(**changes):
    return {**FITS, **changes}


UNITS = "unit_id string, document_id string, publication_id string, parent_unit_id string, kind string, search_state string, mixed boolean, citation struct<kind:string,path:string,page:int>"
ASSERTIONS = (
    "assertion_id string, subject_id string, ord int, intent string, derivation string, provenance string, support string, to_descendants boolean, "
    f"selector string, citation struct<kind:string,path:string,page:int>, alternatives {M.ALTERNATIVES}"
)
CONFIGURATIONS = "configuration_id string, make_id string, model_id string, model_year int, engine_id string, qualifiers map<string,string>"
SCOPES = "scope_id string, make_id string, model_id string, model_year int, engine_id string, qualifiers map<string,string>, mode string, include_reference boolean"
EVENTS = "event_id string, subject_id string, relation string, action string, prior_event_id string, targets array<string>, bindings array<string>, stale boolean"

FULL = ("mk", "md", 2005, "en")


def unit(name="u", publication="p", parent=None, kind="section", state="whole", mixed=False, citation=("path", "a.html", None)):
    return (name, "d", publication, parent, kind, state, mixed, citation)


def assertion(name, subject="u", alternatives=None, intent="include", support="source_supported", derivation="explicit_text", down=True, selector=None, citation=("path", "a.html", None)):
    return (name, subject, int(name[1:]), intent, derivation, "native", support, down, selector, citation, alternatives or [FITS])


def event(name, action="accept", subject="u", prior=None, bindings=(), stale=False):
    return (name, subject, "section_applies", action, prior, ["c"], list(bindings), stale)


NO_ENGINE = alt(engine=pred("unknown"))
OTHER = alt(model=exact("other"))
CASES = {
    "explicit": (dict(assertions=[assertion("a1")]), ("confirmed", "explicit_source", True)),
    "out of years": (dict(assertions=[assertion("a1", alternatives=[alt(year=pred("range", None, 1990, 1999))])]), ("excluded", "excluded_by_source", False)),
    "unknown configuration": (dict(assertions=[assertion("a1")], selection=("mk", "md", 1999, "en")), ("excluded", "no_eligible_units", False)),
    "empty selection": (dict(assertions=[assertion("a1")], selection=(None, None, None, None)), ("excluded", "no_eligible_units", False)),
    "reference kept out": (dict(kind="reference"), ("excluded", "generic_reference", False)),
    "reference let in": (dict(kind="reference", reference=True), ("reference", "generic_reference", True)),
    "mixed": (dict(units=[unit(state="metadata_only", mixed=True)]), ("excluded", "mixed_content", False)),
    "metadata only": (dict(units=[unit(state="metadata_only")], assertions=[assertion("a1")]), ("confirmed", "explicit_source", False)),
    "nothing known": (dict(), ("unmapped", "unknown_identity", False)),
    "unknown make": (dict(assertions=[assertion("a1", alternatives=[alt(make=pred("unknown"))], support="candidate")]), ("unmapped", "unknown_identity", False)),
    "hint lacks engine": (dict(assertions=[assertion("a1", alternatives=[NO_ENGINE], support="candidate")], mode="include_possible"), ("possible", "missing_engine", True)),
    "source lacks engine": (dict(assertions=[assertion("a1", alternatives=[NO_ENGINE])]), ("excluded", "missing_engine", False)),
    "incomplete": (dict(assertions=[assertion("a1")], selection=("mk", "md", None, None), mode="include_possible"), ("possible", "incomplete_selection", True)),
    "excluded here": (dict(assertions=[assertion("a1"), assertion("a2", intent="exclude")]), ("excluded", "conflicting_child", False)),
    "excluded above": (dict(assertions=[assertion("a1"), assertion("a2", subject="d", intent="exclude")]), ("excluded", "excluded_by_source", False)),
    "not handed down": (dict(assertions=[assertion("a1"), assertion("a2", subject="d", intent="exclude", down=False)]), ("confirmed", "explicit_source", True)),
    "qualifier not chosen": (dict(assertions=[assertion("a1", alternatives=[alt(qualifiers={"vin": exact("Z")})])], mode="include_possible"), ("possible", "missing_qualifier", True)),
    "qualifier differs": (dict(assertions=[assertion("a1", alternatives=[alt(qualifiers={"vin": exact("Z")})])], qualifiers={"vin": "Y"}), ("excluded", "excluded_by_source", False)),
    "qualifier fits": (dict(assertions=[assertion("a1", alternatives=[alt(qualifiers={"vin": exact("Z")})])], qualifiers={"vin": "Z"}), ("confirmed", "explicit_source", True)),
    "one alternative fits": (dict(assertions=[assertion("a1", alternatives=[OTHER, FITS])]), ("confirmed", "explicit_source", True)),
    "reviewed": (dict(events=[event("e1")]), ("confirmed", "reviewed", True)),
    "revoked": (dict(events=[event("e1"), event("e2", "revoke", prior="e1")]), ("unmapped", "unknown_identity", False)),
    "stale": (dict(events=[event("e1", stale=True)]), ("excluded", "stale_review", False)),
    "pending": (dict(events=[event("e1", "propose")]), ("excluded", "pending_cross_make", False)),
    "review above a contradiction": (
        dict(assertions=[assertion("a1", alternatives=[OTHER], support="candidate")], events=[event("e1", subject="d")]),
        ("excluded", "conflicting_child", False),
    ),
    "review leaves engine open": (
        dict(assertions=[assertion("a1", alternatives=[NO_ENGINE])], events=[event("e1")]),
        ("excluded", "missing_engine", False),
    ),
    "heading proves engine": (
        dict(
            assertions=[assertion("a1", alternatives=[NO_ENGINE]), assertion("a2", subject="d", derivation="title_hint", selector="heading", support="candidate")],
            events=[event("e1", bindings=["a2"])],
        ),
        ("confirmed", "reviewed", True),
    ),
    "next page proves engine": (
        dict(
            units=[unit(kind="region", citation=("page", "m.pdf", 3))],
            assertions=[assertion("a1", alternatives=[NO_ENGINE]), assertion("a2", subject="elsewhere", citation=("page", "m.pdf", 4))],
            events=[event("e1", bindings=["a2"])],
        ),
        ("confirmed", "reviewed", True),
    ),
    "page after next proves nothing": (
        dict(
            units=[unit(kind="region", citation=("page", "m.pdf", 3))],
            assertions=[assertion("a1", alternatives=[NO_ENGINE]), assertion("a2", subject="elsewhere", citation=("page", "m.pdf", 5))],
            events=[event("e1", bindings=["a2"])],
        ),
        ("excluded", "missing_engine", False),
    ),
    "source lacks make": (dict(assertions=[assertion("a1", alternatives=[alt(make=pred("unknown"))])], mode="include_possible"), ("possible", "missing_make", True)),
    "source lacks model": (dict(assertions=[assertion("a1", alternatives=[alt(model=pred("unknown"))])]), ("excluded", "missing_model", False)),
    "source lacks year": (dict(assertions=[assertion("a1", alternatives=[alt(year=pred("unknown"))])], mode="include_possible"), ("possible", "missing_year", True)),
    "parent contradicts": (
        dict(units=[unit("u", parent="v"), unit("v")], assertions=[assertion("a1"), assertion("a2", subject="v", alternatives=[OTHER])]),
        ("excluded", "conflicting_child", False),
    ),
}
DEFAULTS = dict(assertions=[], events=[], selection=FULL, qualifiers=None, mode="confirmed", reference=False, kind="procedure")
NAMES = sorted(CASES)


def tables(docs: DataFrame) -> tuple[DataFrame, ...]:
    """The tables of ``matching.decide``: each document (doc_id) is the document of its case, with units, assertions and events of its own; a scope a case."""
    spark, rows = docs.sparkSession, [{**DEFAULTS, **CASES[name][0]} for name in NAMES]
    held = [(k, row.get("units") or [unit()], row["assertions"], row["events"], row["kind"]) for k, row in enumerate(rows)]
    struct = lambda schema: f"array<struct<{schema.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>"
    shape = f"k int, units {struct(UNITS)}, assertions {struct(ASSERTIONS)}, events {struct(EVENTS)}, kind string"
    each = docs.select("doc_id", (F.col("doc_id") % len(NAMES)).cast("int").alias("k")).join(F.broadcast(spark.createDataFrame(held, shape)), "k")  # a row a case
    own = lambda c: F.when(F.col(c) == "elsewhere", F.col(c)).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col(c)))

    def part(name: str, *ids: str) -> DataFrame:
        found = each.select("doc_id", F.explode(name).alias("r")).select("doc_id", "r.*")
        for column in ids:
            found = found.withColumn(column, own(column))
        return found.drop("doc_id")

    units = part("units", "unit_id", "document_id", "publication_id", "parent_unit_id")
    assertions = part("assertions", "assertion_id", "subject_id")
    events = part("events", "event_id", "subject_id", "prior_event_id")
    mine = each.select("doc_id", F.explode("events").alias("r")).select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "r.event_id").alias("event_id"), F.transform("r.bindings", lambda b: F.concat(F.col("doc_id").cast("string"), F.lit(":"), b)).alias("bindings"))
    events = events.drop("bindings").join(mine, "event_id")
    publications = each.select(F.concat(F.col("doc_id").cast("string"), F.lit(":p")).alias("publication_id"), "kind")
    scopes = spark.createDataFrame([(str(k), *row["selection"], row["qualifiers"] or {}, row["mode"], row["reference"]) for k, row in enumerate(rows)], SCOPES)
    return units, publications, assertions, spark.createDataFrame([("c", *FULL, {})], CONFIGURATIONS), scopes, events


def q_decision_cases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    decided = M.decide(*tables(docs)).where("unit_id like '%:u'")
    doc = F.split_part("unit_id", F.lit(":"), F.lit(1)).cast("long")
    return decided.where(F.col("scope_id") == (doc % len(NAMES)).cast("string")).select(doc.alias("doc_id"), "state", "reason", "search_eligible")


QUERIES = {"decision_cases": q_decision_cases}

ORACLE_SQL = {
    "decision_cases": f"""SELECT doc_id, {listed([CASES[n][1][0] for n in NAMES], "VARCHAR")} AS state, {listed([CASES[n][1][1] for n in NAMES], "VARCHAR")} AS reason,
        {listed([CASES[n][1][2] for n in NAMES], "BOOLEAN")} AS search_eligible FROM documents""",
}
