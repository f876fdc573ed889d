"""Contracts, review logs and discovery."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import types as K

from quire.operators import contracts as C
from quire.operators import reviewlog
from quire.sources import discover

SHA = "a" * 64


def rules(frame):
    return sorted((r["key"], r["rule"]) for r in frame.collect())


def test_closed_reading(spark, tmp_path):
    schema = K.StructType([K.StructField("a", K.LongType()), K.StructField("b", K.StringType())])
    (tmp_path / "good.json").write_text('{"a": 1, "b": "x"}\n\n{"b": null, "a": 2}\n')
    assert [tuple(r) for r in C.read_closed(spark, str(tmp_path / "good.json"), schema).collect()] == [(1, "x"), (2, None)]
    for k, bad in enumerate(('{"a": 1}', '{"a": 1, "b": "x", "c": 1}', '{"a": "x", "b": "x"}', "[1]")):
        (tmp_path / f"bad{k}.json").write_text(bad)
        with pytest.raises((PySparkException, Py4JJavaError)):
            C.read_closed(spark, str(tmp_path / f"bad{k}.json"), schema).collect()


def test_manifest(spark):
    sources = spark.createDataFrame([("s", "complete", SHA, []), ("t", "odd", "x", [])], "source_id string, status string, sha256 string, failures array<string>")
    publications = spark.createDataFrame([("p", "s"), ("q", "z")], "publication_id string, source_id string")
    documents = spark.createDataFrame([("d", "p", "native", SHA), ("d", "p", "none", None), ("e", "z", "guess", None)], "document_id string, publication_id string, provenance string, text_sha256 string")
    links = spark.createDataFrame([("d", "e", "resolved"), ("d", "gone", "resolved"), ("d", None, "missing")], "document_id string, target_id string, status string")
    assert rules(C.manifest_breaches(sources, publications, documents, links)) == [
        ("d", "document is repeated"), ("d", "resolved link without target"), ("e", "document without publication"), ("e", "text digest"), ("e", "text provenance"),
        ("q", "publication without source"), ("t", "partial has failures"), ("t", "source digest"), ("t", "source status"),
    ]


def test_inventory_and_content(spark):
    members = spark.createDataFrame([("a", 1, SHA, None), ("a", 1, SHA, 0), ("../b", -1, "x", 1)], "path string, size long, sha256 string, page_count int")
    assert rules(C.inventory_breaches(members)) == [("../b", "digest"), ("../b", "path"), ("../b", "size"), ("a", "page count"), ("a", "path is repeated")]
    import hashlib

    good = hashlib.sha256(b"t").hexdigest()
    content = spark.createDataFrame(
        [("x", "procedure", "t", good, True, [(1, 1)]), ("y", "navigation", "t", SHA, True, [(0, 1)]), ("z", "odd", "", hashlib.sha256(b"").hexdigest(), False, [])],
        "document_id string, role string, text string, text_sha256 string, search_eligible boolean, nodes array<struct<rowspan:int,colspan:int>>",
    )
    assert rules(C.content_breaches(content)) == [("y", "search_eligible"), ("y", "spans"), ("y", "text digest"), ("z", "role")]


def test_vocabulary(spark):
    frame = spark.createDataFrame
    makes, engines = frame([("k",)], "make_id string"), frame([("e",)], "engine_id string")
    models = frame([("m", "k"), ("n", "zz")], "model_id string, make_id string")
    configurations = frame([("c", "k", "m", 2000, "e", {"vin": "Z"}), ("c2", "k", "m", 1700, "zz", {"color": "red"})], "configuration_id string, make_id string, model_id string, model_year int, engine_id string, qualifiers map<string,string>")
    aliases = frame([(1, "x", "m", None, 1990, 2000), (2, "x", "n", "k", 2000, 2010), (3, "y", "gone", None, 1990, 1991)], "alias_id int, literal string, target_id string, make_id string, year_start int, year_end int")
    assert rules(C.vocabulary_breaches(makes, models, engines, configurations, aliases)) == [
        ("1", "alias is ambiguous"), ("3", "alias without target"), ("c2", "configuration without engine_id"), ("c2", "qualifier name"), ("c2", "year"), ("n", "model without make"),
    ]


def test_scopes_and_records(spark):
    scopes = spark.createDataFrame([("a", "k", None, None, None, False), ("b", None, "m", None, None, False), ("c", "k", None, None, None, True), ("d", None, None, None, None, False)], "scope_id string, make_id string, model_id string, model_year int, engine_id string, browse_all boolean")
    scope_units = spark.createDataFrame([("a", "u", True), ("a", "w", True), ("d", "u", True)], "scope_id string, unit_id string, eligible boolean")
    units = spark.createDataFrame([("u",)], "unit_id string")
    assert rules(C.scope_breaches(scopes, scope_units, units)) == [("a", "eligible unit is unknown"), ("b", "selection order"), ("c", "browse-all selects nothing"), ("d", "empty selection has rows")]
    records = spark.createDataFrame([("r", "u", "once"), ("s", "u", "twice"), ("t", "u", "absent")], "record_id string, unit_id string, quote string")
    texts = spark.createDataFrame([("u", "once twice twice")], "unit_id string, text string")
    edges = spark.createDataFrame([("r", "s"), ("r", "zz")], "from_id string, to_id string")
    assert rules(C.record_breaches(records, texts, edges)) == [("s", "quote stands once"), ("t", "quote stands once"), ("zz", "to_id is unknown")]


SCHEMA = {
    "type": "object", "required": ["n"], "additionalProperties": False,
    "properties": {"n": {"type": "integer", "minimum": 1}, "s": {"type": "string", "pattern": "^a", "minLength": 2}, "l": {"type": "array", "items": {"$ref": "#/$defs/x"}, "uniqueItems": True}, "o": {"oneOf": [{"const": 1}, {"enum": ["b"]}]}},
    "$defs": {"x": {"type": "number"}},
}


@pytest.mark.parametrize(("said", "fine"), [
    ('{"n": 1}', True), ('{"n": true}', False), ('{"n": 0}', False), ('{}', False), ('{"n": 1, "z": 1}', False), ('{"n": 1, "s": "ab"}', True), ('{"n": 1, "s": "b"}', False),
    ('{"n": 1, "l": [1, 2.5]}', True), ('{"n": 1, "l": [1, "x"]}', False), ('{"n": 1, "l": [1, 1]}', False), ('{"n": 1, "l": [NaN]}', False), ('{"n": 1, "o": "b"}', True), ('{"n": 1, "o": "c"}', False), ("no", False),
])
def test_json_schema(spark, said, fine):
    import json

    try:
        value = json.loads(said)
    except ValueError:
        assert not fine
        return
    assert (C.schema_problem(value, SCHEMA, SCHEMA["$defs"]) is None) == fine


def test_json_schema_column(spark):
    rows = spark.createDataFrame([('{"n": 1}',), ("no",), (None,)], "t string").select(C.schema_check(SCHEMA)("t").alias("p")).collect()
    assert [r["p"] for r in rows] == [None, "$: is no JSON", "$: is no JSON"]


def test_review_log(spark, tmp_path):
    path, day = str(tmp_path / "log"), dt.datetime(2024, 1, 1)
    at = reviewlog.revision(reviewlog.read(spark, path))
    first = reviewlog.event("k", "propose", day, "me", "seen", targets=["c"], bindings=["a1"], evidence_revision="r1")
    then = reviewlog.append(spark, path, [first], at)
    with pytest.raises(reviewlog.Moved):
        reviewlog.append(spark, path, [first], at)
    with pytest.raises(ValueError, match="earlier|transition|follow"):
        reviewlog.append(spark, path, [reviewlog.event("k", "revoke", day, "me", "no", first["event_id"])], then)
    accept = reviewlog.event("k", "accept", day + dt.timedelta(1), "me", "fine", first["event_id"], evidence_revision="r1")
    then = reviewlog.append(spark, path, [accept], then)
    with pytest.raises(ValueError):
        reviewlog.append(spark, path, [reviewlog.event("k", "reject", day + dt.timedelta(2), "me", "late", first["event_id"])], then)
    with pytest.raises(ValueError):
        reviewlog.event("k", "propose", day, " ", "x")
    log = reviewlog.read(spark, path)
    assert [r["action"] for r in log.orderBy("seq").collect()] == ["propose", "accept"]
    assert reviewlog.stale(log, "r2").where("stale").count() == 2
    kept = spark.createDataFrame([("a1",)], "assertion_id string")
    assert [r["evidence_revision"] for r in reviewlog.rebase(log, kept, "r2").collect()] == ["r2"]
    assert reviewlog.rebase(log, kept.where("false"), "r2").count() == 0
    # a writer that comes second finds the commit taken, and nothing of it is read
    spark.createDataFrame([], reviewlog.SCHEMA).write.parquet(f"{path}/events/late")
    with pytest.raises(reviewlog.Moved):
        reviewlog.commit(spark, path, 2, "late")
    assert reviewlog.revision(reviewlog.read(spark, path)) == then


def test_discovery(spark, tmp_path):
    from test_sources import pod2, verbatim

    for name in ("disc/content/en/A.ARC", "site/index.html", "site/pages/1.html", "empty/x.txt", "book.pdf", "notes.doc", "cd.iso"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(pod2([("A.TXT", verbatim(b"x")), ("B.TXT", b"cut off")])[:-1] if name.endswith("ARC") else b"%PDF-1")
    children = discover.listing(spark, str(tmp_path))
    held = spark.createDataFrame([(p.relative_to(tmp_path).parts[0], str(p.relative_to(tmp_path))) for p in tmp_path.rglob("*") if p.is_file()], "child string, path string")
    found = discover.routes(children, held)
    assert {r["name"]: r["route"] for r in found.collect()} == {"disc": "disc", "site": "folder", "empty": None, "book.pdf": "file", "notes.doc": None, "cd.iso": "disc"}
    assert {r["status"]: r["n"] for r in discover.counts(found).collect()} == {"recognized": 4, "partial": 0, "failed": 0, "unsupported": 2}
    probed = discover.probe(spark, str(tmp_path / "disc")).collect()
    assert [(r["entries"], r["checked"], r["failed"]) for r in probed] == [(2, 2, 1)]
    source = discover.inspect(spark, str(tmp_path / "site"))
    assert source.status == "complete" and source.publications.count() == 1
    discover.unpacked(spark, str(tmp_path / "disc"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("book = 'A' and name = 'A.TXT'").first()["content"] == b"x"


def test_operations(spark):
    from quire.functions import ids
    from quire.operators import contracts

    schema = (
        "operation_id string, operation string, ok boolean, source_id string, source_status string, publications array<struct<publication_id:string,source_path:string,title:string,kind:string>>, "
        "output struct<manifest_path:string,files_written:long,bytes_written:long>, diagnostics array<struct<level:string,code:string,message:string>>"
    )
    name = spark.range(1).select(ids.stable_id("pub", F.lit("s"), F.lit("a.pdf"))).first()[0]
    fine, out = [(name, "a.pdf", "A", "owner")], ("m.json", 1, 2)
    rows = [
        ("1", "probe", True, "s", "complete", fine, None, []),
        ("2", "extract", True, "s", "complete", fine, out, [("warning", "c", "m")]),
        ("3", "delete", True, "s", "complete", [], None, []),
        ("4", "probe", True, "s", "failed", [], None, []),
        ("5", "probe", False, "s", "failed", [], None, [("error", "c", "m")]),
        ("6", "probe", True, "s", "partial", [], out, []),
        ("7", "extract", False, "s", "complete", [], ("/m", 1, 2), []),
        ("8", "extract", False, "s", "complete", [], None, []),
        ("9", "probe", True, "s", "complete", [("pub_x", "a.pdf", "A", "owner"), (name, "a.pdf", " ", "novel")], None, [("note", "c", "")]),
    ]
    got = sorted((r["key"], r["rule"]) for r in contracts.operation_breaches(spark.createDataFrame(rows, schema)).collect())
    assert got == [
        ("3", "operation"), ("4", "ok"), ("6", "output"), ("7", "output"), ("8", "output"), ("9", "diagnostics"), ("9", "publication id"), ("9", "publication kind")
    ]
