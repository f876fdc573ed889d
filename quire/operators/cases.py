"""Queries that hold single rules to hand-made cases.

Every document takes the case that its id names, so a query runs over the whole
table. The SQL beside it has the results that each case must give, written down
by hand from the rule, and so shares no expression with the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import gates, interpret, procedures
from quire.plans.sizes import dealt
from quire.sources import html


def pick(values: list) -> Column:
    """The value of each document's case."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))


def listed(values: list, kind: str) -> str:
    """The same in SQL."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int | float) else "'" + str(v).replace("'", "''") + "'"
    return f"CAST([{', '.join(map(show, values))}] AS {kind}[])[doc_id % {len(values)} + 1]"


def _documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# path, why it isn't safe to write, its portable spelling
PATHS = [
    ("a/b.html", None, "a/b.html"),
    ("pages\\100.html", "backslash", "pages/100.html"),
    ("../secret", "not canonical", None),
    ("a/../b", "not canonical", None),
    ("a/..", "not canonical", None),
    ("/absolute", "absolute", None),
    ("C:\\manuals\\one.html", "backslash", None),
    ("c:one.html", "absolute", None),
    ("//server/share", "absolute", None),
    ("\\\\server\\share", "backslash", None),
    ("a//b/./c", "not canonical", "a/b/c"),
    ("a/", "not canonical", "a"),
    (".", "not canonical", None),
    ("./.", "not canonical", None),
    ("", "empty", None),
    ("x/\u0001y", "control character", None),
    ("con.txt", None, "con.txt"),
    ("a\u007fb", None, "a\u007fb"),
    (".quire-manifest.json", "reserved", ".quire-manifest.json"),
    (".QUIRE-inventory.json", "reserved", ".QUIRE-inventory.json"),
    ("a/.quire-manifest.json", None, "a/.quire-manifest.json"),
    ("...", None, "..."),
    ("a/...b/.c", None, "a/...b/.c"),
    (None, "empty", None),
]

# text, unit of its column, least, most, unit shown
NUMBERS = [
    ("0", "V", 0.0, 0.0, "V"),
    ("-2--1", "V", -2.0, -1.0, "V"),
    (".001 to .002", "in", 0.001, 0.002, "in"),
    (" 5. ", "Hz", 5.0, 5.0, "Hz"),
    ("2-4", "DCV", 2.0, 4.0, "V"),
    ("+3 - 3.5", "G/S", 3.0, 3.5, "g/s"),
    ("10", "Nm", 10.0, 10.0, "N.m"),
    ("10", "N·m", 10.0, 10.0, "N.m"),
    ("10to12", "N.m", 10.0, 12.0, "N.m"),
    ("7", "lb-ft", 7.0, 7.0, "lb-ft"),
    ("4-2", "mm", None, None, None),
    ("2/4", "V", None, None, None),
    ("2e3", "Hz", None, None, None),
    ("?", "V", None, None, None),
    ("2", "guess", None, None, None),
    ("2", "psi", None, None, None),
    ("2", "", None, None, None),
    ("2", None, None, None, None),
    ("2 V", "V", None, None, None),
    (".", "V", None, None, None),
    ("1 2", "V", None, None, None),
    ("9" * 400, "V", None, None, None),
]

# words, whether they exclude something, whether they name several quantities of litres
WORDINGS = [
    ("fits all except diesel", True, False),
    ("Not\n  for 5.0L", True, False),
    ("does  not\tapply to 5.0L or 6.2L", True, True),
    ("EXCLUDING 6.0 liter", True, False),
    ("exceptional, notfor, not four", False, False),
    ("does not apply", False, False),
    ("5.0L and 5.0 litre", False, False),
    ("5.0L, 10.95 liter", False, True),
    ("1.5.0L, x6.2L, 3,6.4L", False, False),
    ("5.0L; oil consumption rate is not more than 0.95 liter (1 qt) per", False, False),
    ("5.0L; oil consumption higher than .95 l ( 1.0 quarts )", False, False),
    ("5.0L; oil consumption is more than 0.95 liter", False, True),
    ("5.0L; oil fill is 0.95 liter (1 qt)", False, True),
    ("5.0L; oil consumption rate is less than 0.95 liter (1 qt) or 6.2L", False, True),
]


# a vocabulary: two makes, three models, three engines
VOCABULARY = {
    "makes": ("make_id string, name string", [("mk1", "Alta"), ("mk2", "Borea")]),
    "models": ("model_id string, make_id string, name string", [("md1", "mk1", "Ridge"), ("md2", "mk1", "Ridge 1500"), ("md3", "mk2", "Cargo")]),
    "engines": (
        "engine_id string, name string, fuel string, displacement_l double",
        [("en1", "5.0L gasoline", "Gasoline", 5.0), ("en2", "6.0L diesel", "diesel", 6.0), ("en3", "6.0L gasoline", "gasoline", 6.0)],
    ),
    "configurations": (
        "configuration_id string, make_id string, model_id string, model_year int, engine_id string, qualifiers map<string,string>",
        [
            ("c1", "mk1", "md1", 2005, "en1", {"vin": "V"}),
            ("c2", "mk1", "md1", 2005, "en2", {"vin": "X", "drivetrain": "4wd"}),
            ("c3", "mk1", "md2", 2006, "en3", {}),
            ("c4", "mk2", "md3", 2003, "en2", {}),
            ("c5", "mk1", "md2", 2006, "en1", {}),
        ],
    ),
    "aliases": (
        "literal string, target_id string, year_start int, year_end int",
        [("Heavy Ridge", "md2", 2006, 2006), ("Altas", "mk1", None, None), ("Ridge", "md3", None, None)],
    ),
}

# statement, (year, name, engine) where it is structured, what it says, whether all was bound
STATEMENTS = [
    ("2005 Ridge 6.0L", None, "mk1/md1/2005/en2", True),
    ("2006 Alta Ridge 1500", None, "mk1/md2/2006/?", True),
    ("Copyright 2007", None, "?/?/?/?", True),
    ("2006 Alta Ridge 1500 6.0L diesel", None, "mk1/md2/2006/?", False),
    ("2006 Ridge 1500 and 2003 Cargo", None, "mk1/md2/?/?; mk2/md3/?/?", False),
    ("2005 Heavy Ridge", None, "mk1/md1/2005/?", True),
    ("2006 Heavy Ridge", None, "mk1/md2/2006/?", True),
    ("2003 \u2013 2006 Cargo", None, "mk2/md3/2003-2006/?", True),
    ("2006-2003 Cargo", None, "mk2/md3/?/?", True),
    ("2005 Borea Ridge", None, "?/?/?/?", False),
    ("Alta and Borea", None, "?/?/?/?", False),
    ("Borea trucks", None, "mk2/?/?/?", True),
    ("altas of 2005", None, "mk1/?/2005/?", True),
    ("see the drawing", ("2003", "Cargo", "6.0L"), "mk2/md3/2003/en2", True),
    ("see the drawing", ("2003", "Nobody", ""), "?/?/2003/?", False),
    ("see the drawing", ("2003", "Cargo", ""), "mk2/md3/2003/?", True),
    ("see the drawing", ("2003", "Cargo", "9.9L"), "mk2/md3/2003/?", False),
    ("see the drawing", ("2003", "Cargo", "other"), "mk2/md3/2003/?", False),
    ("see the drawing", ("03", "Cargo", "6.0L"), "mk2/md3/?/?", False),
    ("2005 Ridge 5.0L VIN V", None, "mk1/md1/2005/en1 vin=V", True),
    ("2005 Ridge 5.0L VIN code: v", None, "mk1/md1/2005/en1 vin=V", True),
    ("2005 Ridge 5.0L VIN Z", None, "mk1/md1/2005/en1 vin=?", False),
    ("2005 Ridge 6.0L VIN X or V", None, "mk1/md1/2005/en2 vin=?", False),
    ("2005 Ridge 6.0L VIN X/V", None, "mk1/md1/2005/en2 vin=?", False),
    ("2005 Ridge VIN V", None, "mk1/md1/2005/? vin=?", False),
    ("2005 Ridge 6.0L VIN X drivetrain: 4WD", None, "mk1/md1/2005/en2 drivetrain=4wd vin=X", True),
    ("2006 Ridge 1500 6.0 liter", None, "mk1/md2/2006/en3", True),
    ("2005 Ridge 5.0L 6.0L", None, "mk1/md1/2005/?", False),
    ("2005 Ridge 6.0L diesel, 5.0L gasoline", None, "mk1/md1/2005/?", False),
    ("2005 ridge\n  1500", None, "mk1/md2/2005/?", True),
    ("Ridgeline of model year 2005", None, "?/?/2005/?", True),
    ("", None, "?/?/?/?", True),
    (None, None, "?/?/?/?", True),
]

# a row's text, the configurations of c1, c2 and c3 that it leaves
ROW_TEXTS = [
    ("Pump flow", "c1,c2,c3"),
    ("Pump flow, diesel", "c2"),
    ("gasoline", "c1,c3"),
    ("not for diesel", ""),
    ("diesel and gasoline", ""),
    ("CNG", ""),
    ("Ridge", "c1,c2"),
    ("2005 Ridge 6.0L", "c2"),
    ("2006 Ridge 1500", "c3"),
    ("VIN X", ""),
    ("Cargo", ""),
    ("Borea", ""),
    ("E-Series only", ""),
    ("2005", ""),
    ("2005 Ridge 5.0L VIN V", "c1"),
    ("2005 Borea Ridge", ""),
    ("6.0L", ""),
]


# pages of ordered lists: markup, and (label, instruction, next label, missing, reason) of each row
STEP_PAGES = [
    ("<ol><li>One<li>Two</ol><p>between</p><ol start='3'><li>Three</ol>", [("1", "One", "2", "", None), ("2", "Two", "3", "", None), ("3", "Three", None, "", None)]),
    (
        "<ol><li>Do<ol type='a'><li>this<li>that</ol>now<li>Then</ol>",
        [(label, said, None, "steps inside steps need a review of their order", None) for label, said in (("1", "Do now"), ("1.a", "this"), ("1.b", "that"), ("2", "Then"))],
    ),
    ("<ol><li>If hot, stop<li>Wait</ol>", [("1", "If hot, stop", None, "a step is conditional or linked", None), ("2", "Wait", None, "a step is conditional or linked", None)]),
    (
        "<ol><li><a href='x.html'>Look</a><li><img src='a.png'>Turn</ol><ol><li>Next</ol>",
        [(label, said, None, "a step is conditional or linked; a step's figure has to be bound", None) for label, said in (("1", "Look"), ("2", "Turn"))] + [("1", "Next", None, "", None)],
    ),
    ("<ol start='2'><li>x</ol>", [(None, None, None, None, "printed numbers have a gap")]),
    ("<ol type='i'><li>x</ol>", [(None, None, None, None, "lists are too deep or numbered in several ways")]),
    ("<ol><li value='1'>a<li value='3'>b</ol>", [(None, None, None, None, "printed numbers have a gap, or a step is empty")]),
    ("<ol>loose<li>a</ol>", [(None, None, None, None, "list runs backward or holds more than its items")]),
    ("<ol reversed><li>a</ol>", [(None, None, None, None, "list runs backward or holds more than its items")]),
    ("<ol><li><ol><li>a</ol></ol>", [(None, None, None, None, "a step has nothing but steps of its own")]),
    ("<ul><li>a<ol><li>b</ol></ul><p>c", []),
]

_TABLE = (
    "<table><caption>Pressures</caption><tr><th rowspan=2>Item<th colspan=2>Reading<th rowspan=2>Unit<tr><th>Cold<th>Hot<tr><td>P1<td>1<td>2-4<td>V"
    "<tr><td>P2<td>?<td><td>V<tr><td>P3<td><td><td>V<tr><td>P4<td>5<td>6<td>psi<tr><td>P5<td>1<td>1<td>V<tr><td>P5<td>2<td>1<td>V</table>"
)
_NOTE = "<p>NOTE: Engine  off.</p>"
_LABELS = ("P1", "P2", "P3", "P4", "P5", "P6")
RECIPE = procedures.Recipe(
    "pressures", (("Item",), ("Reading", "Cold"), ("Reading", "Hot"), ("Unit",)), _LABELS, 3, ((1, "Cold"), (2, "Hot")), caption="Pressures", note="NOTE: Engine off.", conditions=("at rest",)
)
# pages of tables: markup, and (label, quantity, values, conditions, missing, reason) of each row
_READ = [
    ("P1", "voltage", "Cold: 1 V = 1.0..1.0 V; Hot: 2-4 V = 2.0..4.0 V", "Cold, Hot, at rest", "", None),
    ("P2", "voltage", "Cold: ? V", "Cold, at rest", "value or unit is empty; value or unit isn't plain under Cold", None),
    ("P3", None, None, None, None, "row has no value that can be read"),
    ("P4", "unknown original quantity", "Cold: 5 psi; Hot: 6 psi", "Cold, Hot, at rest", "value or unit isn't plain under Cold; value or unit isn't plain under Hot", None),
    ("P5", None, None, None, None, "row is absent or repeated"),
    ("P6", None, None, None, None, "row is absent or repeated"),
]


def _all(reason: str) -> list[tuple]:
    return [(label, None, None, None, None, reason) for label in _LABELS]


TABLE_PAGES = [
    (_NOTE + _TABLE, _READ),
    (_NOTE + "<div>words</div>" + _TABLE + "<table><tr><td>other</table>", _READ),
    (_TABLE, _all("what governs the table is ambiguous")),
    (_TABLE + _NOTE, _all("what governs the table is ambiguous")),
    (_NOTE + _NOTE + _TABLE, _all("what governs the table is ambiguous")),
    (_NOTE + "<table><tr><td>other</table>" + _TABLE, _all("what governs the table is ambiguous")),
    (_NOTE + _TABLE + _TABLE, _all("no table or several have these headers")),
    (_NOTE + _TABLE.replace("Hot", "Warm"), _all("no table or several have these headers")),
    (_NOTE + _TABLE.replace("<td>P4<td>5", "<td>P4"), _all("no table or several have these headers")),
    ("<p>nothing", _all("no table or several have these headers")),
]


def _pages(spark, sf_dir, cases: list) -> DataFrame:
    """(doc_id, nodes) of each document's case, read by the page parser."""
    rows = _documents(spark, sf_dir).select("doc_id", F.lit("p.html").alias("path"), pick([markup for markup, _ in cases]).cast("binary").alias("content"))
    return html.parse(rows).select("doc_id", "page.nodes")


def _rows_sql(cases: list, columns: str) -> str:
    """SQL for the rows of each document's case."""
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {', '.join(map(show, row))})" for k, (_, rows) in enumerate(cases) for row in rows)
    return f"SELECT doc_id, {columns} FROM documents JOIN (VALUES {rows}) v(k, {columns}) ON doc_id % {len(cases)} = k"


def q_page_steps(spark, sf_dir):
    steps = procedures.extract_steps(_pages(spark, sf_dir, STEP_PAGES))
    following = steps.select(F.col("doc_id").alias("of"), F.col("step_id").alias("id"), F.col("label").alias("next"))
    rows = steps.join(dealt(following), (F.col("doc_id") == F.col("of")) & (F.col("next_id") == F.col("id")), "left")
    return rows.select("doc_id", "label", "instruction", "next", F.array_join("missing", "; ").alias("missing"), "reason")


def q_specification_rows(spark, sf_dir):
    rows = procedures.specifications(_pages(spark, sf_dir, TABLE_PAGES), RECIPE)
    one = lambda v: F.concat(
        v["condition"], F.lit(": "), v["original_value"], F.lit(" "), v["original_unit"],
        F.coalesce(F.concat(F.lit(" = "), v["normalized"]["minimum"].cast("string"), F.lit(".."), v["normalized"]["maximum"].cast("string"), F.lit(" "), v["normalized"]["unit"]), F.lit("")),
    )
    shown = F.array_join(F.transform("values", one), "; ")
    return rows.select("doc_id", "label", "quantity", shown.alias("shown"), F.array_join("conditions", ", ").alias("conditions"), F.array_join("missing", "; ").alias("missing"), "reason")


def vocabulary(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in VOCABULARY.items()}


def q_statement_readings(spark, sf_dir):
    part = lambda k: pick([None if s[1] is None else s[1][k] for s in STATEMENTS]).cast("string")
    structured = F.when(part(1).isNotNull(), F.struct(part(0).alias("year"), part(1).alias("name"), part(2).alias("engine")))
    said = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), pick([s[0] for s in STATEMENTS]).alias("statement"), structured.alias("structured"))
    return interpret.interpret(said, vocabulary(spark)).select(F.col("id").alias("doc_id"), interpret.shown(F.col("alternatives")).alias("says"), "resolved")


def q_row_scopes(spark, sf_dir):
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), pick([t for t, _ in ROW_TEXTS]).alias("text"), F.array(F.lit("c1"), F.lit("c2"), F.lit("c3")).alias("configuration_ids"))
    return gates.row_scope(rows, vocabulary(spark)).select(F.col("id").alias("doc_id"), F.array_join("kept", ",").alias("kept"))


def q_scope_gate(spark, sf_dir):
    """Documents as records on the unit of their source, for two configurations, one or none; decisions by source."""
    docs = _documents(spark, sf_dir)
    unit = F.concat(F.lit("u"), F.col("doc_id") % 20)
    both = F.array(F.lit("c1"), F.lit("c2"))
    records = docs.select(F.col("doc_id").alias("record_id"), unit.alias("unit_id"), F.when(F.col("doc_id") % 3 == 0, both).when(F.col("doc_id") % 3 == 1, F.array(F.lit("c2"))).otherwise(F.array().cast("array<string>")).alias("configuration_ids"))
    at = F.col("id")
    decisions = spark.range(20).select(F.concat(F.lit("u"), at).alias("unit_id"), F.explode(both).alias("configuration_id"), "id")
    state = F.when((at % 5 == 0) | ((at % 4 == 0) & (F.col("configuration_id") == "c1")), "possible").otherwise("confirmed")
    return gates.scope_gate(records, decisions.select("unit_id", "configuration_id", state.alias("state"))).select(F.col("record_id").alias("doc_id"), "refused")


def q_path_safety(spark, sf_dir):
    path = pick([p for p, _, _ in PATHS])
    return _documents(spark, sf_dir).select("doc_id", T.unsafe_path(path).alias("reason"))


def q_canonical_paths(spark, sf_dir):
    path = pick([p for p, _, _ in PATHS])
    return _documents(spark, sf_dir).select("doc_id", T.canonical_path(path).alias("path"))


def q_numeric_range(spark, sf_dir):
    found = T.numeric_range(pick([n[0] for n in NUMBERS]), pick([n[1] for n in NUMBERS]))
    return _documents(spark, sf_dir).select("doc_id", found.alias("r")).select("doc_id", "r.minimum", "r.maximum", "r.unit")


def q_wordings(spark, sf_dir):
    said = pick([w for w, _, _ in WORDINGS])
    return _documents(spark, sf_dir).select("doc_id", said.rlike(T.EXCLUSION).alias("excludes"), (F.size(T.litre_quantities(said)) > 1).alias("mixed"))


QUERIES = {
    "path_safety": q_path_safety,
    "canonical_paths": q_canonical_paths,
    "numeric_range": q_numeric_range,
    "wordings": q_wordings,
    "statement_readings": q_statement_readings,
    "page_steps": q_page_steps,
    "specification_rows": q_specification_rows,
    "row_scopes": q_row_scopes,
    "scope_gate": q_scope_gate,
}

ORACLE_SQL = {
    "path_safety": f"SELECT doc_id, {listed([r for _, r, _ in PATHS], 'VARCHAR')} AS reason FROM documents",
    "canonical_paths": f"SELECT doc_id, {listed([c for _, _, c in PATHS], 'VARCHAR')} AS path FROM documents",
    "numeric_range": f"""SELECT doc_id, {listed([n[2] for n in NUMBERS], "DOUBLE")} AS minimum, {listed([n[3] for n in NUMBERS], "DOUBLE")} AS maximum,
        {listed([n[4] for n in NUMBERS], "VARCHAR")} AS unit FROM documents""",
    "wordings": f"SELECT doc_id, {listed([w[1] for w in WORDINGS], 'BOOLEAN')} AS excludes, {listed([w[2] for w in WORDINGS], 'BOOLEAN')} AS mixed FROM documents",
    "page_steps": _rows_sql(STEP_PAGES, "label, instruction, next, missing, reason"),
    "specification_rows": _rows_sql(TABLE_PAGES, "label, quantity, shown, conditions, missing, reason"),
    "statement_readings": f"SELECT doc_id, {listed([x[2] for x in STATEMENTS], 'VARCHAR')} AS says, {listed([x[3] for x in STATEMENTS], 'BOOLEAN')} AS resolved FROM documents",
    "row_scopes": f"SELECT doc_id, {listed([k for _, k in ROW_TEXTS], 'VARCHAR')} AS kept FROM documents",
    "scope_gate": """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'no vehicle scope' WHEN doc_id % 20 % 5 = 0 OR (doc_id % 3 = 0 AND doc_id % 20 % 4 = 0)
        THEN 'no confirmed decision on this unit and configuration' END AS refused FROM documents""",
}
