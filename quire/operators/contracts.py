"""Contracts of tables: closed fields, and rules whose violations are rows.

A contract is a schema that readers enforce (missing and unknown fields fail)
and a list of rules. Each rule is a DataFrame of violations, so a whole table is
checked in one pass a rule and every breach is reported, not only the first.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

# Enumerations and bounds of the contracts.
ROLES = ("procedure", "pdf_page", "navigation", "landing", "unavailable")
PROVENANCE = ("native", "ocr", "none")
STATUS = ("complete", "partial", "failed")
QUALIFIERS = ("transmission", "drivetrain", "vin", "rpo", "production_date", "market", "cab", "chassis", "fuel")
YEAR_FROM, YEAR_TO = 1886, 2100
STATES = ("unknown", "not_applicable", "exact", "all_in_scope", "range")


def read_closed(spark: SparkSession, path: str, schema: K.StructType) -> DataFrame:
    """JSON lines with exactly the fields of a schema: a row with others, or without one, is an error."""
    lines = spark.read.text(path)
    names = sorted(schema.fieldNames())
    keys = F.array_sort(F.json_object_keys("value"))
    wrong = F.coalesce(F.array_join(keys, ",") != ",".join(names), F.lit(True))
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("fields differ from the contract: "), F.substring("value", 1, 200)))).otherwise(row)
    return lines.where(F.trim("value") != "").select(checked.alias("r")).select("r.*")


def breaches(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule of a table that a row breaks; a rule is what must hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def repeated(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """(key, rule) of keys that more than one row has."""
    counted = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
    return counted.where("n > 1").select("key", F.lit(rule).alias("rule"))


def dangling(rows: DataFrame, key: str, reference: str, targets: DataFrame, target: str, rule: str) -> DataFrame:
    """(key, rule) of rows whose reference isn't null and names no target."""
    named = rows.where(F.col(reference).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(reference).alias("__ref"))
    return named.join(targets.select(F.col(target).alias("__ref")).distinct(), "__ref", "left_anti").select("key", F.lit(rule).alias("rule"))


def sha_shape(column: str) -> Column:
    return F.col(column).rlike("^[0-9a-f]{64}$")


def manifest_breaches(sources: DataFrame, publications: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """Breaches of a package's manifest: ids, enumerations, digests, uniqueness, targets of resolved links."""
    out = breaches(sources, "source_id", {"source status": F.col("status").isin(*STATUS), "source digest": sha_shape("sha256"), "partial has failures": (F.col("status") == "complete") | (F.size("failures") > 0)})
    out = out.unionByName(repeated(sources, "source_id", "source is repeated"))
    out = out.unionByName(dangling(publications, "publication_id", "source_id", sources, "source_id", "publication without source"))
    out = out.unionByName(repeated(documents, "document_id", "document is repeated"))
    out = out.unionByName(dangling(documents, "document_id", "publication_id", publications, "publication_id", "document without publication"))
    out = out.unionByName(breaches(documents, "document_id", {"text provenance": F.col("provenance").isin(*PROVENANCE), "text digest": (F.col("provenance") == "none") | sha_shape("text_sha256")}))
    return out.unionByName(dangling(links.where("status = 'resolved'"), "document_id", "target_id", documents, "document_id", "resolved link without target"))


def content_breaches(content: DataFrame) -> DataFrame:
    """Breaches of content records: role, eligibility, digest of the text."""
    eligible = (F.length("text") > 0) & F.col("role").isin("procedure", "pdf_page")
    return breaches(
        content,
        "document_id",
        {
            "role": F.col("role").isin(*ROLES),
            "search_eligible": F.col("search_eligible") == eligible,
            "text digest": F.sha2("text", 256) == F.col("text_sha256"),
            "spans": F.forall("nodes", lambda n: n["rowspan"].between(1, 1000) & n["colspan"].between(1, 1000)),
        },
    )


def inventory_breaches(members: DataFrame) -> DataFrame:
    """Breaches of an inventory: sizes, digests, page counts, repeated or unsafe paths."""
    from quire.functions.text import unsafe_path

    rules = {
        "size": F.col("size") >= 0,
        "digest": sha_shape("sha256"),
        "path": unsafe_path(F.col("path")).isNull(),
        "page count": F.col("page_count").isNull() | (F.col("page_count") >= 1),
    }
    return breaches(members, "path", rules).unionByName(repeated(members, "path", "path is repeated"))


def predicate_ok(p: Column) -> Column:
    """Whether a dimension predicate has the fields that its state needs, and no others."""
    bare = p["value"].isNull() & p["start"].isNull() & p["end"].isNull()
    return (
        F.when(p["state"].isin("unknown", "not_applicable", "all_in_scope"), bare)
        .when(p["state"] == "exact", p["value"].isNotNull() & p["start"].isNull() & p["end"].isNull())
        .when(p["state"] == "range", p["value"].isNull() & (p["start"] <= p["end"]) & (p["start"] >= YEAR_FROM) & (p["end"] <= YEAR_TO))
        .otherwise(F.lit(False))
    )


def vocabulary_breaches(makes: DataFrame, models: DataFrame, engines: DataFrame, configurations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Breaches of a vocabulary: keys, owners, years, qualifier names, alias targets and ambiguity."""
    from quire.operators.hierarchy import alias_conflicts

    targets = makes.select(F.col("make_id").alias("t")).unionByName(models.select(F.col("model_id").alias("t"))).unionByName(engines.select(F.col("engine_id").alias("t")))
    rules = {
        "year": F.col("model_year").between(YEAR_FROM, YEAR_TO),
        "qualifier name": F.forall(F.map_keys(F.coalesce("qualifiers", F.create_map().cast("map<string,string>"))), lambda k: k.isin(*QUALIFIERS)),
    }
    out = dangling(models, "model_id", "make_id", makes, "make_id", "model without make")
    for table, key in ((makes, "make_id"), (models, "model_id"), (engines, "engine_id"), (configurations, "configuration_id")):
        out = out.unionByName(repeated(table, key, f"{key} is repeated"))
    for table, key in ((makes, "make_id"), (models, "model_id"), (engines, "engine_id")):
        out = out.unionByName(dangling(configurations, "configuration_id", key, table, key, f"configuration without {key}"))
    out = out.unionByName(breaches(configurations, "configuration_id", rules))
    out = out.unionByName(dangling(aliases, "alias_id", "target_id", targets, "t", "alias without target"))
    clash = alias_conflicts(aliases).select(F.col("a").cast("string").alias("key"), F.lit("alias is ambiguous").alias("rule"))
    return out.unionByName(clash)


def evidence_breaches(units: DataFrame, assertions: DataFrame) -> DataFrame:
    """Breaches of evidence: parents in the same document, subjects, support of unread statements."""
    parents = units.select(F.col("unit_id").alias("__id"), F.col("document_id").alias("__document"))
    joined = units.where("parent_unit_id is not null").join(parents, F.col("parent_unit_id") == F.col("__id"), "left")
    out = joined.where("__document is null or __document <> document_id").select(F.col("unit_id").alias("key"), F.lit("parent is elsewhere").alias("rule"))
    subjects = units.select(F.col("unit_id").alias("s")).unionByName(units.select(F.col("document_id").alias("s"))).unionByName(units.select(F.col("publication_id").alias("s")))
    out = out.unionByName(dangling(assertions, "assertion_id", "subject_id", subjects, "s", "assertion without subject"))
    fields = ("make", "model", "year", "engine")
    shaped = F.forall("alternatives", lambda a: F.lit(True) if not fields else _all([predicate_ok(a[f]) for f in fields]))
    supported = (F.col("support") != "source_supported") | ((F.col("provenance") == "native") & F.col("derivation").isin("explicit_text", "explicit_structured"))
    return out.unionByName(breaches(assertions, "assertion_id", {"predicates": shaped, "support": supported, "has alternatives": F.size("alternatives") > 0}))


def _all(conditions: list[Column]) -> Column:
    found = conditions[0]
    for one in conditions[1:]:
        found = found & one
    return found


def scope_breaches(scopes: DataFrame, scope_units: DataFrame, units: DataFrame) -> DataFrame:
    """Breaches of published scopes: order of selections, browse-all, eligible units that are known and searchable."""
    ordered = (
        (F.col("model_id").isNull() | F.col("make_id").isNotNull())
        & (F.col("model_year").isNull() | F.col("model_id").isNotNull())
        & (F.col("engine_id").isNull() | F.col("model_year").isNotNull())
    )
    out = breaches(scopes, "scope_id", {"selection order": ordered, "browse-all selects nothing": ~F.col("browse_all") | F.col("make_id").isNull()})
    eligible = scope_units.where("eligible")
    out = out.unionByName(dangling(eligible, "scope_id", "unit_id", units, "unit_id", "eligible unit is unknown"))
    blank = scopes.where("make_id is null and not browse_all").select("scope_id")
    return out.unionByName(eligible.join(blank, "scope_id", "left_semi").select(F.col("scope_id").cast("string").alias("key"), F.lit("empty selection has rows").alias("rule")).distinct())


def record_breaches(records: DataFrame, texts: DataFrame, edges: DataFrame) -> DataFrame:
    """Breaches of extracted records: a quote stands once in its source, edges lead to records.

    ``records`` has record_id, unit_id, quote; ``texts`` has unit_id, text.
    """
    count = F.floor((F.length("text") - F.length(F.replace("text", F.col("quote"), F.lit("")))) / F.greatest(F.length("quote"), F.lit(1)))
    joined = records.join(texts, "unit_id", "left")
    out = breaches(joined, "record_id", {"quote stands once": (F.length("quote") > 0) & (count == 1)})
    out = out.unionByName(repeated(records, "record_id", "record is repeated"))
    for end in ("from_id", "to_id"):
        out = out.unionByName(dangling(edges, end, end, records, "record_id", f"{end} is unknown"))
    return out


# ---------------------------------------------------------------- JSON schemas


def schema_problem(value, rule: dict, schemas: dict, path: str = "$") -> str | None:
    """The first breach of a JSON Schema (the keywords that the contracts use), or None."""
    if "$ref" in rule:
        return schema_problem(value, schemas[rule["$ref"].rsplit("/", 1)[-1]], schemas, path)
    for part in rule.get("allOf", ()):
        if found := schema_problem(value, part, schemas, path):
            return found
    if "oneOf" in rule and sum(schema_problem(value, part, schemas, path) is None for part in rule["oneOf"]) != 1:
        return f"{path}: not exactly one form fits"
    if "const" in rule and (value != rule["const"] or type(value) is not type(rule["const"])):
        return f"{path}: is not {rule['const']!r}"
    if "enum" in rule and value not in rule["enum"]:
        return f"{path}: is none of the allowed values"
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    kind = rule.get("type")
    if kind in kinds and not isinstance(value, kinds[kind]):
        return f"{path}: is no {kind}"
    if kind in ("integer", "number"):
        # a boolean is no number, and neither are NaN and infinity
        if isinstance(value, bool) or not isinstance(value, int if kind == "integer" else (int, float)) or value != value or value in (float("inf"), float("-inf")):
            return f"{path}: is no {kind}"
        if value < rule.get("minimum", value) or value > rule.get("maximum", value):
            return f"{path}: is out of bounds"
    if isinstance(value, str):
        if len(value) < rule.get("minLength", 0) or ("pattern" in rule and not re.search(rule["pattern"], value)):
            return f"{path}: text has the wrong shape"
    if isinstance(value, list):
        if len(value) < rule.get("minItems", 0) or (rule.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value)):
            return f"{path}: items are too few or repeated"
        for k, item in enumerate(value):
            if "items" in rule and (found := schema_problem(item, rule["items"], schemas, f"{path}[{k}]")):
                return found
    if isinstance(value, dict):
        for name in rule.get("required", ()):
            if name not in value:
                return f"{path}: {name} is missing"
        known = rule.get("properties", {})
        if rule.get("additionalProperties") is False and set(value) - set(known):
            return f"{path}: has unknown fields"
        for name in known.keys() & value.keys():
            if found := schema_problem(value[name], known[name], schemas, f"{path}.{name}"):
                return found
    return None


def schema_check(schema: dict) -> Callable[[Column], Column]:
    """A function from a JSON text column to its first breach of a schema."""
    schemas = schema.get("$defs", {})

    @F.pandas_udf(K.StringType())
    def check(text: pd.Series) -> pd.Series:
        def one(said: str | None) -> str | None:
            try:
                value = json.loads(said or "")
            except ValueError:
                return "$: is no JSON"
            return schema_problem(value, schema, schemas)

        return text.map(one)

    return check


# What a command's record may say.
OPERATIONS, LEVELS = ("probe", "extract"), ("warning", "error")
KINDS = ("workshop", "wiring", "diagnostics", "owner", "reference", "unknown")


def operation_breaches(operations: DataFrame) -> DataFrame:
    """Breaches of the records that commands give of themselves.

    ``operations`` has operation_id, operation, ok, source_id, source_status,
    publications array<struct<publication_id,source_path,title,kind>>, output
    struct<manifest_path,files_written,bytes_written>, null for a probe, and
    diagnostics array<struct<level,code,message>>.
    """
    from quire.functions.ids import stable_id
    from quire.functions.text import path_problem

    wrote = F.col("output").isNotNull()
    filled = lambda text: F.length(F.trim(text)) > 0
    named = F.forall("publications", lambda p: F.coalesce(p["publication_id"] == stable_id("pub", F.col("source_id"), p["source_path"]), F.lit(False)))
    whole = (F.col("output.files_written") >= 0) & (F.col("output.bytes_written") >= 0) & path_problem(F.col("output.manifest_path")).isNull()
    failed = (F.col("source_status") == "failed") | F.exists("diagnostics", lambda d: d["level"] == "error")
    rules = {
        "operation": F.col("operation").isin(*OPERATIONS),
        "source status": F.col("source_status").isin(*STATUS),
        "publication id": named,
        "publication kind": F.forall("publications", lambda p: F.coalesce(p["kind"].isin(*KINDS) & filled(p["title"]), F.lit(False))),
        "output": F.when(F.col("operation") == "extract", F.coalesce(whole, F.lit(False))).otherwise(~wrote),
        "diagnostics": F.forall("diagnostics", lambda d: F.coalesce(d["level"].isin(*LEVELS) & filled(d["code"]) & filled(d["message"]), F.lit(False))),
        "ok": ~(F.col("ok") & failed) & F.col("ok").isNotNull(),
    }
    return breaches(operations, "operation_id", rules).unionByName(repeated(operations, "operation_id", "operation is repeated"))
