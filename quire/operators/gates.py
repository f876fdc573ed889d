"""What may be read, and for which configurations: gates before extraction, and the envelope of what is read.

``vocabulary`` is that of ``quire.operators.interpret``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import ids
from quire.operators import matching
from quire.operators.interpret import interpret
from quire.plans.sizes import small

# Words that restrict a row to vehicles, words that say more than a fuel, and the fuels.
CUE = r"(?i)\b(?:[0-9]{1,2}(?:\.[0-9])?\s*L|VIN|RPO|Series|except|diesel|gasoline|CNG|(?:19|20)[0-9]{2})\b"
RICH_CUE = (
    r"(?i)\b(?:[0-9]{1,2}(?:\.[0-9])?\s*L|VIN|RPO|Series|(?:19|20)[0-9]{2}|not|non|never|except|exclud(?:e[ds]?|ing)|without|"
    r"other\s+than|unsupported|inapplicable|incompatible|prohibited)\b"
)
FUEL = r"(?i)\b(diesel|gasoline|CNG)\b"
POLICY = "quire-applicability-1"


def scope_gate(records: DataFrame, decisions: DataFrame, allow_unmapped: bool = False) -> DataFrame:
    """The records (record_id, unit_id, configuration_ids) that may be read, with ``refused``, null or a reason.

    Every configuration needs a confirmed decision (unit_id, configuration_id,
    state) on the record's own unit; a record of no configuration is read only
    where that is asked for.
    """
    confirmed = decisions.where("state = 'confirmed'").select(F.col("unit_id").alias("__unit"), F.col("configuration_id").alias("__configuration")).distinct()
    each = records.select("record_id", "unit_id", F.explode("configuration_ids").alias("configuration_id"))
    open_ = each.join(confirmed, (F.col("unit_id") == F.col("__unit")) & (F.col("configuration_id") == F.col("__configuration")), "left_anti")
    lost = open_.select(F.col("record_id").alias("__record")).distinct().withColumn("__open", F.lit(True))
    none = F.coalesce(F.size("configuration_ids") < 1, F.lit(True))
    refused = F.when(none & F.lit(not allow_unmapped), "no vehicle scope").when(F.col("__open"), "no confirmed decision on this unit and configuration")
    return records.join(lost, F.col("record_id") == F.col("__record"), "left").withColumn("refused", refused).drop("__record", "__open")


def row_scope(rows: DataFrame, vocabulary: dict[str, DataFrame]) -> DataFrame:
    """(id, kept): which of a row's configurations its own text leaves.

    ``rows`` has id, text and configuration_ids. A text without a word about
    vehicles leaves all; one that is read in full, those that it doesn't rule out;
    a single fuel with nothing else said, those of that fuel; any other, none.
    """
    said = interpret(rows.select("id", F.col("text").alias("statement"), F.lit(None).cast("struct<year:string,name:string,engine:string>").alias("structured")), vocabulary)
    fields = list(matching.FIELDS)
    binds = F.exists("alternatives", lambda a: F.exists(F.array(*[a[f]["state"] for f in fields]), lambda s: s != "unknown"))
    fuels = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(FUEL), F.lit(1)), F.lower))
    read = rows.join(said, "id").select(
        "id", "configuration_ids", "alternatives", "resolved", binds.alias("binds"), fuels.alias("fuels"), F.col("text").rlike(CUE).alias("cued"), F.col("text").rlike(RICH_CUE).alias("rich")
    )
    engines = vocabulary["engines"].select("engine_id", F.lower("fuel").alias("fuel"))
    held = small(vocabulary["configurations"].join(small(engines), "engine_id", "left"))
    each = read.select("*", F.posexplode("configuration_ids").alias("place", "configuration_id")).join(held, "configuration_id", "left")
    scope = {f: F.col(k) for f, k in matching.FIELDS.items()}
    fits = F.exists("alternatives", lambda a: matching.alternative(a, scope, F.col("qualifiers")).isNotNull())
    stays = (
        F.when(~F.col("binds") & ~F.col("cued"), True)
        .when(F.col("resolved") & ~F.col("binds") & (F.size("fuels") == 1) & ~F.col("rich"), F.array_contains("fuels", F.col("fuel")))
        .when(~F.col("resolved") | ~F.col("binds"), False)
        .otherwise(fits)
    )
    kept = each.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.coalesce(stays, F.lit(False)), F.struct("place", "configuration_id")))).alias("kept"))
    kept = kept.select("id", F.transform("kept", lambda k: k["configuration_id"]).alias("kept"))
    return rows.select("id").join(kept, "id", "left").select("id", F.coalesce("kept", F.array().cast("array<string>")).alias("kept"))


def envelope(rows: DataFrame, kind: str, revision: str, vocabulary_revision: str) -> DataFrame:
    """Rows as records of one kind, with an id made from all that they say.

    ``rows`` has binding struct<source_id,unit_id,provenance>, locator
    struct<kind,selector>, original_text, configuration_ids, conditions, context_ids,
    payload and missing (arrays of text but the payload); with anything missing a
    record is ambiguous, else complete.
    """
    state = F.when(F.size("missing") > 0, "ambiguous").otherwise("complete")
    shaped = rows.select(
        F.lit(kind).alias("type"),
        F.struct(F.col("binding.*"), F.lit(revision).alias("extraction_version")).alias("binding"),
        "locator",
        "original_text",
        F.struct(F.lit(vocabulary_revision).alias("vocabulary_revision"), F.lit(POLICY).alias("policy_version"), "configuration_ids").alias("applicability"),
        "conditions",
        "context_ids",
        "payload",
        F.struct(state.alias("state"), F.col("missing")).alias("completeness"),
    )
    said: Column = F.to_json(F.struct(*shaped.columns))
    return shaped.select(ids.stable_id("rec", said).alias("record_id"), "*")
