"""Review queues: leads between sources as proposals, in a fixed order and bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.matching import FIELDS
from quire.operators.relations import lead_members

MOST_PROPOSALS = 1000
# Which relation counts where two documents have several, and what a proposal of it says.
RELATIONS = {"same_text": "duplicate_content", "section_applies": "section_applies", "shared_part": "part_mentioned"}


def exact_configurations(assertions: DataFrame, configurations: DataFrame) -> DataFrame:
    """(subject_id, configuration_id) of assertions that name make, model, year and engine of a known configuration."""
    each = assertions.select("subject_id", F.explode("alternatives").alias("a"))
    whole = F.lit(True)
    for field in FIELDS:
        whole &= F.col(f"a.{field}.state") == "exact"
    named = each.where(whole).select("subject_id", *[F.col(f"a.{field}.value").alias(f"__{field}") for field in FIELDS])
    same = [F.col(f"__{field}") == F.col(key).cast("string") for field, key in FIELDS.items()]
    return named.join(configurations, same).select("subject_id", "configuration_id").distinct()


def proposals(units: DataFrame, assertions: DataFrame, configurations: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` proposals (source, unit_id, target_source, target_unit, relation, configuration_ids), in order of all but the last.

    ``units`` has source, unit_id, title and text. Both units need an assertion of
    their own, and the target's has to name a known configuration in full. A unit
    that has a target at all gives a proposal, so no more than ``limit`` units are
    ever paired, each with no more than ``limit`` targets of a relation and key.
    """
    if not 1 <= limit <= MOST_PROPOSALS:
        raise ValueError(f"limit is 1 to {MOST_PROPOSALS}")
    cited = units.join(assertions.select(F.col("subject_id").alias("__cited")).distinct(), F.col("unit_id") == F.col("__cited"), "left_semi")
    exact = exact_configurations(assertions, configurations)
    members = lead_members(cited, "source", "unit_id", "text", "title")
    reach = members.join(exact.select(F.col("subject_id").alias("__exact")).distinct(), F.col("unit_id") == F.col("__exact"), "left_semi")
    # a side's targets: those of the other side, or of its own where a relation has one side
    other = F.when(F.col("side") == "target", "mention").when(F.col("side") == "member", "member")
    targets = reach.select("relation", "key", other.alias("side"), F.col("source").alias("target_source"), F.col("unit_id").alias("target_unit")).where("side is not null")
    spans = targets.groupBy("relation", "key", "side").agg(F.min("target_source").alias("__low"), F.max("target_source").alias("__high"))
    asking = members.where("side <> 'target'").join(spans, ["relation", "key", "side"])
    asking = asking.where((F.col("source") != F.col("__low")) | (F.col("source") != F.col("__high"))).drop("__low", "__high")
    first = asking.select("source", "unit_id").distinct().orderBy("source", "unit_id").limit(limit)
    chosen = asking.join(F.broadcast(first), ["source", "unit_id"], "left_semi")  # limit units at most
    # of each source the first targets of a key are enough, and one more source than the unit's own
    near = F.row_number().over(Window.partitionBy("relation", "key", "side", "target_source").orderBy("target_unit"))
    few = targets.withColumn("__near", near).where(F.col("__near") <= limit).drop("__near")
    met = chosen.join(few, ["relation", "key", "side"]).where("source <> target_source")
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(RELATIONS) for x in (name, k)])
    pairs = met.groupBy("source", "unit_id", "target_source", "target_unit").agg(F.min_by("relation", F.element_at(rank, F.col("relation"))).alias("relation"))
    said = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    pairs = pairs.withColumn("relation", F.element_at(said, F.col("relation"))).orderBy("source", "unit_id", "target_source", "target_unit").limit(limit)
    named = exact.groupBy(F.col("subject_id").alias("__subject")).agg(F.array_sort(F.collect_set("configuration_id")).alias("configuration_ids"))
    return pairs.join(named, F.col("target_unit") == F.col("__subject")).drop("__subject").orderBy("source", "unit_id", "target_source", "target_unit")


# ---------------------------------------------------------------- queries

P = "struct<state:string,value:string,start:int,end:int>"


def q_lead_proposals(spark, sf_dir):
    """Documents as units with made part numbers, titles and mentions; two thirds are cited, half of all name a configuration."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.col("doc_id")
    part = F.when(key % 5 == 1, F.concat(F.lit("\nPART-"), key % 37 + 100)).otherwise("")
    mention = F.when(key % 4 == 3, F.concat(F.lit("\nRefer to  service NOTE "), key * 7 % 600, F.lit("."))).otherwise("")
    text = F.when(key % 13 == 0, F.lit("Notice: " + "this text is the same in several sources. " * 3)).otherwise(F.concat("text", part, mention))
    units = docs.select("source", key.alias("unit_id"), F.concat(F.lit("Service note "), key % 500).alias("title"), text.alias("text"))
    exact = lambda v: F.struct(F.lit("exact").alias("state"), v.alias("value"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")).cast(P)
    year = F.when(key % 2 == 0, F.lit("2005")).otherwise("1999")
    named = F.struct(exact(F.lit("mk")).alias("make"), exact(F.lit("md")).alias("model"), exact(year).alias("year"), exact((key % 7).cast("string")).alias("engine"))
    assertions = docs.where(key % 3 > 0).select(key.alias("subject_id"), F.array(named).alias("alternatives"))
    at = F.col("id")
    configurations = spark.range(7).select(F.concat(F.lit("c"), at).alias("configuration_id"), F.lit("mk").alias("make_id"), F.lit("md").alias("model_id"), F.lit(2005).alias("model_year"), at.cast("string").alias("engine_id"))
    return proposals(units, assertions, configurations, 300).select("source", "unit_id", "target_source", "target_unit", "relation", F.array_join("configuration_ids", ",").alias("configuration_ids"))


QUERIES = {"lead_proposals": q_lead_proposals}

ORACLE_SQL = {
    "lead_proposals": """WITH d AS (SELECT doc_id, source, 'service note ' || (doc_id % 500) AS title,
        CASE WHEN doc_id % 13 = 0 THEN 'Notice: ' || repeat('this text is the same in several sources. ', 3) ELSE text || CASE WHEN doc_id % 5 = 1 THEN chr(10) || 'PART-' || (doc_id % 37 + 100) ELSE '' END
          || CASE WHEN doc_id % 4 = 3 THEN chr(10) || 'Refer to  service NOTE ' || (doc_id * 7 % 600) || '.' ELSE '' END END AS text FROM documents WHERE doc_id % 3 > 0),
      k AS (SELECT 0 AS rank, sha256(text) AS key, source, doc_id FROM d WHERE length(text) >= 80 UNION ALL
        SELECT 2, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(upper(text), '[A-Z0-9-]+'), lambda r: regexp_extract(r, '(?:^|-)([A-Z0-9]{4,}-[A-Z0-9-]{3,})$', 1)), lambda r: r <> ''))), source, doc_id FROM d),
      m AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(text), '\\b(?:see|refer to)\\s+(service note [0-9]+)\\b', 1)) AS key FROM d),
      p AS (SELECT a.rank, a.source, a.doc_id AS unit_id, b.source AS target_source, b.doc_id AS target_unit FROM k a JOIN k b ON a.rank = b.rank AND a.key = b.key AND a.source <> b.source
        UNION ALL SELECT 1, m.source, m.doc_id, d.source, d.doc_id FROM m JOIN d ON title = key AND d.source <> m.source)
      SELECT source, unit_id, target_source, target_unit, ['duplicate_content', 'section_applies', 'part_mentioned'][min(rank) + 1] AS relation, 'c' || (target_unit % 7) AS configuration_ids
      FROM p WHERE target_unit % 2 = 0 GROUP BY ALL ORDER BY source, unit_id, target_source, target_unit LIMIT 300""",
}
