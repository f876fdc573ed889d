"""Evidence: units and assertions from page records, and the lookups around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ids
from quire.functions import text as T
from quire.operators.summaries import case_insensitive_paths


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(records: DataFrame) -> DataFrame:
    """One section (or page region) a document and one unit for each table or figure that states something.

    ``records`` has generation, document_id, page (0 for none), text, statements
    (array of statement, level, selector). Children are metadata only.
    """
    selector = F.when(F.col("page") > 0, F.concat(F.lit("page:"), F.col("page").cast("string"))).otherwise("document")
    kind = F.when(F.col("page") > 0, "region").otherwise("section")
    mixed = F.size(T.litre_quantities(F.col("text"))) > 1
    parent_id = ids.stable_id("unit", F.col("generation"), F.col("document_id"), kind, selector)
    rows = records.select("document_id", "generation", parent_id.alias("unit_id"), kind.alias("kind"), selector.alias("selector"), mixed.alias("mixed"), (F.length("text") > 0).alias("__text"), "statements")
    state = F.when(F.col("__text") & ~F.col("mixed"), "whole").otherwise("metadata_only")
    parents = rows.select("unit_id", "document_id", F.lit(None).cast("string").alias("parent_unit_id"), "kind", "selector", "mixed", state.alias("search_state"))
    below = rows.select("document_id", "generation", "mixed", F.col("unit_id").alias("parent_unit_id"), F.explode("statements").alias("s")).where("s.level in ('table', 'figure')")
    child = ids.stable_id("unit", F.col("generation"), F.col("document_id"), F.col("s.level"), F.col("s.selector"))
    children = below.select(child.alias("unit_id"), "document_id", "parent_unit_id", F.col("s.level").alias("kind"), F.col("s.selector").alias("selector"), "mixed", F.lit("metadata_only").alias("search_state"))
    return parents.unionByName(children.dropDuplicates(["unit_id"]))


def assertions(statements: DataFrame) -> DataFrame:
    """Assertions (one a distinct statement of a subject) with intent and support.

    ``statements`` has source_id, subject_id, statement, selector, derivation,
    provenance, resolved, bounded. Only native, explicit, fully read statements
    that name a model or an engine are supported by their source.
    """
    said = F.trim("statement")
    explicit = F.col("derivation").isin("explicit_structured", "explicit_text")
    support = F.when(F.col("resolved") & F.col("bounded") & (F.col("provenance") == "native") & explicit, "source_supported").otherwise("proposal")
    intent = F.when(said.rlike(T.EXCLUSION), "exclude").otherwise("include")
    key = ids.stable_id("ev", F.col("source_id"), F.col("subject_id"), said, F.coalesce("selector", F.lit("")), F.col("derivation"))
    rows = statements.where(F.length(said) > 0).withColumn("statement", said)
    return rows.select(key.alias("assertion_id"), "subject_id", "statement", "selector", "derivation", "provenance", intent.alias("intent"), support.alias("support")).dropDuplicates(["assertion_id"])


def unit_texts(units_: DataFrame, documents: DataFrame) -> DataFrame:
    """(unit_id, document_id, text) of searchable units; one unit with two texts is an error."""
    rows = units_.where("search_state <> 'metadata_only'").join(documents.select("document_id", "text"), "document_id")
    texts = rows.groupBy("unit_id").agg(F.min("document_id").alias("document_id"), F.min("text").alias("text"), F.max("text").alias("__other"))
    clash = F.when(F.col("text") != F.col("__other"), F.raise_error(F.concat(F.lit("unit has two texts: "), "unit_id"))).otherwise(F.col("text"))
    return texts.select("unit_id", "document_id", clash.alias("text"))


def cited_once(requests: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with the one document that has their keys; ``problem`` where there is none or several."""
    held = documents.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("document_id").alias("document_id"))
    rows = requests.join(held, keys, "left")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous")
    return rows.withColumn("problem", problem).withColumn("document_id", F.when(F.col("problem").isNull(), F.col("document_id"))).drop("__n")


def bind_ground_truth(gold: DataFrame, units_: DataFrame) -> DataFrame:
    """Authored rows bound to the one unit that their citation and kind name, with labels turned into record ids.

    ``gold`` has label, source_id, path, page (null for a page of HTML), type,
    original_text and refs (labels of other rows); ``units_`` has unit_id,
    source_id, path, page and kind. Gives label, record_id, unit_id, ref_ids and
    problem: no unit or several, a label that is repeated, or one that no row has.
    Nothing is inferred: a row with a problem has no ids.
    """
    kind = F.when(F.col("page").isNull(), "section").otherwise("region")
    at = [F.col("source_id"), F.col("path"), F.coalesce("page", F.lit(0)).alias("at")]
    asked = gold.select("*", kind.alias("kind"), F.coalesce("page", F.lit(0)).alias("at"))
    held = units_.select("unit_id", "kind", *at).groupBy("source_id", "path", "at", "kind").agg(F.count("*").alias("n"), F.min("unit_id").alias("unit_id"))
    rows = asked.join(held, ["source_id", "path", "at", "kind"], "left")
    again = gold.groupBy("label").agg((F.count("*") > 1).alias("again"))
    record = ids.stable_id("rec", F.col("type"), F.col("unit_id"), F.col("original_text"))
    rows = rows.join(again, "label").withColumn("record_id", F.when((F.col("n") == 1) & ~F.col("again"), record))
    named = rows.where("record_id is not null").select(F.col("label").alias("__ref"), F.col("record_id").alias("__id"))
    each = rows.select("label", F.posexplode("refs").alias("place", "ref")).join(named, F.col("ref") == F.col("__ref"), "left")
    refs = each.groupBy("label").agg(F.max(F.col("__id").isNull()).alias("open"), F.array_sort(F.collect_list(F.struct("place", "__id"))).alias("found"))
    rows = rows.join(refs, "label", "left")
    problem = (
        F.when(F.col("again"), "label is repeated").when(F.col("n").isNull(), "no unit").when(F.col("n") > 1, "several units").when(F.col("open"), "refers to what isn't bound")
    )
    fine = problem.isNull()
    none = F.array().cast("array<string>")
    return rows.select(
        "label",
        F.when(fine, F.col("record_id")).alias("record_id"),
        F.when(fine, F.col("unit_id")).alias("unit_id"),
        F.when(fine, F.coalesce(F.transform("found", lambda f: f["__id"]), none)).alias("ref_ids"),
        problem.alias("problem"),
    )


def reconcile(old: DataFrame, new: DataFrame, chain: list[list[str]]) -> DataFrame:
    """(old_id, new_id, step): old rows matched to new ones by the first key set of a chain that finds one."""
    left, found = old, None
    for step, keys in enumerate(chain):
        held = new.groupBy(*keys).agg(F.min("new_id").alias("new_id"))
        met = left.join(held, keys).select("old_id", "new_id", F.lit(step).alias("step"))
        found = met if found is None else found.unionByName(met)
        left = left.join(held, keys, "left_anti")
    return found.unionByName(left.select("old_id", F.lit(None).cast(new.schema["new_id"].dataType).alias("new_id"), F.lit(None).cast("int").alias("step")))


def choices(configurations: DataFrame, make=None, model=None, year=None, engine=None) -> DataFrame:
    """(field, value): what can still be chosen after a partial selection."""
    rows = configurations
    rows = rows.where(F.col("make_id") == make) if make is not None else rows
    models = rows.select(F.lit("model").alias("field"), F.col("model_id").cast("string").alias("value"))
    rows = rows.where(F.col("model_id") == model) if model is not None else rows
    years = rows.select(F.lit("year").alias("field"), F.col("model_year").cast("string").alias("value"))
    rows = rows.where(F.col("model_year") == year) if year is not None else rows.where("false")
    engines = rows.select(F.lit("engine").alias("field"), F.col("engine_id").cast("string").alias("value"))
    rows = rows.where(F.col("engine_id") == engine) if engine is not None else rows
    extra = rows.select(F.explode("qualifiers").alias("field", "value"))
    return models.unionByName(years).unionByName(engines).unionByName(extra).where("value is not null").distinct()


def prune(routes: DataFrame, eligible: DataFrame) -> DataFrame:
    """(path, eligible): navigation nodes that lead to an eligible document, and how many.

    ``routes`` has doc_id and labels; a node is a prefix of labels.
    """
    kept = routes.join(eligible.select("doc_id").distinct(), "doc_id", "left_semi")
    nodes = kept.select("doc_id", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("depth"))
    return nodes.groupBy(F.array_join(F.slice("labels", F.lit(1), F.col("depth")), "/").alias("path")).agg(F.count("*").alias("eligible"))


def continuation(links: DataFrame, record_units: DataFrame, decisions: DataFrame, records: DataFrame, quality: DataFrame) -> DataFrame:
    """(record_id, state, reason) of one hop: scope first, then the record, then its own quality."""
    located = links.select("record_id").distinct().join(record_units, "record_id", "left")
    confirmed = decisions.where("state = 'confirmed'").select("unit_id").distinct().withColumn("__scope", F.lit(True))
    held = records.groupBy("record_id").agg(F.count("*").alias("__n"), F.max("complete").alias("__complete"))
    fine = quality.where("approved").select("record_id").distinct().withColumn("__fine", F.lit(True))
    rows = located.join(confirmed, "unit_id", "left").join(held, "record_id", "left").join(fine, "record_id", "left")
    said = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    found = (
        F.when(F.col("unit_id").isNull(), said("unresolved", "no reviewed place"))
        .when(F.col("__scope").isNull(), said("withheld", "scope is not confirmed"))
        .when(F.coalesce("__n", F.lit(0)) != 1, said("unresolved", "record is missing or repeated"))
        .when(F.col("__fine").isNull() | ~F.col("__complete"), said("withheld", "quality is not approved or record is incomplete"))
        .otherwise(said("available", None))
    )
    return rows.select("record_id", found.alias("f")).select("record_id", "f.state", "f.reason")


def timestamp_problem(text):
    """Why a text isn't a timestamp with a zone, or null."""
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
    return (
        F.when(~text.rlike(shape), "not a timestamp")
        .when(~text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), "no zone")
        .when(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNull(), "no such day")
    )


def site_title(books: DataFrame, label: str = "") -> DataFrame:
    """(title): a library's name from the years and models of its books, else its label."""
    named = books.where("role in ('wsm', 'elb')")
    sums = named.agg(F.sort_array(F.collect_set("year")).alias("years"), F.sort_array(F.collect_set("model")).alias("models"))
    year = F.when(F.size("years") == 1, F.concat(F.element_at("years", 1).cast("string"), F.lit(" "))).otherwise("")
    fallback = f"{label} Service Information" if label and label != "(unlabelled)" else "Service Information"
    few = (F.size("models") > 0) & (F.size("models") <= 2)
    return sums.select(F.when(few, F.concat(year, F.array_join("models", " / "), F.lit(" Service Information"))).otherwise(F.lit(fallback)).alias("title"))


def book_type(files: DataFrame) -> DataFrame:
    """(book, type) by the names of a book's files (book, prefix, name, tps)."""
    name = F.upper("name")
    begins = lambda part: name.startswith(F.concat(F.upper("prefix"), F.lit(part)))
    flags = files.groupBy("book").agg(
        F.max(begins("CEL_") & name.endswith(".XML")).alias("cells"),
        F.max(name == F.concat(F.upper("prefix"), F.lit("LEFT.HTM"))).alias("left"),
        F.max(begins("G") & name.rlike(r"G[0-9]+L\.HTM$")).alias("groups"),
        F.max("tps").alias("tps"),
    )
    kind = F.when(F.col("cells"), "EVTM").when(F.col("left") & F.col("groups"), "SERVICE").when(F.col("tps"), "PCED").otherwise("")
    return flags.select("book", kind.alias("type"))


def misses(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources whose id and code revision the cache doesn't hold: what has to be built."""
    return sources.join(cache, ["source_id", "revision"], "left_anti")


# ---------------------------------------------------------------- queries


def _records(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    level = F.when(F.col("doc_id") % 4 == 0, "table").when(F.col("doc_id") % 4 == 1, "figure").otherwise("document")
    said = F.array(F.struct(F.concat(F.lit("only "), "lang").alias("statement"), level.alias("level"), F.lit("node:1").alias("selector")))
    return docs.select(F.lit("g").alias("generation"), F.col("doc_id").cast("string").alias("document_id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(0).alias("page"), "text", said.alias("statements"))


def q_units(spark, sf_dir):
    return units(_records(spark, sf_dir)).groupBy("kind", "search_state").agg(F.count("*").alias("units"), F.countDistinct("unit_id").alias("ids"), F.count("parent_unit_id").alias("children"))


def q_assertions(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    rows = docs.select(
        F.lit("s").alias("source_id"), F.col("source").alias("subject_id"), F.concat(F.lit(" "), "lang", F.when(F.col("doc_id") % 2 == 0, F.lit(" not for x")).otherwise("")).alias("statement"),
        F.lit(None).cast("string").alias("selector"), F.when(F.col("doc_id") % 3 == 0, "title_hint").otherwise("explicit_text").alias("derivation"), F.lit("native").alias("provenance"), F.lit(True).alias("resolved"), F.lit(True).alias("bounded"),
    )
    return assertions(rows).select("subject_id", "statement", "derivation", "intent", "support")


def q_unit_texts(spark, sf_dir):
    records = _records(spark, sf_dir)
    return unit_texts(units(records), records).select("document_id", F.md5("text").alias("text"))


def q_cited_once(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.md5("text").alias("locator"))
    asks = docs.select(F.col("document_id").alias("request"), F.when(F.col("document_id") % 9 == 0, F.lit("?")).otherwise(F.col("locator")).alias("locator"))
    return cited_once(asks, docs, ["locator"]).select("request", "document_id", "problem")


def q_reconcile(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    old = part.select(F.col("p_partkey").alias("old_id"), "p_brand", "p_type", "p_size")
    new = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("new_id"), "p_brand", "p_type", "p_size")
    return reconcile(old, new, [["p_brand", "p_type", "p_size"], ["p_brand", "p_type"], ["p_type", "p_size"]])


def q_choices(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("make_id"), F.col("p_type").alias("model_id"), (2000 + F.col("p_size") % 5).alias("model_year"), (F.col("p_partkey") % 4).cast("string").alias("engine_id"), F.create_map(F.lit("drive"), (F.col("p_partkey") % 3).cast("string")).alias("qualifiers"))
    first = part.agg(F.min("p_brand").alias("b")).first()["b"]
    return choices(rows, make=first)


def q_prune(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    routes = docs.select("doc_id", F.array("lang", "source").alias("labels"))
    return prune(routes, docs.where("doc_id % 7 = 0"))


def q_continuation(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    record_units = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("record_id"), F.col("source").alias("unit_id"))
    decisions = docs.select(F.col("source").alias("unit_id"), F.when(F.col("source") < "src15", "confirmed").otherwise("excluded").alias("state"))
    records = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("record_id"), (F.col("doc_id") % 11 > 0).alias("complete"))
    quality = docs.select(F.col("doc_id").alias("record_id"), (F.col("doc_id") % 2 == 0).alias("approved"))
    return continuation(docs.select(F.col("doc_id").alias("record_id")), record_units, decisions, records, quality)


def q_timestamps(spark, sf_dir):
    shapes = ["2024-02-30T10:00:00Z", "2024-02-29T10:00:00+02:00", "2024-02-29T10:00:00", "yesterday", "2024-13-01T00:00Z"]
    text = F.element_at(F.array(*[F.lit(s) for s in shapes]), (F.col("event_id") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", timestamp_problem(text).alias("problem"))


def q_book_type(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    name = F.element_at(F.array(*[F.lit(x) for x in ("slbcel_1.xml", "SLBLEFT.HTM", "SLBG12L.HTM", "A.HTM")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return book_type(part.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey") % 501).alias("book"), F.lit("SLB").alias("prefix"), name.alias("name"), (F.col("p_partkey") % 8 == 3).alias("tps")))


def q_cache_misses(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return misses(part.select(F.col("p_partkey").alias("source_id"), F.lit("r1").alias("revision")), part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("source_id"), F.when(F.col("p_partkey") % 2 == 0, "r1").otherwise("r0").alias("revision")))


def q_path_join(spark, sf_dir):
    """Links that differ from their file in case only."""
    part = load(spark, sf_dir, "part")
    links = part.select("p_partkey", F.lower("p_type").alias("link"))
    return case_insensitive_paths(links, part.select(F.col("p_type").alias("path")), "link").select("p_partkey", F.col("member").alias("path"))


QUERIES = {
    "evidence_units": q_units,
    "evidence_assertions": q_assertions,
    "unit_texts": q_unit_texts,
    "cited_once": q_cited_once,
    "reconcile": q_reconcile,
    "filter_choices": q_choices,
    "navigation_prune": q_prune,
    "continuation_states": q_continuation,
    "timestamp_check": q_timestamps,
    "book_type": q_book_type,
    "cache_misses": q_cache_misses,
    "case_insensitive_path_join": q_path_join,
}

_MIXED = f"len(list_distinct(regexp_extract_all(regexp_replace(lower(text), '{T.OIL_RATE}', ' ', 'g'), '{T.LITRES}', 1))) > 1"

ORACLE_SQL = {
    "evidence_units": f"""WITH u AS (SELECT CASE WHEN doc_id % 3 = 0 AND doc_id > 0 THEN 'region' ELSE 'section' END AS kind, CASE WHEN length(text) > 0 AND NOT ({_MIXED}) THEN 'whole' ELSE 'metadata_only' END AS search_state, 0 AS c FROM documents
        UNION ALL SELECT CASE doc_id % 4 WHEN 0 THEN 'table' ELSE 'figure' END, 'metadata_only', 1 FROM documents WHERE doc_id % 4 < 2)
      SELECT kind, search_state, count(*) AS units, count(*) AS ids, sum(c)::BIGINT AS children FROM u GROUP BY 1, 2""",
    "evidence_assertions": """SELECT DISTINCT source AS subject_id, lang || CASE WHEN doc_id % 2 = 0 THEN ' not for x' ELSE '' END AS statement, CASE WHEN doc_id % 3 = 0 THEN 'title_hint' ELSE 'explicit_text' END AS derivation,
      CASE WHEN doc_id % 2 = 0 THEN 'exclude' ELSE 'include' END AS intent, CASE WHEN doc_id % 3 = 0 THEN 'proposal' ELSE 'source_supported' END AS support FROM documents""",
    "unit_texts": f"SELECT doc_id::VARCHAR AS document_id, md5(text) AS text FROM documents WHERE length(text) > 0 AND NOT ({_MIXED})",
    "cited_once": """WITH h AS (SELECT text, count(*) AS n, min(doc_id) AS d FROM documents GROUP BY 1)
      SELECT doc_id AS request, CASE WHEN doc_id % 9 <> 0 AND n = 1 THEN d END AS document_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS problem FROM documents JOIN h USING (text)""",
    "reconcile": """WITH n AS (SELECT * FROM part WHERE p_partkey % 3 = 0), a AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS k FROM n GROUP BY ALL), b AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM n GROUP BY ALL), c AS (SELECT p_type, p_size, min(p_partkey) AS k FROM n GROUP BY ALL)
      SELECT p.p_partkey AS old_id, coalesce(a.k, b.k, c.k) AS new_id, CASE WHEN a.k IS NOT NULL THEN 0 WHEN b.k IS NOT NULL THEN 1 WHEN c.k IS NOT NULL THEN 2 END AS step
      FROM part p LEFT JOIN a USING (p_brand, p_type, p_size) LEFT JOIN b ON b.p_brand = p.p_brand AND b.p_type = p.p_type LEFT JOIN c ON c.p_type = p.p_type AND c.p_size = p.p_size""",
    "filter_choices": """WITH r AS (SELECT * FROM part WHERE p_brand = (SELECT min(p_brand) FROM part))
      SELECT DISTINCT 'model' AS field, p_type AS value FROM r UNION ALL SELECT DISTINCT 'year', (2000 + p_size % 5)::VARCHAR FROM r""",
    "navigation_prune": "WITH e AS (SELECT * FROM documents WHERE doc_id % 7 = 0) SELECT lang AS path, count(*) AS eligible FROM e GROUP BY 1 UNION ALL SELECT lang || '/' || source, count(*) FROM e GROUP BY 1",
    "continuation_states": """SELECT doc_id AS record_id, CASE WHEN doc_id % 5 = 0 THEN 'unresolved' WHEN source >= 'src15' THEN 'withheld' WHEN doc_id % 7 = 0 THEN 'unresolved' WHEN doc_id % 2 <> 0 OR doc_id % 11 = 0 THEN 'withheld' ELSE 'available' END AS state,
      CASE WHEN doc_id % 5 = 0 THEN 'no reviewed place' WHEN source >= 'src15' THEN 'scope is not confirmed' WHEN doc_id % 7 = 0 THEN 'record is missing or repeated' WHEN doc_id % 2 <> 0 OR doc_id % 11 = 0 THEN 'quality is not approved or record is incomplete' END AS reason FROM documents""",
    "timestamp_check": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'no such day' WHEN 2 THEN 'no zone' WHEN 3 THEN 'not a timestamp' WHEN 4 THEN 'no such day' END AS problem FROM events",
    "book_type": """WITH f AS (SELECT p_brand || '/' || (p_partkey % 501) AS book, bool_or(p_partkey % 4 = 0) AS c, bool_or(p_partkey % 4 = 1) AS l, bool_or(p_partkey % 4 = 2) AS g, bool_or(p_partkey % 8 = 3) AS t FROM part GROUP BY 1)
      SELECT book, CASE WHEN c THEN 'EVTM' WHEN l AND g THEN 'SERVICE' WHEN t THEN 'PCED' ELSE '' END AS type FROM f""",
    "cache_misses": "SELECT p_partkey AS source_id, 'r1' AS revision FROM part WHERE p_partkey % 6 <> 0",
    "case_insensitive_path_join": "SELECT p_partkey, min(p_type) OVER (PARTITION BY lower(p_type)) AS path FROM part",
}
