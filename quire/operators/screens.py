"""Identity, screening and interpretation of single rows: ids, digests, flags, small grammars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import ids
from quire.functions import text as T

# The characters below which a page has little text, and how an owner's book names itself.
LOW_TEXT = 80
OWNER = r"\bowner(?:'s|s)?\s+(?:manual|guide)\b"
_KIND_LINES = ["Generic OBD notes", "Owners  guide", "Wiring Diagram", "Trouble code list", "Plain"]


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def evidence_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, line, statement) of every line that states what it applies to."""
    lines = docs.select(id_column, F.posexplode(F.split(text_column, "\n")).alias("line", "statement"))
    return lines.where(F.col("statement").rlike(T.EVIDENCE))


def triage(docs: DataFrame, has_image, text_column: str = "text", done=None, low: int = LOW_TEXT) -> DataFrame:
    """The rows with column ``action``: what a page needs before its text can be used."""
    visible = F.length(F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), r"\s+", ""))
    action = (
        F.when(done if done is not None else F.lit(False), "already_ocr")
        .when((visible == 0) & has_image, "auto_image_only")
        .when(visible == 0, "review_empty_without_image")
        .when((visible < low) & has_image, "review_low_text_with_image")
        .when(visible < low, "review_low_text")
        .otherwise("native_readable")
    )
    return docs.withColumn("action", action)


def title_kind(first_page):
    """struct(title, kind) of a publication by the lines of its first page."""
    lines = F.filter(F.transform(F.split(first_page, "\n"), lambda line: F.trim(line)), lambda line: line != "")
    title = F.coalesce(F.nullif(F.substring(F.array_join(F.slice(lines, 1, 4), " / "), 1, 500), F.lit("")), F.lit("Untitled PDF publication"))
    head = F.lower(F.array_join(F.slice(lines, 1, 30), "\n"))
    kind = (
        F.when(head.rlike(OWNER), "owner")
        .when(head.contains("generic") & (head.contains("code") | head.contains("obd")), "reference")
        .when(head.contains("wiring diagram"), "wiring")
        .when(head.contains("trouble code") | head.contains("diagnostic"), "diagnostics")
        .otherwise("unknown")
    )
    return F.struct(title.alias("title"), kind.alias("kind"))


def part_mentions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, line, identifier) of part identifiers that occur once in their document."""
    lines = docs.select(id_column, F.posexplode(F.split(text_column, "\n")).alias("line", "statement"))
    found = lines.select(id_column, "line", F.explode(T.identifiers(F.col("statement"))).alias("identifier"))
    sizes = found.groupBy(id_column, "identifier").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return sizes.where("n = 1").select(id_column, "line", "identifier")


def native_lines(docs: DataFrame, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, line, label, raw) of lines that match a measurement pattern with two groups as a whole."""
    lines = docs.select(id_column, F.posexplode(F.split(text_column, "\n")).alias("line", "statement"))
    whole = f"^(?:{pattern})$"
    return lines.where(F.col("statement").rlike(whole)).select(
        id_column, "line", F.regexp_extract("statement", whole, 1).alias("label"), F.regexp_extract("statement", whole, 2).alias("raw")
    )


DECISION = r"^\s*(\d+)\.\s+([^?]+\?)\s+If yes,\s*(.+?)\.?\s+If no,\s*(.+?)\.?\s*$"


def native_decisions(lines: DataFrame, column: str = "statement") -> DataFrame:
    """Numbered questions with a yes and a no branch, as rows of four columns more."""
    part = lambda k: F.regexp_extract(column, DECISION, k)
    return lines.where(F.col(column).rlike(DECISION)).select(
        "*", part(1).cast("int").alias("number"), part(2).alias("question"), part(3).alias("if_yes"), part(4).alias("if_no")
    )


# Fixed value: words that send a reader on from a branch.
CONTINUES = r"(?i)\b(?:go\s+to|proceed|repeat|refer\s+to|next\s+step|see\s+)"


def continuations(decisions: DataFrame) -> DataFrame:
    """(decision_id, record_id, label, text, state): branches that only send a reader on, none of them followed."""
    edges = decision_graph(decisions)[1]
    return edges.where(~F.col("complete")).select(F.col("from_id").alias("decision_id"), F.col("to_id").alias("record_id"), "label", "text", F.lit("unresolved").alias("state"))


def decision_graph(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (record_id, kind, label, complete) and edges (from_id, to_id, label, text, complete) of two-way decisions.

    A branch that sends a reader on is an outcome that isn't complete, and so is
    the decision that it belongs to.
    """
    key = ids.stable_id("dec", F.col("number"), F.col("question"))
    arms = F.explode(F.array(F.struct(F.lit("yes").alias("label"), F.col("if_yes").alias("text")), F.struct(F.lit("no").alias("label"), F.col("if_no").alias("text"))))
    made = decisions.select(key.alias("from_id"), "question", arms.alias("arm"))
    target = ids.stable_id("out", F.col("from_id"), F.col("arm.label"), F.col("arm.text"))
    whole = ~F.col("arm.text").rlike(CONTINUES)
    edges = made.select("from_id", target.alias("to_id"), F.col("arm.label").alias("label"), F.col("arm.text").alias("text"), whole.alias("complete"))
    nodes = made.groupBy(F.col("from_id").alias("record_id"), F.lit("decision").alias("kind"), F.col("question").alias("label")).agg(F.min(whole).alias("complete"))
    nodes = nodes.unionByName(edges.select(F.col("to_id").alias("record_id"), F.lit("outcome").alias("kind"), F.col("text").alias("label"), "complete"))
    return nodes, edges


# ---------------------------------------------------------------- queries


def q_stable_ids(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", ids.stable_id("doc", F.col("source"), F.col("doc_id")).alias("stable_id"))


def q_text_digest(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", ids.digest(F.col("text")).alias("sha256"), F.length("text").cast("long").alias("chars"))


def q_compact(spark, sf_dir):
    """Texts with wide and unbreakable blanks at their ends."""
    return documents(spark, sf_dir).select("doc_id", F.md5(T.compact(F.concat(F.lit("\u2003"), "text", F.lit("\u00a0\x1cx\u3000")))).alias("compacted"))


def q_exclusion_flag(spark, sf_dir):
    ending = F.when(F.col("doc_id") % 3 == 0, F.lit(" not\n  for")).when(F.col("doc_id") % 3 == 1, F.lit(" exceptional")).otherwise("")
    return documents(spark, sf_dir).select("doc_id", F.concat("text", ending).rlike(T.EXCLUSION).alias("excludes"))


def q_evidence_lines(spark, sf_dir):
    found = evidence_lines(documents(spark, sf_dir))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), F.md5("statement").alias("statement"))


def _litres():
    rate = F.when(F.col("doc_id") % 3 == 0, F.lit(" oil consumption rate is not more than 0.95 liter (1 qt)")).otherwise(" or 0.95 liter")
    return F.concat("text", F.lit(" 5.0L"), F.when(F.col("doc_id") % 2 == 0, rate).otherwise(""))


def q_mixed_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", (F.size(T.litre_quantities(_litres())) > 1).alias("mixed"))


def q_low_text_triage(spark, sf_dir):
    """Texts, and made ones of just under and just the least length."""
    made = F.when(F.col("doc_id") % 4 == 1, F.repeat(F.lit("a "), 79)).when(F.col("doc_id") % 4 == 2, F.repeat(F.lit("a\n"), 80)).when(F.col("doc_id") % 4 == 3, " \t").otherwise(F.col("text"))
    docs = documents(spark, sf_dir).withColumn("text", made)
    return triage(docs, F.col("doc_id") % 3 == 0, done=F.col("doc_id") % 50 == 0).select("doc_id", "action")


def q_title_kind(spark, sf_dir):
    line = F.element_at(F.array(*[F.lit(x) for x in _KIND_LINES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", title_kind(F.concat(F.lit(" \n"), line, F.lit("\n"), "text")).alias("t")).select("doc_id", F.md5("t.title").alias("title"), "t.kind")


def q_model_years(spark, sf_dir):
    said = F.concat(F.lit("models "), 1990 + F.col("doc_id") % 30, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" - "), 1995 + F.col("doc_id") % 20)).otherwise(""))
    return documents(spark, sf_dir).select("doc_id", T.model_years(said).alias("y")).select("doc_id", "y.*")


def q_part_identifiers(spark, sf_dir):
    """Texts, and codes made from the row, so that some match."""
    docs = documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nAB"), F.col("doc_id") % 97 + 10, F.lit("-X9-"), F.col("doc_id") % 5 + 100, F.lit("\n-7")))
    return docs.select("doc_id", F.explode(T.identifiers(F.col("text"))).alias("identifier"))


def q_part_mentions(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("text", F.concat(F.lit("AB12-900\n"), "text", F.lit("\nAB12-"), F.col("doc_id") % 9 + 900))
    return part_mentions(docs).withColumn("line", F.col("line").cast("long"))


def q_native_lines(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nTorque: "), F.col("doc_id") % 90, F.lit(" Nm")))
    return native_lines(docs, r"([A-Z][a-z]+): ([0-9]+ Nm)").withColumn("line", F.col("line").cast("long"))


def q_native_decisions(spark, sf_dir):
    docs = documents(spark, sf_dir)
    said = F.concat(F.col("doc_id") % 12, F.lit(". Is step "), F.col("doc_id"), F.lit(" fine? If yes, go to "), F.col("source"), F.lit(". If no, stop."))
    return native_decisions(docs.select("doc_id", said.alias("statement"))).drop("statement")


def q_decision_graph(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.select((F.col("doc_id") % 12).alias("number"), F.concat(F.lit("Is "), F.col("source"), F.lit(" fine?")).alias("question"), F.col("lang").alias("if_yes"), F.when(F.col("doc_id") % 12 == 5, "Repeat the  step").otherwise("stop").alias("if_no")).distinct()
    shape = [F.count("*").alias("edges"), F.countDistinct("from_id").alias("decisions"), F.countDistinct("to_id").alias("outcomes"), F.count_if(~F.col("complete")).alias("unresolved")]
    return decision_graph(rows)[1].groupBy("label").agg(*shape)


def q_media_types(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat("url", F.element_at(F.array(*[F.lit(x) for x in (".html", ".PDF", "", ".svg", ".bin")]), (F.col("page_id") % 5 + 1).cast("int")))
    return pages.select("page_id", T.media_type(path).alias("media_type"))


QUERIES = {
    "stable_ids": q_stable_ids,
    "text_digest": q_text_digest,
    "whitespace_compact": q_compact,
    "exclusion_flag": q_exclusion_flag,
    "evidence_lines": q_evidence_lines,
    "mixed_text": q_mixed_text,
    "low_text_triage": q_low_text_triage,
    "title_kind": q_title_kind,
    "model_year_parse": q_model_years,
    "part_identifiers": q_part_identifiers,
    "part_mentions": q_part_mentions,
    "native_lines": q_native_lines,
    "native_decisions": q_native_decisions,
    "decision_graph": q_decision_graph,
    "media_types": q_media_types,
}

_LINES = "(SELECT doc_id, unnest(string_split({}, chr(10))) AS statement, generate_subscripts(string_split({}, chr(10)), 1) - 1 AS line FROM documents)"
_IDS = "list_distinct(list_filter(list_transform(regexp_extract_all(upper({}), '[A-Z0-9-]+'), lambda r: regexp_extract(r, '(?:^|-)([A-Z0-9]{{4,}}-[A-Z0-9-]{{3,}})$', 1)), lambda r: r <> ''))"
_MENTION = "'AB12-900' || chr(10) || text || chr(10) || 'AB12-' || (doc_id % 9 + 900)"
_TORQUE = "text || chr(10) || 'Torque: ' || (doc_id % 90) || ' Nm'"
_YEARS = "'models ' || (1990 + doc_id % 30) || CASE WHEN doc_id % 2 = 0 THEN ' - ' || (1995 + doc_id % 20) ELSE '' END"

ORACLE_SQL = {
    "stable_ids": "SELECT doc_id, 'doc_' || substr(sha256('doc' || chr(0) || source || chr(0) || doc_id), 1, 32) AS stable_id FROM documents",
    "text_digest": "SELECT doc_id, sha256(text) AS sha256, length(text) AS chars FROM documents",
    "whitespace_compact": r"""SELECT doc_id, md5(trim(regexp_replace(chr(8195) || text || chr(160) || chr(28) || 'x' || chr(12288),
        '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))) AS compacted FROM documents""",
    "exclusion_flag": r"""SELECT doc_id, doc_id % 3 = 0 OR regexp_matches(text, '(?i)\b(except|excluding)\b') OR regexp_matches(text, '(?i)\bnot\s+for\b')
        OR regexp_matches(text, '(?i)\bdoes\s+not\s+apply\s+to\b') AS excludes FROM documents""",
    "evidence_lines": f"SELECT doc_id, line, md5(statement) AS statement FROM {_LINES.format('text', 'text')} WHERE regexp_matches(statement, '{T.EVIDENCE}')",
    "mixed_text": f"""SELECT doc_id, len(list_distinct(regexp_extract_all(regexp_replace(lower(text || ' 5.0L' || CASE WHEN doc_id % 6 = 0 THEN ' oil consumption rate is not more than 0.95 liter (1 qt)'
        WHEN doc_id % 2 = 0 THEN ' or 0.95 liter' ELSE '' END), '{T.OIL_RATE}', ' ', 'g'), '{T.LITRES}', 1))) > 1 AS mixed FROM documents""",
    "low_text_triage": r"""SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'already_ocr' WHEN n = 0 AND i THEN 'auto_image_only' WHEN n = 0 THEN 'review_empty_without_image'
        WHEN n < 80 AND i THEN 'review_low_text_with_image' WHEN n < 80 THEN 'review_low_text' ELSE 'native_readable' END AS action
        FROM (SELECT doc_id, doc_id % 3 = 0 AS i, CASE doc_id % 4 WHEN 1 THEN 79 WHEN 2 THEN 80 WHEN 3 THEN 0 ELSE length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) END AS n FROM documents)""",
    "title_kind": f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(' ' || chr(10) || {_KIND_LINES}[doc_id % 5 + 1] || chr(10) || text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
        h AS (SELECT doc_id, md5(substr(array_to_string(l[1:4], ' / '), 1, 500)) AS title, lower(array_to_string(l[1:30], chr(10))) AS h FROM l)
        SELECT doc_id, title, CASE WHEN regexp_matches(h, '{OWNER.replace("'", "''")}') THEN 'owner' WHEN contains(h, 'generic') AND (contains(h, 'code') OR contains(h, 'obd')) THEN 'reference'
        WHEN contains(h, 'wiring diagram') THEN 'wiring' WHEN contains(h, 'trouble code') OR contains(h, 'diagnostic') THEN 'diagnostics' ELSE 'unknown' END AS kind FROM h""",
    "model_year_parse": rf"""WITH s AS (SELECT doc_id, {_YEARS} AS t FROM documents), p AS (SELECT doc_id,
        regexp_extract(t, '\b((?:19|20)[0-9]{{2}})\s*[-–—]\s*((?:19|20)[0-9]{{2}})\b', 1) AS a,
        regexp_extract(t, '\b((?:19|20)[0-9]{{2}})\s*[-–—]\s*((?:19|20)[0-9]{{2}})\b', 2) AS b,
        list_distinct(regexp_extract_all(t, '\b((?:19|20)[0-9]{{2}})\b', 1)) AS l FROM s),
        q AS (SELECT *, CASE WHEN a <> '' AND a <= b THEN 'range' WHEN len(l) = 1 THEN 'exact' ELSE 'unknown' END AS state FROM p)
        SELECT doc_id, state, CASE WHEN state = 'exact' THEN CAST(l[1] AS INT) END AS value, CASE WHEN state = 'range' THEN CAST(a AS INT) END AS start,
        CASE WHEN state = 'range' THEN CAST(b AS INT) END AS "end" FROM q""",
    "part_identifiers": f"""SELECT doc_id, unnest({_IDS.format("text || chr(10) || 'AB' || (doc_id % 97 + 10) || '-X9-' || (doc_id % 5 + 100) || chr(10) || '-7'")}) AS identifier FROM documents""",
    "part_mentions": f"""WITH m AS (SELECT doc_id, line, unnest({_IDS.format('statement')}) AS identifier FROM {_LINES.format(_MENTION, _MENTION)})
        SELECT doc_id, min(line) AS line, identifier FROM m GROUP BY doc_id, identifier HAVING count(*) = 1""",
    "native_lines": f"""SELECT doc_id, line, regexp_extract(statement, '^([A-Z][a-z]+): ([0-9]+ Nm)$', 1) AS label, regexp_extract(statement, '^([A-Z][a-z]+): ([0-9]+ Nm)$', 2) AS raw
        FROM {_LINES.format(_TORQUE, _TORQUE)} WHERE regexp_matches(statement, '^([A-Z][a-z]+): ([0-9]+ Nm)$')""",
    "native_decisions": "SELECT doc_id, CAST(doc_id % 12 AS INT) AS number, 'Is step ' || doc_id || ' fine?' AS question, 'go to ' || source AS if_yes, 'stop' AS if_no FROM documents",
    "decision_graph": """WITH d AS (SELECT DISTINCT doc_id % 12 AS n, source, lang FROM documents)
        SELECT 'yes' AS label, count(*) AS edges, count(DISTINCT (n, source)) AS decisions, count(DISTINCT (n, source, lang)) AS outcomes, 0 AS unresolved FROM d
        UNION ALL SELECT 'no', count(*), count(DISTINCT (n, source)), count(DISTINCT (n, source)), count(*) FILTER (n = 5) FROM d""",
    "media_types": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' WHEN 3 THEN 'image/svg+xml' WHEN 2 THEN CASE WHEN regexp_matches(lower(url), '\\.html?$') THEN 'text/html' ELSE 'application/octet-stream' END ELSE 'application/octet-stream' END AS media_type FROM pages",
}
