"""Statements about applicability, read against a vocabulary, as correlated alternatives.

Tables of a vocabulary
----------------------
makes           make_id, name
models          model_id, make_id, name
engines         engine_id, name, fuel, displacement_l
configurations  configuration_id, make_id, model_id, model_year, engine_id,
                qualifiers map<string,string>
aliases         literal, target_id, year_start, year_end

Names are found by joins with the vocabulary (``quire.operators.dictionary``), which
may be of any size. All that follows is joins too: a model brings its make, a displacement becomes an
engine where model and year leave a single one, a tuple has to be a known
configuration, a qualifier's value has to be one of its values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.dictionary import mentions
from quire.operators.matching import ALTERNATIVES, PREDICATE
from quire.plans.sizes import small

# Qualifiers that any vocabulary may name, and words that make a qualifier more than a value.
QUALIFIERS = ("vin", "rpo", "transmission", "drivetrain", "body", "wheelbase")
COMPLEX = r"(?i)\b(?:except|excluding|not|through|thru|before|after|and|or)\b"
DISPLACEMENT = r"(?i)\b([0-9]{1,2}(?:\.[0-9])?)\s*(?:l\b|liter\b|litre\b)"


def names_of(vocabulary: dict[str, DataFrame]) -> DataFrame:
    """(kind, target_id, literal, year_start, year_end, ord) of a vocabulary; own names count before aliases."""
    none, rows = F.lit(None).cast("int"), None
    for kind in ("make", "model", "engine"):
        entities = vocabulary[f"{kind}s"]
        own = entities.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("target_id"), F.col("name").alias("literal"), none.alias("year_start"), none.alias("year_end"), F.lit(0).alias("ord"))
        other = vocabulary["aliases"].join(entities.select(F.col(f"{kind}_id").alias("target_id")), "target_id")
        own = own.unionByName(other.select(F.lit(kind).alias("kind"), "target_id", "literal", "year_start", "year_end", F.lit(1).alias("ord")))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def _p(state: str, value: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(state).alias("state"), (none if value is None else value).cast("string").alias("value"), none.cast("int").alias("start"), none.cast("int").alias("end"))


def _known(value: Column) -> Column:
    return F.when(value.isNotNull(), _p("exact", value)).otherwise(_p("unknown"))


def _years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)))


def _only(values: Column) -> Column:
    return F.when(F.size(values) == 1, F.try_element_at(values, F.lit(1)))


def _said(statements: DataFrame, names: DataFrame) -> DataFrame:
    """Each statement with the texts to read, the names found in them, its year and its displacements."""
    given = F.col("structured").isNotNull()
    part = lambda field: F.when(given, F.coalesce(F.col(f"structured.{field}"), F.lit(""))).otherwise(F.col("statement"))
    rows = statements.select("id", F.coalesce("statement", F.lit("")).alias("statement"), "structured").select(
        "id", "statement", given.alias("given"), part("name").alias("named"), part("engine").alias("engined"), part("year").alias("dated")
    )
    none = F.array().cast("array<string>")
    dated = _only(_years(F.col("dated"))).cast("int")
    found = mentions(rows.select("id", F.col("named").alias("statement"), dated.alias("year")), names.where("kind <> 'engine'"))
    sets = found.groupBy("id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("target_id")))).alias(f"{k}s") for k in ("make", "model")])
    rows = rows.join(sets, "id", "left").withColumn("makes", F.coalesce("makes", none)).withColumn("models", F.coalesce("models", none))
    read = T.model_years(F.col("statement"), (F.size("makes") > 0) | (F.size("models") > 0))
    exact = F.when(F.col("dated").rlike(r"^(?:19|20)[0-9]{2}$"), F.col("dated").cast("int"))
    year = F.when(F.col("given"), _known(exact)).otherwise(
        F.struct(read["state"].alias("state"), read["value"].cast("string").alias("value"), read["start"].alias("start"), read["end"].alias("end"))
    )
    rows = rows.withColumn("year", year).withColumn("year_value", F.when(F.col("year.state") == "exact", F.col("year.value").cast("int")))
    found = mentions(rows.select("id", F.col("engined").alias("statement"), F.col("year_value").alias("year")), names.where("kind = 'engine'"))
    sets = found.groupBy("id").agg(F.array_sort(F.collect_set("target_id")).alias("engines"))
    litres = F.array_distinct(F.regexp_extract_all("engined", F.lit(DISPLACEMENT), F.lit(1)).cast("array<double>"))
    return rows.join(sets, "id", "left").withColumn("engines", F.coalesce("engines", none)).withColumn("litres", litres)


def _tuples(said: DataFrame, vocabulary: dict[str, DataFrame]) -> DataFrame:
    """A row for each model that a statement names, else one: make_id, model_id, engine_id, and whether all was bound."""
    models = small(vocabulary["models"].select(F.col("model_id").alias("named_model"), F.col("make_id").alias("owner")))
    each = said.withColumn("named_model", F.explode_outer("models")).join(models, "named_model", "left")
    foreign = F.col("owner").isNotNull() & (F.size("makes") > 0) & ~F.array_contains("makes", F.col("owner"))
    each = each.withColumn("foreign", foreign).withColumn("make_id", F.coalesce("owner", _only(F.col("makes"))))

    known = vocabulary["configurations"].select("make_id", "model_id", "model_year", "engine_id").distinct()
    sized = known.join(small(vocabulary["engines"].select("engine_id", "displacement_l")), "engine_id")
    sized = sized.groupBy(F.col("model_id").alias("named_model"), F.col("model_year").alias("year_value"), F.col("displacement_l").alias("litre")).agg(F.collect_set("engine_id").alias("fitting"))
    each = each.withColumn("litre", _only(F.col("litres"))).join(small(sized), ["named_model", "year_value", "litre"], "left")
    open_ = F.col("litre").isNull() | F.col("named_model").isNull() | F.col("year_value").isNull()
    none = F.size("engines") == 0
    engine = F.when(~none, _only(F.col("engines"))).when(~open_, _only(F.col("fitting")))
    clear = F.when(~none, F.size("engines") == 1).when(open_, F.size("litres") == 0).otherwise(engine.isNotNull())
    each = each.withColumn("engine_id", engine).withColumn("clear", clear)

    held = known.select(*[F.col(c).alias(f"held_{c}") for c in known.columns]).withColumn("valid", F.lit(True))
    fits = [F.col("make_id") == F.col("held_make_id"), F.col("named_model") == F.col("held_model_id"), F.col("year_value") == F.col("held_model_year"), F.col("engine_id") == F.col("held_engine_id")]
    each = each.join(small(held), fits, "left")
    whole = F.col("make_id").isNotNull() & F.col("named_model").isNotNull() & F.col("year_value").isNotNull() & F.col("engine_id").isNotNull()
    wrong = whole & F.col("valid").isNull()
    return each.withColumn("wrong", wrong).withColumn("engine_id", F.when(~wrong, F.col("engine_id"))).withColumn("exact", whole & ~wrong)


def _qualified(each: DataFrame, vocabulary: dict[str, DataFrame]) -> DataFrame:
    """(id, named_model, qualifiers map<string,P>, open): qualifiers that a statement names, for each of its rows."""
    values = vocabulary["configurations"].select("make_id", "model_id", "model_year", "engine_id", F.explode("qualifiers").alias("name", "held")).distinct()
    # names of qualifiers are the vocabulary's schema: each becomes a pattern
    keys = sorted({*QUALIFIERS, *[r["name"] for r in values.select("name").distinct().collect()]})
    said = F.col("statement")

    def one(key: str) -> Column:
        word = rf"(?i)\b{re.escape(key)}\b"
        stated = rf"(?i)\b{re.escape(key)}\s*(?:code\s*)?[:=]?\s*(?>([A-Za-z0-9-]+)\b)"
        count = F.regexp_count(said, F.lit(word))
        more = said.rlike(COMPLEX) | (count != 1) | said.rlike(stated + r"\s*[/,&+]")
        return F.when(count > 0, F.struct(F.lit(key).alias("name"), F.lower(F.regexp_extract(said, stated, 1)).alias("raw"), more.alias("complex")))

    rows = each.select("id", "named_model", "make_id", "year_value", "engine_id", "exact", F.explode(F.array_compact(F.array(*map(one, keys)))).alias("q"))
    rows = rows.select("*", "q.*").drop("q")
    held = small(values.select(F.col("make_id").alias("h1"), F.col("model_id").alias("h2"), F.col("model_year").alias("h3"), F.col("engine_id").alias("h4"), F.col("name").alias("h5"), "held"))
    met = rows.join(
        held,
        [F.col("exact"), F.col("make_id") == F.col("h1"), F.col("named_model") == F.col("h2"), F.col("year_value") == F.col("h3"), F.col("engine_id") == F.col("h4"),
         F.col("name") == F.col("h5"), F.lower("held") == F.col("raw")],
        "left",
    )
    found = met.groupBy("id", "named_model", "name").agg(F.collect_set("held").alias("held"), F.max("complex").alias("complex"))
    value = F.when(~F.col("complex"), _only(F.col("held")))
    return found.groupBy("id", F.col("named_model").alias("of_model")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", _known(value).alias("p"))))).alias("qualifiers"), F.max(value.isNull()).alias("open")
    )


def interpret(statements: DataFrame, vocabulary: dict[str, DataFrame]) -> DataFrame:
    """(id, alternatives, resolved): what each statement says, and whether all that it names was bound.

    ``statements`` has id, statement and structured struct<year,name,engine>, null
    where the statement is prose. Several models are several alternatives, each
    with its own make; one whose make isn't among those that are named is left
    out. An engine is kept only in a tuple that is a known configuration. What
    can't be bound stays unknown and the statement isn't resolved.
    """
    each = _tuples(_said(statements, names_of(vocabulary)), vocabulary)
    each = each.join(_qualified(each, vocabulary).withColumnRenamed("id", "of_id"), (F.col("id") == F.col("of_id")) & F.col("named_model").eqNullSafe(F.col("of_model")), "left")
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{PREDICATE}>"))
    one = F.struct(
        _known(F.col("make_id")).alias("make"),
        _known(F.col("named_model")).alias("model"),
        F.col("year"),
        _known(F.col("engine_id")).alias("engine"),
        F.coalesce("qualifiers", nothing).alias("qualifiers"),
    )
    named = F.size("models") > 0
    empty_name = F.col("given") & (F.col("named") != "") & ~named
    bad = F.col("foreign") | ~F.col("clear") | F.col("wrong") | F.coalesce("open", F.lit(False)) | empty_name
    bad = bad | ((F.size("makes") > 1) & ~named) | (~F.col("given") & (F.size("models") > 1))
    kept = F.when(~F.col("foreign"), F.struct(F.col("named_model").alias("order"), one.alias("alternative")))
    # a map can't be sorted, so rows are put in order by their model alone
    by = lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)
    found = each.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(kept), by), lambda k: k["alternative"]).alias("alternatives"),
        F.max(bad).alias("bad"),
        F.max(F.col("given") & (F.col("engined") != "")).alias("engined"),
    )
    lacks = F.col("engined") & (F.try_element_at("alternatives", F.lit(1))["engine"]["state"] == "unknown")
    unknown = F.array(F.struct(*[_p("unknown").alias(k) for k in ("make", "model", "year", "engine")], nothing.alias("qualifiers")))
    empty = F.size("alternatives") == 0
    return found.select(
        "id",
        F.when(empty, unknown).otherwise(F.col("alternatives")).cast(ALTERNATIVES).alias("alternatives"),
        (~(F.col("bad") | empty | F.coalesce(lacks, F.lit(False)))).alias("resolved"),
    )


def shown(alternatives: Column) -> Column:
    """Alternatives as text: make/model/year/engine, then qualifiers; ? for what is unknown."""
    one = lambda p: F.when(p["state"] == "exact", p["value"]).when(p["state"] == "range", F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string"))).otherwise("?")

    def line(a):
        extra = F.transform(F.array_sort(F.map_keys(a["qualifiers"])), lambda k: F.concat(F.lit(" "), k, F.lit("="), one(F.element_at(a["qualifiers"], k))))
        return F.concat(F.concat_ws("/", one(a["make"]), one(a["model"]), one(a["year"]), one(a["engine"])), F.array_join(extra, ""))

    return F.array_join(F.transform(alternatives, line), "; ")
