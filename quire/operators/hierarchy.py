"""Scopes, hierarchies and graphs: rollups, range joins, closures, completeness."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.fixpoint import reliable

#: Edges that a round follows, and rounds after which what was reached is written as one table.
HOPS, ROUNDS_APART = 4, 8


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scope_prefixes(configurations: DataFrame, levels: list[str]) -> DataFrame:
    """Every distinct prefix of the levels, from the first alone to all of them, with its depth."""
    rolled = configurations.rollup(*levels).agg(F.grouping_id().alias("__id"))
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin("__id"), F.lit("0"), F.lit("")))
    return rolled.where(F.col("__id") < (1 << len(levels)) - 1).select(*levels, depth.cast("int").alias("depth"))


def qualifier_subsets(names: list[str]) -> list[tuple[str, ...]]:
    """Subsets that are published: all of up to six names, else the single ones, all but one, and all."""
    names = sorted(names)
    sizes = range(1, len(names) + 1) if len(names) <= 6 else sorted({1, len(names) - 1, len(names)})
    return [chosen for size in sizes for chosen in combinations(names, size)]


def qualifier_cube(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of every published subset of qualifier values."""
    sets = [list(s) for s in qualifier_subsets(keys)]
    return rows.groupingSets(sets, *keys).agg(F.count("*").alias("n"))


def range_join(rows: DataFrame, ranges: DataFrame, value: str, start: str, end: str, width: int) -> DataFrame:
    """Rows with every range that holds their value, as an equi-join on buckets of ``width``.

    A range is listed in each bucket that it meets, so no row is compared with
    ranges far from it and nothing is a nested loop.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = ranges.withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    met = rows.withColumn("__bucket", bucket(value)).join(spread, "__bucket")
    return met.where(F.col(value).between(F.col(start), F.col(end))).drop("__bucket")


def range_summary(rows: DataFrame, ranges: DataFrame, key: str, value: str, start: str, end: str, width: int) -> DataFrame:
    """(key, n, first, last) of every range that holds a row: how many it holds, the least and the largest value.

    Rows of one value are folded first, so what meets a range are the values in it,
    however many rows have them.
    """
    values = rows.groupBy(value).agg(F.count("*").alias("__n"))
    met = range_join(values, ranges.select(key, start, end), value, start, end, width)
    return met.groupBy(key).agg(F.sum("__n").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"))


#: Years of an alias that are listed; one of more, or without a first or last year, meets all of its literal.
YEARS_LISTED = 64


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """(literal, a, b): aliases with one literal, overlapping years and makes, and different targets.

    Of two ranges that overlap one holds the other's first year, so an alias is listed
    under each of its years and meets those of its literal that begin there: aliases
    whose years are apart are never compared.
    """
    every = aliases.select("literal", "alias_id", "target_id", "make_id", "year_start", "year_end")
    known = F.coalesce(F.col("year_end") - F.col("year_start") < YEARS_LISTED, F.lit(False))
    fine = every.where("year_start IS NULL OR year_end IS NULL OR year_start <= year_end")  # others hold no year
    short, open_ = fine.where(known), fine.where(~known)
    makes = F.col("a.make_id").isNull() | F.col("b.make_id").isNull() | (F.col("a.make_id") == F.col("b.make_id"))
    differ = (F.col("a.target_id") != F.col("b.target_id")) & makes
    pair = ["literal", F.least("a.alias_id", "b.alias_id").alias("a"), F.greatest("a.alias_id", "b.alias_id").alias("b")]

    listed = short.withColumn("year", F.explode(F.sequence("year_start", "year_end")))
    begin = short.withColumn("year", F.col("year_start"))
    earlier = (F.col("a.year_start") < F.col("b.year_start")) | (F.col("a.alias_id") < F.col("b.alias_id"))
    near = listed.alias("a").join(begin.alias("b"), ["literal", "year"]).where((F.col("a.alias_id") != F.col("b.alias_id")) & earlier & differ).select(*pair)

    years = F.greatest("a.year_start", "b.year_start") <= F.least("a.year_end", "b.year_end")
    sided = short.withColumn("open", F.lit(False)).unionByName(open_.withColumn("open", F.lit(True)))
    once = F.when(F.col("b.open"), F.col("a.alias_id") < F.col("b.alias_id")).otherwise(F.col("a.alias_id") != F.col("b.alias_id"))
    wide = open_.alias("a").join(sided.alias("b"), "literal").where(once & years & differ).select(*pair)
    return near.unionByName(wide)


def best_configuration(selections: DataFrame, configurations: DataFrame, keys: list[str], qualifiers: list[str]) -> DataFrame:
    """(selection_id, configuration_id): the compatible configuration that names most qualifiers.

    A null qualifier of a configuration says nothing; one that is named has to be
    the selection's.
    """
    # of configurations alike only the smallest can win, so a group's rows are never paired with each other
    alike = configurations.groupBy(*keys, *qualifiers).agg(F.min("configuration_id").alias("configuration_id"))
    met = selections.alias("s").join(alike.alias("c"), keys)
    fits = reduce(lambda a, b: a & b, [F.col(f"c.{q}").isNull() | F.col(f"c.{q}").eqNullSafe(F.col(f"s.{q}")) for q in qualifiers])
    named = reduce(lambda a, b: a + b, [F.col(f"c.{q}").isNotNull().cast("int") for q in qualifiers])
    best = F.max_by(F.col("c.configuration_id"), F.struct(named, -F.col("c.configuration_id")))
    return met.where(fits).groupBy("s.selection_id").agg(best.alias("configuration_id"))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): all nodes that each start reaches over edges (source, target), itself included.

    Where every node has one target at most, as parents are, jumps of doubled
    length reach them in a logarithm of the depth. Other graphs have too many
    walks for that; they are walked frontier by frontier, ``HOPS`` edges a round,
    until nothing is new, however deep they are. Rounds are checkpoints, so a lost
    executor repeats one; cycles end, since only what is new goes on.
    """
    edges = reliable(edges.select("source", "target").distinct())
    reached = reliable(starts.select(F.col("node").alias("start"), "node").distinct())
    jumps = edges.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    frontier, number = reached, 0
    while True:
        step = hop = frontier
        for k in range(1 if jumps else HOPS):
            hop = hop.join(edges, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
            step = hop if not k else step.unionByName(hop)
        fresh = reliable(step.distinct().join(reached, ["start", "node"], "left_anti"))
        if fresh.isEmpty():
            return reached
        reached, number = reached.unionByName(fresh), number + 1
        if jumps:
            # all that was reached jumps, as far again as it is deep
            reached = reliable(reached)
            further = edges.select(F.col("source").alias("middle"), F.col("target").alias("end"))
            edges = reliable(edges.join(further, F.col("target") == F.col("middle")).select("source", F.col("end").alias("target")))
            frontier = reached
        else:
            frontier = fresh
            if number % ROUNDS_APART == 0:
                reached = reliable(reached)


def can_finish(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """(node) from which a terminal can be reached; cycles with an exit count.

    Edges are followed backwards, ``HOPS`` a round. An edge whose source was reached
    is done with, so only the open ones go on: nothing new has to be told from all that
    was reached before, and a round costs what is still open, not the whole graph.
    """
    kinds = {edges.schema["source"].dataType, edges.schema["target"].dataType, terminals.schema["node"].dataType}
    same = lambda column: F.col(column).cast("string") if len(kinds) > 1 else F.col(column)
    fresh = reliable(terminals.select(same("node").alias("node")).where("node IS NOT NULL").distinct())
    ways = edges.select(same("source").alias("source"), same("target").alias("target")).where("source IS NOT NULL AND target IS NOT NULL").distinct()
    reached, number = fresh, 0
    done = lambda: ways.join(fresh, F.col("source") == F.col("node"), "left_anti")
    ways = reliable(done())
    while True:
        step = hop = fresh
        for k in range(HOPS):
            hop = ways.join(hop, F.col("target") == F.col("node")).select(F.col("source").alias("node")).distinct()
            step = hop if not k else step.unionByName(hop)
        fresh = reliable(step.distinct())
        if fresh.isEmpty():
            return reached.select(F.col("node").cast("string").alias("node"))
        reached, number = reached.unionByName(fresh), number + 1
        if number % ROUNDS_APART == 0:
            reached = reliable(reached)
        ways = reliable(done())


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, reason) of what keeps a diagnostic graph from being complete.

    ``nodes`` has node, kind (test, decision, outcome, step), labels (required
    branch labels), expected (whether a test states readings); ``edges`` has
    source, target, label.
    """
    out = edges.groupBy("source").agg(F.collect_list("label").alias("found"), F.count("*").alias("n"))
    rows = nodes.join(out, nodes["node"] == out["source"], "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    needed = F.array_distinct(F.coalesce("labels", F.array().cast("array<string>")))
    count = F.coalesce("n", F.lit(0))
    branches = (F.size(F.array_except(needed, found)) > 0) | (F.size(F.array_except(found, needed)) > 0) | (F.size(F.array_distinct(found)) < F.size(found))
    diagnostic = F.col("kind") != "step"
    rules = [
        (diagnostic & branches, "A required branch is missing or repeated"),
        ((F.col("kind") == "outcome") & ((count > 0) | (F.size(needed) > 0)), "An outcome has branches"),
        (diagnostic & (F.col("kind") != "outcome") & (count == 0), "A node that is no outcome has no branch"),
        ((F.col("kind") == "decision") & (F.size(needed) < 2), "A decision has fewer than two alternatives"),
        ((F.col("kind") == "test") & ~F.coalesce("expected", F.lit(False)), "A test states no readings"),
    ]
    said = F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))
    local = rows.select(F.col("node").cast("string").alias("node"), F.explode(said).alias("reason"))
    ends = rows.where(((F.col("kind") == "outcome") & (count == 0) & (F.size(needed) == 0)) | ((F.col("kind") == "step") & (count == 0)))
    stuck = nodes.select(F.col("node").cast("string").alias("node")).join(can_finish(edges, ends.select("node")), "node", "left_anti")
    return local.unionByName(stuck.select("node", F.lit("No terminal can be reached").alias("reason")))


# ---------------------------------------------------------------- queries


def q_scope_rollup(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customer.select(F.col("n_regionkey").alias("make"), F.col("n_nationkey").alias("model"), F.floor(F.col("c_acctbal") / 1000).cast("int").alias("year"), F.col("c_mktsegment").alias("engine"))
    return scope_prefixes(rows, ["make", "model", "year", "engine"])


def q_qualifier_cube(spark, sf_dir):
    return qualifier_cube(load(spark, sf_dir, "lineitem"), ["l_linestatus", "l_linenumber", "l_returnflag"])


def q_range_join(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("day"))
    ranges = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 3000).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + F.col("p_partkey") % 40)
    return range_summary(orders, ranges, "p_partkey", "day", "start", "end", 32).withColumnRenamed("n", "orders")


def q_alias_conflicts(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    aliases = part.select(
        F.col("p_partkey").alias("alias_id"), F.concat("p_brand", F.lit("/"), F.col("p_size") % 10).alias("literal"), F.col("p_type").alias("target_id"),
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 3).alias("make_id"), (1980 + F.col("p_partkey") % 40).alias("year_start"), (1983 + F.col("p_partkey") % 40).alias("year_end"),
    )
    return alias_conflicts(aliases)


def q_best_configuration(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    selections = part.select(F.col("p_partkey").alias("selection_id"), "p_brand", (F.col("p_size") % 5).alias("a"), (F.col("p_size") % 3).alias("b"))
    configurations = part.select(
        F.col("p_partkey").alias("configuration_id"), "p_brand", F.when(F.col("p_partkey") % 8 == 0, F.col("p_size") % 5).alias("a"), F.when(F.col("p_partkey") % 12 == 0, F.col("p_size") % 3).alias("b")
    )
    return best_configuration(selections, configurations, ["p_brand"], ["a", "b"])


def _tree(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    customer = load(spark, sf_dir, "customer")
    up = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    return up.unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target")))


def q_ancestor_closure(spark, sf_dir):
    edges = _tree(spark, sf_dir)
    starts = edges.where("source like 'c%'").select(F.col("source").alias("node"))
    return closure(edges, starts).groupBy("node").agg(F.count("*").alias("below"))


def q_order_closure(spark, sf_dir):
    up = load(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"))
    return closure(_tree(spark, sf_dir).unionByName(up), up.select(F.col("source").alias("node"))).groupBy("node").agg(F.count("*").alias("below"))


def _graph(spark, sf_dir):
    """Each order leads to two others by arithmetic, so there are chains and cycles."""
    keys = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    one = keys.where("k % 10 <> 0").select(F.col("k").alias("source"), (F.col("k") * 7 % 997).alias("target"), F.lit("yes").alias("label"))
    two = keys.where("k % 3 = 0").select(F.col("k").alias("source"), (F.col("k") - 3).alias("target"), F.lit("no").alias("label"))
    known = keys.select(F.col("k").alias("target"))
    return keys, one.unionByName(two).join(known, "target", "left_semi")


def q_reachability(spark, sf_dir):
    keys, edges = _graph(spark, sf_dir)
    return can_finish(edges, keys.where("k % 50 = 0").select(F.col("k").alias("node")))


def q_graph_problems(spark, sf_dir):
    keys, edges = _graph(spark, sf_dir)
    kind = F.when(F.col("k") % 50 == 0, "outcome").when(F.col("k") % 3 == 0, "decision").otherwise("test")
    labels = F.when(F.col("k") % 3 == 0, F.array(F.lit("yes"), F.lit("no"))).otherwise(F.array(F.lit("yes")))
    nodes = keys.select(F.col("k").alias("node"), kind.alias("kind"), F.when(kind == "outcome", F.array().cast("array<string>")).otherwise(labels).alias("labels"), (F.col("k") % 2 == 0).alias("expected"))
    return graph_problems(nodes, edges).groupBy("reason").agg(F.count("*").alias("nodes"))


QUERIES = {
    "scope_rollup": q_scope_rollup,
    "qualifier_cube": q_qualifier_cube,
    "range_predicate_join": q_range_join,
    "alias_conflicts": q_alias_conflicts,
    "config_best_match": q_best_configuration,
    "ancestor_closure": q_ancestor_closure,
    "order_closure": q_order_closure,
    "reachability": q_reachability,
    "graph_problems": q_graph_problems,
}

_EDGES = """RECURSIVE e AS (SELECT p_partkey AS source, p_partkey * 7 % 997 AS target, 'yes' AS label FROM part WHERE p_partkey % 10 <> 0
      UNION ALL SELECT p_partkey, p_partkey - 3, 'no' FROM part WHERE p_partkey % 3 = 0),
    g AS (SELECT e.* FROM e WHERE target IN (SELECT p_partkey FROM part)),"""

ORACLE_SQL = {
    "scope_rollup": """WITH r AS (SELECT n_regionkey AS make, n_nationkey AS model, CAST(floor(c_acctbal / 1000) AS INT) AS year, c_mktsegment AS engine FROM customer JOIN nation ON c_nationkey = n_nationkey)
      SELECT DISTINCT make, NULL::INT AS model, NULL::INT AS year, NULL::VARCHAR AS engine, 1 AS depth FROM r UNION ALL SELECT DISTINCT make, model, NULL, NULL, 2 FROM r
      UNION ALL SELECT DISTINCT make, model, year, NULL, 3 FROM r UNION ALL SELECT DISTINCT make, model, year, engine, 4 FROM r""",
    "qualifier_cube": "SELECT l_linestatus, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY CUBE (l_linestatus, l_linenumber, l_returnflag) HAVING GROUPING(l_linestatus, l_linenumber, l_returnflag) < 7",
    "range_predicate_join": """SELECT p_partkey, count(*) AS orders, min(day) AS first, max(day) AS last FROM (SELECT o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)
      JOIN (SELECT p_partkey, p_partkey * 37 % 3000 AS s, p_partkey * 37 % 3000 + p_partkey % 40 AS t FROM part) ON day BETWEEN s AND t GROUP BY 1""",
    "alias_conflicts": """WITH a AS (SELECT p_partkey AS id, p_brand || '/' || (p_size % 10) AS literal, p_type AS target, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 END AS make, 1980 + p_partkey % 40 AS y FROM part)
      SELECT x.literal, x.id AS a, z.id AS b FROM a x JOIN a z USING (literal) WHERE x.id < z.id AND x.target <> z.target AND abs(x.y - z.y) <= 3 AND (x.make IS NULL OR z.make IS NULL OR x.make = z.make)""",
    "config_best_match": """WITH c AS (SELECT p_partkey AS configuration_id, p_brand, CASE WHEN p_partkey % 8 = 0 THEN p_size % 5 END AS a, CASE WHEN p_partkey % 12 = 0 THEN p_size % 3 END AS b FROM part),
      m AS (SELECT s.p_partkey AS selection_id, configuration_id, row_number() OVER (PARTITION BY s.p_partkey ORDER BY (a IS NOT NULL)::INT + (b IS NOT NULL)::INT DESC, configuration_id) AS k
        FROM part s JOIN c USING (p_brand) WHERE (a IS NULL OR a = s.p_size % 5) AND (b IS NULL OR b = s.p_size % 3)) SELECT selection_id, configuration_id FROM m WHERE k = 1""",
    "ancestor_closure": """SELECT 'c' || c_custkey AS node, 1 AS below FROM customer UNION ALL SELECT 'n' || c_nationkey, count(*) FROM customer GROUP BY 1
      UNION ALL SELECT 'r' || n_regionkey, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "order_closure": """SELECT 'o' || o_orderkey AS node, 1 AS below FROM orders UNION ALL SELECT 'c' || o_custkey, count(*) FROM orders GROUP BY 1
      UNION ALL SELECT 'n' || c_nationkey, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
      UNION ALL SELECT 'r' || n_regionkey, count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "reachability": f"""WITH {_EDGES} f(node) AS (SELECT p_partkey FROM part WHERE p_partkey % 50 = 0 UNION SELECT source FROM g JOIN f ON target = node)
      SELECT CAST(node AS VARCHAR) AS node FROM f""",
    "graph_problems": f"""WITH {_EDGES} t(node) AS (SELECT p_partkey FROM part WHERE p_partkey % 50 = 0 AND p_partkey NOT IN (SELECT source FROM g)),
      f(node) AS (SELECT node FROM t UNION SELECT source FROM g JOIN f ON target = node),
      o AS (SELECT source, list(label) AS found, count(*) AS n FROM g GROUP BY 1),
      x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 0 THEN 'outcome' WHEN p_partkey % 3 = 0 THEN 'decision' ELSE 'test' END AS kind,
        CASE WHEN p_partkey % 50 = 0 THEN []::VARCHAR[] WHEN p_partkey % 3 = 0 THEN ['yes', 'no'] ELSE ['yes'] END AS needed, coalesce(found, []::VARCHAR[]) AS found, coalesce(n, 0) AS n FROM part LEFT JOIN o ON source = p_partkey),
      p AS (SELECT 'A required branch is missing or repeated' AS reason FROM x WHERE list_sort(needed) <> list_sort(found)
        UNION ALL SELECT 'An outcome has branches' FROM x WHERE kind = 'outcome' AND (n > 0 OR len(needed) > 0)
        UNION ALL SELECT 'A node that is no outcome has no branch' FROM x WHERE kind <> 'outcome' AND n = 0
        UNION ALL SELECT 'A test states no readings' FROM x WHERE kind = 'test' AND k % 2 <> 0
        UNION ALL SELECT 'No terminal can be reached' FROM x WHERE k NOT IN (SELECT node FROM f))
      SELECT reason, count(*) AS nodes FROM p GROUP BY 1""",
}
