"""Publication, scoped search, interpretation, procedures, streams."""

import pytest
from pyspark.sql import functions as F

from quire.operators import evidence, gates, interpret, procedures, relations
from quire.plans import publish
from quire.plans.prefix import running_sum
from quire.streaming import reviews


def library(spark):
    units = spark.createDataFrame([(f"u{k}", f"t{k}", f"the pump {'torque ' * (k % 3)}text {k}") for k in range(12)], "unit_id string, title string, text string")
    scopes = spark.createDataFrame(
        [("a", f"u{k}", "confirmed", k % 2 == 0) for k in range(12)] + [("b", f"u{k}", "possible", k < 4) for k in range(12)] + [("none", "u1", "excluded", False)],
        "scope string, unit_id string, state string, eligible boolean",
    )
    return units, scopes


def test_publish_and_search(spark, tmp_path):
    units, scopes = library(spark)
    root = f"file://{tmp_path}/lib"
    name = publish.publish(units, scopes, root, {"review_revision": "r1"})
    folder, pointer = publish.open_current(spark, root, "r1")
    assert pointer["generation"] == name
    with pytest.raises(publish.StaleScope):
        publish.open_current(spark, root, "r2")
    rows = publish.search(spark, folder, "a", "torque").collect()
    assert {r["unit_id"] for r in rows} == {"u2", "u4", "u8", "u10"} and rows[0]["unit_id"] == "u2"
    assert {r["unit_id"] for r in publish.search(spark, folder, "b", "torque pump").collect()} == {"u1", "u2"}
    assert publish.search(spark, folder, "none", "torque").collect() == []
    with pytest.raises(KeyError):
        publish.search(spark, folder, "unknown", "torque")
    assert publish.publish(units, scopes, root, {"review_revision": "r1"}) == name
    assert publish.verified(spark, folder).open("units").count() == 8
    with pytest.raises(publish.Cancelled):
        publish.publish(units, scopes, root, {"review_revision": "r3"}, cancelled=lambda: True)
    assert publish.open_current(spark, root, "r1")[1]["generation"] == name


def test_search_can_be_cancelled(spark, tmp_path, monkeypatch):
    import threading

    units = spark.createDataFrame([("u1", "t", "torque"), ("u2", "t", "pump")], "unit_id string, title string, text string")
    scopes = spark.createDataFrame([("a", "u1", "confirmed", True), ("a,b", "u2", "confirmed", True)], "scope string, unit_id string, state string, eligible boolean")
    publish.publish(units, scopes, str(tmp_path), {"review_revision": "r"})
    folder, _ = publish.open_current(spark, str(tmp_path), "r")
    assert [r["unit_id"] for r in publish.Search(spark, folder, "a", "torque").rows()] == ["u1"]
    assert [r["unit_id"] for r in publish.Search(spark, folder, "a,b", "pump").rows()] == ["u2"]
    with pytest.raises(KeyError):
        publish.Search(spark, folder, "none", "torque").rows()
    begun, whole = threading.Event(), publish.search

    def slow(session, *rest):
        begun.set()
        session.range(0, 4, 1, 4).mapInPandas(lambda frames: (__import__("time").sleep(60) or f for f in frames), "id long").count()
        return whole(session, *rest)

    monkeypatch.setattr(publish, "search", slow)
    running = publish.Search(spark, folder, "a", "torque")
    begun.wait()
    __import__("time").sleep(2)
    running.cancel()
    with pytest.raises(publish.Cancelled):
        running.rows()


def test_shards_hold_only_units_of_one_signature(spark):
    units, scopes = library(spark)
    signed = relations.membership(scopes.where("eligible").select("scope", "unit_id"))
    shards = relations.shard_pack(signed.join(units.select("unit_id", F.lit(600).alias("chars")), "unit_id"), 1000)
    rows = shards.collect()
    assert len({(r["signature"], r["bin"]) for r in rows}) == len(rows)
    with pytest.raises(ValueError):
        relations.shard_pack(shards, 10)


def test_saved_index_ranks_alike(spark, tmp_path):
    from quire.operators import search

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    search.save_index(docs, str(tmp_path / "index"))
    plain = lambda df: sorted((r["doc_id"], round(r["score"], 9), r["matched"]) for r in df.collect())
    assert plain(search.indexed_search(spark, str(tmp_path / "index"), "the thand er")) == plain(search.bm25(docs, "the thand er")) != []
    assert plain(search.indexed_search(spark, str(tmp_path / "index"), "?")) == []


def test_scope_cache():
    cache, made = publish.ScopeCache(2), []
    for key in (1, 2, 1, 3, 1, 2):
        cache.get({"k": key}, lambda key=key: made.append(key))
    assert made == [1, 2, 3, 2]


def test_running_sum_in_ranges(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = {r["k"]: r["s"] for r in running_sum(rows, "k", "v", "s", ranges=13).collect()}
    total = 0
    for k in range(1000):
        total += k % 7
        assert got[k] == total


def test_mentions(spark):
    names = spark.createDataFrame(
        [("model", "m1", "Silver", None, None), ("model", "m2", "Silver 1500", None, None), ("make", "k", "Acme", None, None), ("model", "m3", "Old", 1990, 1995)],
        "kind string, target_id string, literal string, year_start int, year_end int",
    )
    said = spark.createDataFrame([(1, "Acme silver  1500 and Silver"), (2, "silver 1500 2001"), (3, "Old 1993"), (4, "Old 2001"), (5, None)], "id int, statement string")
    got = sorted((r["id"], r["target_id"]) for r in interpret.mentions(said, names).collect())
    assert got == [(1, "k"), (1, "m1"), (1, "m2"), (2, "m2"), (3, "m3")]
    assert interpret.mentions(said, names.where("false")).collect() == []


def test_equal_names_count_once(spark):
    """Of names alike the first counts; a name's own comes before an alias."""
    names = spark.createDataFrame(
        [("model", "z", "Ridge", None, None, 0), ("model", "a", "ridge", None, None, 1), ("make", "k", "Ridge", None, None, 1)],
        "kind string, target_id string, literal string, year_start int, year_end int, ord int",
    )
    said = spark.createDataFrame([(1, "a Ridge, Ridge_x ridge2")], "id int, statement string")
    assert sorted((r["kind"], r["target_id"]) for r in interpret.mentions(said, names).collect()) == [("make", "k"), ("model", "z")]


def test_ground_truth(spark):
    units = spark.createDataFrame(
        [("u1", "s", "a.html", None, "section"), ("u2", "s", "m.pdf", 3, "region"), ("u3", "s", "twice.html", None, "section"), ("u4", "s", "twice.html", None, "section"), ("u5", "s", "a.html", None, "table")],
        "unit_id string, source_id string, path string, page int, kind string",
    )
    row = lambda label, path, page=None, refs=(), source="s": (label, source, path, page, "step", f"text of {label}", list(refs))
    gold = [row("one", "a.html", refs=["two"]), row("two", "m.pdf", 3), row("none", "m.pdf", 4), row("many", "twice.html"), row("lost", "a.html", refs=["none"]), row("again", "a.html"), row("again", "m.pdf", 3), row("far", "a.html", source="t")]
    shape = "label string, source_id string, path string, page int, type string, original_text string, refs array<string>"
    got = {r["label"]: r for r in evidence.bind_ground_truth(spark.createDataFrame(gold, shape), units).collect()}
    assert {k: (r["unit_id"], r["problem"]) for k, r in got.items()} == {
        "one": ("u1", None), "two": ("u2", None), "none": (None, "no unit"), "many": (None, "several units"), "lost": (None, "refers to what isn't bound"),
        "again": (None, "label is repeated"), "far": (None, "no unit"),
    }
    assert got["one"]["ref_ids"] == [got["two"]["record_id"]] and got["two"]["ref_ids"] == []


def test_envelopes(spark):
    shape = (
        "binding struct<source_id:string,unit_id:string,provenance:string>, locator struct<kind:string,selector:string>, original_text string, "
        "configuration_ids array<string>, conditions array<string>, context_ids array<string>, payload struct<subject:string>, missing array<string>"
    )
    row = lambda subject, missing: (("s", "u", "native"), ("html", "tr:nth-of-type(1)"), "t", ["c1"], [], [], (subject,), missing)
    rows = spark.createDataFrame([row("a", []), row("a", []), row("a", ["x"]), row("b", [])], shape)
    made = gates.envelope(rows, "specification", "r1", "v1").collect()
    assert len({r["record_id"] for r in made}) == 3 and all(r["record_id"].startswith("rec_") for r in made)
    assert [r["completeness"]["state"] for r in made] == ["complete", "complete", "ambiguous", "complete"]
    assert made[0]["binding"]["extraction_version"] == "r1" and made[0]["applicability"]["configuration_ids"] == ["c1"]
    assert {r["record_id"] for r in gates.envelope(rows, "specification", "r2", "v1").collect()}.isdisjoint({r["record_id"] for r in made})


def test_procedures(spark):
    from quire.sources import html

    page = b"<table><tr><th>Bolt<th>Torque<tr><td>A<td>5 Nm<tr><td>B<td>6 Nm<tr><td>B<td>7 Nm</table>"
    nodes = html.project(page, "p.html")["nodes"]
    assert procedures.table_rows(nodes, [["Bolt"], ["Torque"]], ["A", "B", "C"]) == [
        ("A", ["A", "5 Nm"], None), ("B", None, "row is absent or repeated"), ("C", None, "row is absent or repeated")
    ]
    assert procedures.table_rows(nodes, [["Other"]], ["A"])[0][2].startswith("no table")
    asked = html.project(b"<h4>Test</h4><p>Is it hot?</p><table><tr><th>Yes<th>No<tr><td>stop<td>go on</table>", "p.html")["nodes"]
    assert procedures.decision(asked) == ("Is it hot?", "stop", "go on")
    assert isinstance(procedures.decision(nodes), str)
    listed = html.project(b"<ol><li>One<li>If two<ol><li>in</ol></ol>", "p.html")["nodes"]
    frame = spark.createDataFrame([(1, n["node_id"], n["parent_id"], n["tag"], n["text"]) for n in listed], "doc_id int, node_id int, parent_id int, tag string, text string")
    rows = procedures.ordered_steps(frame).orderBy("list_id", "step").collect()
    assert [(r["step"], r["next_step"], r["conditional"], r["nested"]) for r in rows] == [(1, 2, False, False), (2, None, True, True), (1, None, False, False)]
    paths = procedures.source_paths(spark.createDataFrame([("s", "go to 4, then go to 5")], "step_id string, text string"), spark.createDataFrame([("s", "repeat", "then"), ("s", "repeat", "go to"), ("x", "repeat", "a")], "step_id string, kind string, quote string"))
    assert {r["quote"]: r["reason"] for r in paths.collect()} == {"then": None, "go to": "quote is ambiguous", "a": "step is unknown"}


def test_link_audit(spark):
    links = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0)], "source string, target string, ord int")
    pages = spark.createDataFrame([("b",)], "path string")
    assert sorted(tuple(r) for r in procedures.audit_links("a", links, pages, 5).collect()) == [("b", True, 1), ("c", False, 0)]
    with pytest.raises(ValueError):
        procedures.audit_links("a", links, pages, 1)


def test_stream_of_events(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 1, "propose"), ("k1", 3, "accept"), ("k2", 2, "propose"), ("k1", 2, "late")], "key string, seq int, action string")
    rows.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = reviews.keep(reviews.current_states(stream, ["key"], ["seq"]), f"{tmp_path}/out", f"{tmp_path}/ck", ["key"])
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(f"{tmp_path}/out").select("key", "action").collect()
    assert sorted(tuple(r) for r in got) == [("k1", "accept"), ("k2", "propose")]


def test_lead_members(spark):
    """Every document behind a lead."""
    rows = [(1, "a", "Part ABCD-123"), (2, "a", "part abcd-123, EFGH-456"), (3, "b", "ABCD-123"), (4, "a", "EFGH-456"), (5, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {tuple(r) for r in relations.lead_members(docs).collect()}
    assert got == {("shared_part", "ABCD-123", "member", s, k) for k, s, _ in rows[:3]}


def test_lead_members_of_titles(spark):
    """Every document behind a lead, and mentions of titles as the reference's pattern finds them."""
    import re

    rows = [
        (1, "a", "Brake pads", "Part ABCD-123. See  brake PADS, or refer to Coolant (hot)x"), (2, "a", "Coolant (hot)", "part abcd-123 and foresee Wheel nuts"),
        (3, "b", "Brake pads", "ABCD-123"), (4, "b", "Wheel nuts", "ABCD-123; see\nsee wheel nutsy"), (5, "c", "Coolant (hot)", "refer to brake pads2; SEE\tWheel nuts"),
        (6, "c", "Short", "see Short, see Coolant (hot). see coolant (hot)"), (7, "d", "to see now", "see to see now"), (8, "e", None, "see To See Now"),
        (9, "f", "Short", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, title string, text string")
    got = {tuple(r) for r in relations.lead_members(docs, title_column="title").collect()}
    expected = {("shared_part", "ABCD-123", "member", s, k) for k, s, _, _ in rows[:4]}
    for k, s, _, text in rows:
        for t, other, title, _ in rows:
            if s != other and title and len(title) >= 8 and re.search(r"\b(?:see|refer to)\s+" + re.escape(title) + r"\b", text or "", re.I):
                expected |= {("section_applies", title.lower(), "mention", s, k), ("section_applies", title.lower(), "target", other, t)}
    assert got == expected and len(expected) > 8


def test_closures(spark):
    """Deep chains, cycles and branches against a plain walk."""
    import random

    from quire.operators.hierarchy import closure

    draw = random.Random(4)
    graphs = [
        [(k, k + 1) for k in range(300)],
        [(k, (k + 1) % 40) for k in range(40)] + [(100, 3)],
        [(draw.randrange(60), draw.randrange(60)) for _ in range(90)],
        [(k, k + 1) for k in range(60)] + [(k, k + 2) for k in range(60)] + [(61, 0)],
    ]
    for edges in graphs:
        starts, out = [0, 5, 100], {}
        for a, b in edges:
            out.setdefault(a, set()).add(b)
        expected = set()
        for start in starts:
            held, todo = {start}, [start]
            while todo:
                for b in out.get(todo.pop(), ()):
                    if b not in held:
                        held.add(b)
                        todo.append(b)
            expected |= {(start, node) for node in held}
        got = closure(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(s,) for s in starts], "node long"))
        assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_can_finish_of_deep_and_open_graphs(spark):
    """Nodes that reach a terminal, against a plain walk; keys stay what they are while edges are followed."""
    import random

    from quire.operators.hierarchy import can_finish

    draw = random.Random(5)
    graphs = [
        ([(k, k + 1) for k in range(60)], [60, 70]),
        ([(k, (k + 1) % 40) for k in range(40)] + [(100, 3), (3, 200)], [200]),
        ([(draw.randrange(80), draw.randrange(80)) for _ in range(90)] + [(None, 3), (4, None), (5, 5)], [3, 7, None]),
        ([(1, 2)], []),
    ]
    for edges, ends in graphs:
        expected, todo = {e for e in ends if e is not None}, [e for e in ends if e is not None]
        while todo:
            at = todo.pop()
            new = {a for a, b in edges if b == at and a is not None} - expected
            expected |= new
            todo += new
        ways, last = spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(e,) for e in ends], "node long")
        for some in (last, last.select(F.col("node").cast("string").alias("node"))):
            got = [r["node"] for r in can_finish(ways, some).collect()]
            assert sorted(got) == sorted(map(str, expected))


def test_can_finish_follows_open_edges_alone(spark, monkeypatch):
    """What a round writes anew is the edges that are still open, fewer each round."""
    from quire.operators import hierarchy

    sizes, plain = [], hierarchy.reliable

    def counted(df):
        out = plain(df)
        if out.columns == ["source", "target"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(hierarchy, "reliable", counted)
    ways = spark.range(64).select(F.col("id").alias("source"), (F.col("id") - 1).alias("target"))
    hierarchy.can_finish(ways, spark.createDataFrame([(-1,)], "node long"))
    assert sizes[0] == 64 and len(sizes) > 3 and all(b < a for a, b in zip(sizes, sizes[1:], strict=False)) and not sizes[-1]


def _published(spark, tmp_path, monkeypatch, cell=16, first=2):
    """Documents as units of scopes that overlap, in small cells."""
    from quire.operators import blocks

    monkeypatch.setattr(blocks, "CELL", cell)
    monkeypatch.setattr(blocks, "FIRST_CELLS", first)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    units = docs.select(F.col("doc_id").alias("unit_id"), F.lit("t").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    scopes = docs.select(F.explode(F.array("lang", "source", F.lit("all"))).alias("scope"), F.col("doc_id").alias("unit_id"), F.lit("confirmed").alias("state"), F.lit(True).alias("eligible"))
    scopes = scopes.where("scope is not null")
    publish.publish(units, scopes, str(tmp_path), {"review_revision": "r"})
    return publish.open_current(spark, str(tmp_path), "r")[0], units, scopes


@pytest.mark.parametrize("many", [False, True])
def test_published_search_equals_a_scan(spark, tmp_path, monkeypatch, many):
    from quire.operators import blocks, search

    if many:  # heads, memberships and cells that are too many to be named
        monkeypatch.setattr(blocks, "MOST_HEADS", 1)
        monkeypatch.setattr(publish, "MOST_MEMBERSHIPS", 0)

    folder, units, scopes = _published(spark, tmp_path, monkeypatch)
    told = [r["scope"] for r in scopes.groupBy("scope").count().orderBy(F.desc("count"), "scope").limit(3).collect()]
    for scope, queries, limits in zip(told, (("the the of", "est que de"), ("the and", "nosuchword the", "!"), ("der die", "the and")), ((1, 1000), (7,), (2,)), strict=True):
        scanned = units.join(scopes.where(F.col("scope") == scope).select("unit_id"), "unit_id").cache()
        for query in queries:
            for limit in limits:
                plain = [(r["unit_id"], r["score"], r["snippet"]) for r in search.scoped_search(scanned, query, limit, "unit_id", digits=9).collect()]
                got = [(r["unit_id"], r["score"], r["snippet"]) for r in publish.search(spark, folder, scope, query, limit, digits=9).collect()]
                assert got == plain, (scope, query, limit)
    with pytest.raises(ValueError):
        publish.search(spark, folder, "all", "the", 0)


def test_published_search_skips_cells_and_files(spark, tmp_path, monkeypatch):
    """Cells whose bound is below the worst of the best are not scored, and folders of other terms not opened."""
    from quire.operators import blocks

    folder, _, _ = _published(spark, tmp_path, monkeypatch, cell=4, first=3)
    scored, plain = [], blocks._scored

    def counted(some, *rest):
        scored.append(some.select("cell").distinct().count())
        return plain(some, *rest)

    monkeypatch.setattr(blocks, "_scored", counted)
    found = publish.search(spark, folder, "all", "the and", 2).collect()
    cells = blocks.open_blocks(spark, f"{folder}/blocks", ["and"]).select("cell").distinct().count()
    assert len(found) == 2 and scored[0] == 3 and sum(scored) < cells / 2
    whole = set(spark.read.parquet(f"{folder}/blocks").inputFiles())
    opened = {row[0] for row in blocks.open_blocks(spark, f"{folder}/blocks", ["the", "and"]).select(F.input_file_name()).distinct().collect()}
    assert 0 < len(opened) < len(whole) / 4


def test_numbers_begin_a_cell_for_each_membership(spark, monkeypatch):
    from quire.operators import blocks

    monkeypatch.setattr(blocks, "CELL", 16)
    units = spark.range(500).select(F.col("id").alias("unit_id"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("m"), F.col("id") % 7)).alias("membership"), (F.col("id") % 2).alias("shard"))
    rows = sorted((r["unit_no"], r["membership"], r["shard"], r["unit_id"]) for r in blocks.numbered(units).collect())
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows) and len({r[0] for r in rows}) == 500
    owner = {}
    for number, membership, _, _ in rows:
        assert owner.setdefault(number // 16, membership) == membership
    for name in {r[1] for r in rows}:
        own = [r[0] for r in rows if r[1] == name]
        assert own[0] % 16 == 0 and own == list(range(own[0], own[0] + len(own)))


def test_mentions_of_titles_of_very_many_lengths(spark):
    """A thousand lengths and two thousand mentions: a row a mention and fitting length, not a row for each length."""
    import time

    titles = spark.range(1000).select((F.col("id") + 10_000).alias("doc_id"), F.concat(F.lit("Chapter "), F.format_string("%05d", "id"), F.lit(" "), F.repeat(F.lit("x"), F.col("id").cast("int")), F.lit(" end")).alias("title"), F.lit("").alias("text"))
    saying = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("please see "), F.when(F.col("id") % 2 == 0, F.lit("Something else entirely")).otherwise(F.lit("chapter 00007 xxxxxxx END.")), F.lit(" and "), F.repeat(F.lit("more "), 300)).alias("text"))
    docs = titles.unionByName(saying)
    began = time.time()
    rows = relations.title_mentions(docs, "title").collect()
    assert {(r["key"], r["doc_id"]) for r in rows} == {("chapter 00007 xxxxxxx end", k) for k in range(1, 2000, 2)} and len(rows) == 1000
    assert time.time() - began < 30


def _plain_mentions(text, names):
    """Names by pattern, longest first, as a plain walk."""
    import re

    found = []
    for kind, target, literal in names:
        pattern = r"(?<!\w)" + r"\s+".join(map(re.escape, literal.split())) + r"(?!\w)"
        found += [(m.start(), m.end(), kind, target, literal) for m in re.finditer(rf"(?=({pattern}))", text, re.I) for m in [re.compile(pattern, re.I).match(text, m.start())]]
    kept = []
    for start, end, kind, target, literal in sorted(found, key=lambda f: (-len(" ".join(text[f[0] : f[1]].split())), f[2], f[3], f[4], f[0])):
        if not any(start < b and a < end for a, b, k, _ in kept if k == kind):
            kept.append((start, end, kind, target))
    return {(kind, target) for _, _, kind, target in kept}


def test_mentions_equal_patterns(spark):
    """Words, marks at either end of a name, blanks of any width, overlapping names, texts of one id."""
    import random

    from quire.operators import dictionary

    rng = random.Random(4)
    pieces = ["ab", "AB", "c", "1500", "(hot)", "-", "x_y", "é", "d.", "#7", "ab-c"]
    names = sorted({(rng.choice(["make", "model"]), f"t{k}", rng.choice([" ", "  "]).join(rng.choices(pieces, k=rng.randint(1, 3)))) for k in range(60)})
    texts = [(k % 150, "".join(rng.choice(pieces) + rng.choice([" ", "", "\t ", ", "]) for _ in range(rng.randint(0, 14)))) for k in range(200)] + [(999, None), (998, "")]
    none = F.lit(None).cast("int")
    frame = spark.createDataFrame(names, "kind string, target_id string, literal string").select("*", none.alias("year_start"), none.alias("year_end"))
    got = {tuple(r) for r in dictionary.mentions(spark.createDataFrame(texts, "id int, statement string"), frame).collect()}
    assert got == {(k, *hit) for k, text in texts for hit in _plain_mentions(text or "", names)} and len(got) > 100


def test_a_million_names(spark):
    from quire.operators import dictionary

    none = F.lit(None).cast("int")
    names = spark.range(1_000_000).select(F.lit("model").alias("kind"), F.concat(F.lit("m"), "id").alias("target_id"), F.concat(F.lit("Name "), "id", F.lit(" of "), F.col("id") % 7).alias("literal"), none.alias("year_start"), none.alias("year_end"))
    said = spark.range(500).select("id", F.concat(F.lit("see name "), F.col("id") * 1999, F.lit(" of "), F.col("id") * 1999 % 7, F.lit(" and name 5 of 6.")).alias("statement"))
    rows = dictionary.mentions(said, names).collect()
    assert sorted((r["id"], r["target_id"]) for r in rows) == [(k, f"m{k * 1999}") for k in range(500)]


def test_names_of_one_token_need_no_places(spark):
    """Words of a text count once where no name of a kind is longer: no window over places, the same mentions."""
    from quire.operators import dictionary

    names = [("make", "a", "ab", None, None), ("make", "b", "AB", None, None), ("make", "c", "-", None, None), ("make", "d", "é", 1990, 1999), ("make", "e", "é", 1980, 1995), ("make", "f", "x_y", 2000, 2001)]
    schema = "kind string, target_id string, literal string, year_start int, year_end int"
    texts = [(1, "ab AB ab-c abc"), (1, "é of 1992"), (2, "É é 1997 x_y"), (3, "x_y 2000, 2001"), (3, "x_y 2001"), (4, "cab -ab a-b"), (5, ""), (6, None), (None, "ab"), (7, "- (ab)")]
    said = spark.createDataFrame(texts, "id int, statement string")
    both = spark.createDataFrame([*names, ("model", "g", "ab ab", None, None), ("model", "h", "ab", None, None)], schema)
    for some in (spark.createDataFrame(names, schema), both):
        got = dictionary.mentions(said, some)
        want = dictionary.spans(said, some).select("id", "kind", "target_id").distinct()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() >= 8
    alone = dictionary.mentions(said, spark.createDataFrame(names, schema))
    assert "Window" not in alone._jdf.queryExecution().executedPlan().toString()
