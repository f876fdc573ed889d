"""From files to packages: sources, extracts, normalised tables, caches, libraries."""

import zipfile

import pytest

from quire.plans import package as P

FILES = {
    "m/index.html": b"<h1>Start</h1><nav><ul><li><a href='a.html'>A</a><ul><li><a href='b.html#x'>B</a></ul></ul></nav><p>Welcome",
    "m/a.html": b"<h1>A</h1><p>Text 2006 only <a href='b.html#x'>ok</a><a href='b.html#none'>frag</a><a href='index.html'>home</a><a href='http://e/'>ext</a><img src='i.png'>",
    "m/b.html": b"<h1>B</h1><p id='x'>Text of b <a href='d.pdf'>pdf</a><a href='gone.html'>gone</a><a href='known.html'>known</a><a href='i.png'>img</a><a href='external-car.html'>out</a>",
    "m/c.html": b"<h1>Start</h1><p>Welcome",
    "m/external-car.html": b"<p>not here",
    "m/e.html": b"<h1>A</h1><p>Text 2006 only ok frag home ext",
    "m/f.html": b"<h1>A</h1><p>Text 2006 only ok frag home ext",
    "m/bad.html": b"<meta charset=klingon><p>x",
    "m/d.pdf": b"%PDF-1 /Type /Page /Type /Page",
    "m/i.png": b"\x89PNG\r\n\x1a\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(data)
    return tmp_path / "src"


def normal(spark, members):
    from pyspark.sql import functions as F

    selected = members.select(F.lit("pub").alias("publication_id"), F.lit("m/index.html").alias("entry_path"), "path", "sha256", "content")
    pages = spark.createDataFrame([("m/d.pdf", 1, "first page", "native"), ("m/d.pdf", 2, None, "ocr")], "path string, page int, text string, provenance string")
    known = spark.createDataFrame([("m/known.html",), *[(name,) for name in FILES]], "path string")
    return P.normalize(selected, pages, known)


def test_sources_by_kind(spark, folder, tmp_path):
    whole = P.open_source(spark, str(folder))
    assert whole.status == "complete" and {r["path"] for r in whole.members.collect()} == set(FILES)
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as out:
        for name, data in FILES.items():
            out.writestr(name, data)
    packed = P.open_source(spark, str(tmp_path / "s.zip"))
    assert packed.status == "complete" and packed.digest == whole.digest
    single = P.open_source(spark, str(folder / "m" / "d.pdf"))
    assert [(r["path"], r["media_type"]) for r in single.members.collect()] == [("d.pdf", "application/pdf")] and single.status == "complete"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as out:
        out.writestr("../up", b"x")
        out.writestr("a.txt", b"x")
        out.writestr("A.txt", b"y")
        out.writestr("twice", b"1")
        out.writestr("twice", b"2")
    bad = P.open_source(spark, str(tmp_path / "bad.zip"))
    assert bad.status == "partial" and sorted((r["path"], r["code"]) for r in bad.failures.collect()) == [
        ("../up", "unsafe_path"), ("a.txt", "path_collision"), ("twice", "path_collision"), ("twice", "path_collision")
    ]
    assert [r["path"] for r in bad.members.collect()] == ["A.txt"]
    cut = P.open_source(spark, str(folder), most_files=7)
    assert {r["path"] for r in cut.failures.collect()} == set(sorted(FILES)[7:]) and {r["code"] for r in cut.failures.collect()} == {"file_limit"}
    (tmp_path / "none").mkdir()
    assert P.open_source(spark, str(tmp_path / "none")).status == "failed"


def test_extracts_are_whole_or_nothing(spark, folder, tmp_path):
    out = tmp_path / "out"
    revision = P.extract(spark, str(folder), str(out))
    tables, record = P.read_package(spark, str(out))
    assert record["revision"] == revision and {r["path"]: bytes(r["content"]) for r in tables["members"].collect()} == FILES
    with pytest.raises(FileExistsError):
        P.extract(spark, str(folder), str(out))
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as packed:
        packed.writestr("../up", b"x")
        packed.writestr("a", b"x")
    with pytest.raises(P.Incomplete):
        P.extract(spark, str(tmp_path / "bad.zip"), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists() and not (tmp_path / "no.staged").exists()
    tables["members"].where("path <> 'm/i.png'").write.parquet(str(tmp_path / "changed"))
    (out / "members").rename(tmp_path / "kept")
    (tmp_path / "changed").rename(out / "members")
    with pytest.raises(P.Incomplete):
        P.read_package(spark, str(out))


def test_normalised_tables(spark, folder):
    tables = normal(spark, P.open_source(spark, str(folder)).members)
    docs = {(r["path"], r["page"]): r for r in tables["documents"].collect()}
    assert {k: (d["role"], d["search_eligible"], d["provenance"]) for k, d in docs.items()} == {
        ("m/index.html", None): ("landing", False, "none"), ("m/c.html", None): ("landing", False, "none"), ("m/external-car.html", None): ("unavailable", False, "none"),
        ("m/a.html", None): ("procedure", True, "native"), ("m/b.html", None): ("procedure", True, "native"), ("m/e.html", None): ("procedure", True, "native"),
        ("m/f.html", None): ("procedure", True, "native"), ("m/d.pdf", 1): ("pdf_page", True, "native"), ("m/d.pdf", 2): ("pdf_page", False, "none"),
    }
    assert docs["m/c.html", None]["text"] == "" and docs["m/b.html", None]["breadcrumbs"] == ["A", "B"] and docs["m/a.html", None]["breadcrumbs"] == ["A"]
    names = {d["document_id"]: k for k, d in docs.items()}
    found = {(r["source_path"], r["href"]): (r["status"], names.get(r["target_id"])) for r in tables["links"].collect()}
    assert found == {
        ("m/index.html", "a.html"): ("resolved", ("m/a.html", None)), ("m/index.html", "b.html#x"): ("resolved", ("m/b.html", None)), ("m/a.html", "b.html#x"): ("resolved", ("m/b.html", None)),
        ("m/a.html", "b.html#none"): ("missing", None), ("m/a.html", "index.html"): ("resolved", ("m/index.html", None)), ("m/a.html", "http://e/"): ("blocked", None),
        ("m/b.html", "d.pdf"): ("resolved", ("m/d.pdf", 1)), ("m/b.html", "gone.html"): ("missing", None), ("m/b.html", "known.html"): ("outside_selection", None),
        ("m/b.html", "i.png"): ("unsupported", None), ("m/b.html", "external-car.html"): ("unavailable_by_source", None),
    }
    assert all((r["why"] is None) == (r["status"] == "resolved") for r in tables["links"].collect())
    assert [(r["path"], r["code"]) for r in tables["failures"].collect()] == [("m/bad.html", "html_normalization_failed")]
    assert [(r["path"], r["status"]) for r in tables["figures"].collect()] == [("m/i.png", "raster")]
    groups = {names[r["document_id"]][0]: (r["same_texts"], r["same_contexts"]) for r in tables["aliases"].collect()}
    assert groups == {"m/e.html": (groups["m/e.html"][0], 2), "m/f.html": (groups["m/f.html"][0], 2), **({"m/a.html": (3, 1)} if "m/a.html" in groups else {})}
    assert groups["m/e.html"][0] in (2, 3)


def test_cache_and_evidence(spark, folder, tmp_path):
    source, built = P.open_source(spark, str(folder)), []

    def build(given):
        built.append(1)
        return normal(spark, given.members)

    root = str(tmp_path / "cache")
    tables, record, reused = P.cached(spark, source, root, build)
    assert not reused and record["status"] == "partial"
    again = P.cached(spark, source, root, build)
    assert again[2] and again[1] == record and len(built) == 1
    links = tables["links"]
    assert P.same_evidence(links, normal(spark, source.members)["links"]) and not P.same_evidence(links, links.limit(3))
    (folder / "m" / "a.html").write_bytes(b"<p>other")
    assert not P.cached(spark, P.open_source(spark, str(folder)), root, build)[2] and len(built) == 2


def test_libraries():
    record = lambda digest, **more: {"source_sha256": digest, "revision": "r" + digest, "status": "complete", **more}
    packages = [("a", record("1", source_id="s")), ("b", record("1", source_id="s")), ("c", record("2", source_id="s"))]
    made = P.library(packages, "v", "w", {"a": "c"})
    assert [(p["place"], p["status"], p["superseded_by"]) for p in made["packages"]] == [("a", "superseded", "c"), ("b", "active", None), ("c", "active", None)]
    assert len({p["occurrence_id"] for p in made["packages"]}) == 3
    assert made["revision"] == P.library(packages, "v", "w", {"a": "c"})["revision"] != P.library(packages, "v", "x", {"a": "c"})["revision"]
    for bad in ({"a": "a"}, {"a": "none"}, {"a": "b", "b": "c"}):
        with pytest.raises(ValueError):
            P.library(packages, "v", "w", bad)
    with pytest.raises(ValueError):
        P.library([*packages, ("d", record("9", source_id="t"))], "v", "w", {"a": "d"})
    with pytest.raises(P.Incomplete):
        P.library([("a", {**record("1"), "status": "partial"})], "v", "w")
    assert len(P.transform_revision()) == 64


def _flip(path):
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(bytes(data))
    for crc in path.parent.glob(f".{path.name}.crc"):
        crc.unlink()


def test_a_reader_checks_what_it_opens(spark, tmp_path):
    """A flipped byte is found when its file is read, and only then; the cost is that of the files opened."""
    from pyspark.sql import functions as F

    from quire.plans import hashtree

    folder = tmp_path / "tree"
    rows = spark.range(4000).select(F.format_string("k%05d", "id").alias("path"), F.repeat(F.lit("x"), 50).alias("said"))
    rows.repartitionByRange(8, "path").sortWithinPartitions("path").write.parquet(f"{folder}/rows")
    spark.range(10).write.parquet(f"{folder}/other")
    root = hashtree.write(spark, str(folder), {"rows": "path", "other": None})
    tree = hashtree.Tree(spark, str(folder), root)
    assert tree.open("rows", "k00100", "k00120").where("path between 'k00100' and 'k00120'").count() == 21
    assert len(tree.checked) == 1
    leaves = {r["file"]: r for r in spark.read.parquet(f"{folder}/leaves").where("table = 'rows'").collect()}
    last = max(leaves.values(), key=lambda r: r["most"])
    _flip(folder / last["file"])
    fresh = hashtree.Tree(spark, str(folder))
    assert fresh.open("rows", "k00100", "k00120").count() > 0 and fresh.open("other").count() == 10
    for span in (("k03999", None), (None, None)):
        with pytest.raises(hashtree.Damaged, match=last["file"].rsplit("/", 1)[-1]):
            hashtree.Tree(spark, str(folder)).open("rows", *span)
    with pytest.raises(hashtree.Damaged):
        hashtree.Tree(spark, str(folder), "another root")
    spark.range(3).select(F.lit("zz").alias("path"), F.lit("s").alias("said")).write.mode("append").parquet(f"{folder}/rows")
    with pytest.raises(hashtree.Damaged):
        hashtree.Tree(spark, str(folder)).open("rows")


def test_packages_are_opened_by_ranges(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    from quire.plans import hashtree

    out = tmp_path / "out"
    P.extract(spark, str(folder), str(out))
    tree, record = P.open_package(spark, str(out))
    assert record["status" if "status" in record else "contract"] and tree.open("members", "m/a.html", "m/a.html").where("path = 'm/a.html'").count() == 1
    assert sorted(r["path"] for r in tree.open("members").select("path").collect()) == sorted(FILES)
    # a file and its leaf that were both changed don't fit the node above
    one = tree._leaves("members", "m/a.html", "m/a.html")[0]
    changed = spark.read.parquet(str(out / "leaves")).withColumn("sha256", F.when(F.col("file") == one["file"], "0").otherwise(F.col("sha256")))
    changed.write.partitionBy("bucket").parquet(str(tmp_path / "changed"))
    (out / "leaves").rename(tmp_path / "kept")
    (tmp_path / "changed").rename(out / "leaves")
    with pytest.raises(hashtree.Damaged, match="leaves"):
        hashtree.Tree(spark, str(out)).open("members", "m/a.html", "m/a.html")
