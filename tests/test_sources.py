"""Archives, discs, pages and files made in the tests themselves."""

import io
import struct
import zipfile
import zlib

import pytest

from quire.sources import archives, files, html, svg


def pod2(members):
    names, table, data = b"", b"", b""
    start = 17 + 16 * len(members) + sum(len(n) + 1 for n, _ in members)
    for name, payload in members:
        table += struct.pack("<IIII", len(names), len(name) + 1, start + len(data), len(payload))
        names += name.encode() + b"\0"
        data += payload
    return archives.POD2 + struct.pack("<II", len(members), len(names)) + table + names + data


def packed_name(stem, extension):
    number = lambda c: archives.LETTERS.index(c) + 1
    bits = 0
    for c in stem.ljust(8):
        bits = bits << 6 | (0 if c == " " else number(c))
    tail = 0
    for c in extension.ljust(3):
        tail = tail * 38 + (0 if c == " " else number(c))
    return bits.to_bytes(6, "big") + tail.to_bytes(2, "big")


def pod1(members):
    table, data, at = b"", b"", 13 + 15 * len(members)
    for (stem, extension), payload in members:
        table += packed_name(stem, extension) + struct.pack("<I", at + len(data)) + len(payload).to_bytes(3, "little")
        data += payload
    return archives.POD1 + struct.pack("<I", len(members)) + table + data


def verbatim(data):
    return archives.PACKED + b"\x01" + struct.pack("<h", -len(data)) + data + b"\0\0"


def compressed(body):
    return archives.PACKED + b"\x01" + struct.pack("<h", len(body)) + body + b"\0\0"


def test_entries_of_both_versions():
    assert [e.name for e in archives.pod_entries(pod2([("A.TXT", b"x"), ("b.epl", b"yy")]))] == ["A.TXT", "b.epl"]
    data = pod1([(("ABC_9", "HTM"), b"hello"), (("Z", ""), b"!")])
    found = archives.pod_entries(data)
    assert [(e.name, e.size) for e in found] == [("ABC_9.HTM", 5), ("Z", 1)]
    assert archives.contents(data, found[0]) == b"hello"


@pytest.mark.parametrize("damage", [lambda d: d[:12], lambda d: d + b"!", lambda d: d[:5] + b"?" + d[6:], lambda d: d[:13] + b"\0" * 6 + d[19:]])
def test_damaged_archives(damage):
    with pytest.raises(archives.FormatError):
        archives.pod_entries(damage(pod1([(("AB", "C"), b"hello")])))


def test_unpack_tokens():
    assert archives.unpack(verbatim(b"plain")) == b"plain"
    literals = struct.pack("<H", 0) + b"abcdefgh"
    assert archives.unpack(compressed(literals)) == b"abcdefgh"
    short_run = struct.pack("<H", 0x8000) + bytes([0x02, ord("x")])
    assert archives.unpack(compressed(short_run)) == b"x" * 5
    long_run = struct.pack("<H", 0x8000) + bytes([0x11, 0x00, ord("y")])
    assert archives.unpack(compressed(long_run)) == b"y" * 20
    # three literals, then a match of five from three back
    match = struct.pack("<H", 0x1000) + b"abc" + bytes([0x50, 0x00])
    assert archives.unpack(compressed(match)) == b"abcabcab"
    # zeros before the first byte can be reached
    assert archives.unpack(compressed(struct.pack("<H", 0x8000) + bytes([0x30, 0x00]))) == b"\0\0\0"


def test_unpack_strict():
    with pytest.raises(archives.FormatError):
        archives.unpack(archives.PACKED + b"\x01" + struct.pack("<h", -2) + b"ab" + struct.pack("<h", -2) + b"cd" + b"\0\0", strict=True)
    with pytest.raises(archives.FormatError):
        archives.unpack(b"nothing")


def record(name, sector, size, folder):
    body = bytes([0]) + struct.pack("<I", sector) + struct.pack(">I", sector) + struct.pack("<I", size) + struct.pack(">I", size)
    body += bytes(7) + bytes([2 if folder else 0]) + bytes(6) + bytes([len(name)]) + name
    body += bytes(len(body) % 2)
    return bytes([len(body) + 1]) + body


def disc(stride, skip):
    root = record(b"\0", 20, 2048, True) + record(b"\1", 20, 2048, True) + record(b"DIR", 21, 2048, True) + record(b"A.TXT;1", 22, 5, False)
    inner = record(b"B.ARC;1", 23, 3, False)
    volume = b"\x01CD001" + b"\x01\0" + b"SYS".ljust(32) + b"LABEL".ljust(32)
    volume = volume.ljust(156, b"\0") + record(b"\0", 20, 2048, True)
    sectors = {16: volume, 20: root, 21: inner, 22: b"hello", 23: b"arc"}
    image = b""
    for k in range(24):
        image += (b"\0" * skip + sectors.get(k, b"").ljust(2048, b"\0")).ljust(stride, b"\0")
    return image


@pytest.mark.parametrize("layout", archives.SECTORS)
def test_disc_in_every_sector_layout(layout):
    image = archives.Image(disc(*layout))
    assert image.label == "LABEL"
    assert sorted((p, s, d) for p, _, s, d in image.walk()) == [("A.TXT", 5, False), ("DIR", 2048, True), ("DIR/B.ARC", 3, False)]
    with pytest.raises(archives.FormatError):
        archives.Image(b"\0" * 100_000)


def test_archives_through_spark(spark, tmp_path):
    (tmp_path / "one.ARC").write_bytes(pod2([("A.TXT", verbatim(b"text")), ("B.TXT", b"raw")]))
    (tmp_path / "two.arc").write_bytes(b"broken")
    rows = archives.entries(spark, str(tmp_path)).collect()
    assert sorted((r["name"] or "", bytes(r["content"] or b""), bool(r["error"])) for r in rows) == [("", b"", True), ("A.TXT", b"text", False), ("B.TXT", b"raw", False)]
    (tmp_path / "two.arc").unlink()
    spark.dataSource.register(archives.PodSource)
    found = spark.read.format("podarc").option("entriesPerPartition", 1).load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 2
    assert {r["name"]: bytes(r["content"]) for r in found.collect()} == {"A.TXT": b"text", "B.TXT": b"raw"}


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("x/one.html", "<p>1")
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        out.writestr(link, "x")
        out.writestr("bomb", b"\0" * 4_000_000)
    (tmp_path / "b.zip").write_bytes(b"no")
    rows = {(r["name"] or ""): (bytes(r["content"] or b""), r["error"]) for r in archives.zip_members(spark, str(tmp_path)).collect()}
    assert rows["x/one.html"] == (b"<p>1", None)
    assert rows["link"][1] == "symbolic link" and rows["bomb"][1] == "compression ratio" and rows[""][1].startswith("cannot")


PAGE = b"""<html><head><meta charset="utf-8"><title>Title</title></head><body>
<nav><ul><li><a href="a.html">A</a></ul></nav>
<div class="main"><h1>Brakes 2006 only</h1><p>First <b>bold</b><p>See <a href="../up.html#x">up</a> and <a href="http://e.com/">out</a></p>
<ol><li>One<li>If two<ol><li>inner</ol></ol>
<figure><img src="f.png"><figcaption>Diesel figure</figcaption></figure><p class="warning">Hot</p>
<table><tr><th colspan="2">Head</th></tr><tr><td>a<td>b</table><script>no()</script></div></body></html>"""


def test_page_projection():
    page = html.project(PAGE, "m/pages/p.html")
    assert page["title"] == "Brakes 2006 only" and page["role"] == "procedure"
    assert page["text"].splitlines() == ["Brakes 2006 only", "First bold", "See up and out", "One", "If two", "inner", "Diesel figure", "Hot", "Head", "a", "b"]
    assert [(x["path"], x["fragment"], x["context"], x["reason"]) for x in page["links"]] == [
        ("m/pages/a.html", "", "navigation", None),
        ("m/up.html", "x", "content", None),
        (None, "", "content", "external or active URL"),
    ]
    assert page["figures"] == [{"href": "f.png", "path": "m/pages/f.png", "caption": "Diesel figure", "reason": None}]
    assert [(s["statement"], s["level"]) for s in page["statements"]] == [("Brakes 2006 only", "document"), ("Hot", "document"), ("Diesel figure", "figure")]
    assert page["routes"] == [{"labels": ["A"], "link": 0, "anchor": None}]
    cells = html.grid([n for n in page["nodes"] if n["tag"] in ("table", "tr", "td", "th")])
    assert cells == [["Head", "Head"], ["a", "b"]]


def test_legacy_encodings_and_fragments():
    assert html.project("<p>é</p>".encode("utf-16-le").join([b"\xff\xfe", b""]), "p.html", legacy=True)["text"] == "é"
    assert html.project(b"<p>\xe9</p>", "p.html", legacy=True)["encoding"] == "cp1252-fallback"
    safe = html.fragment(b'<div onclick="x"><script>no()</script><p>a < b <a href="../q.html#f">q</a><a href="http://e/">e</a><img src="i.png"><blink>c', "m/p.html")
    assert safe == '<div><p>a &lt; b <a href="#/q.html/f">q</a><a>e</a><img src="#/m/i.png">c</p></div>'


@pytest.mark.parametrize(("name", "markup", "role"), [
    ("index.html", b"<p>x", "landing"), ("external-car.html", b"<p>x", "unavailable"), ("a.html", b"<ul><li>x</ul>", "navigation"), ("b.html", b"<ul><li>x</ul><p>y", "procedure"),
])
def test_roles(name, markup, role):
    assert html.project(markup, name)["role"] == role


@pytest.mark.parametrize("bad", [b'<table><tr><td rowspan="0">x</table>', b"<meta charset=klingon>", b"<div>" * 300, b'<meta charset="utf-8">\xff'])
def test_page_errors(spark, bad):
    rows = html.parse(spark.createDataFrame([("p.html", bytearray(bad))], "path string, content binary")).collect()
    assert rows[0]["page"]["error"] and rows[0]["page"]["title"] is None


@pytest.mark.parametrize(("href", "expected"), [
    ("b.html", ("a/b.html", "", None)), ("#f", ("a/c.html", "f", None)), ("..\\x.html", ("x.html", "", None)), ("../../x", (None, "", "leaves the source")),
    ("/x", (None, "", "absolute URL")), ("x?y=1", (None, "", "query in URL")), ("%2e%2e/z", ("z", "", None)), ("javascript:x", (None, "", "external or active URL")),
    ("./", ("a", "", None)), ("../", (None, "", "is a directory")), ("..", (None, "", "is a directory")), ("a//b/./c/", ("a/a/b/c", "", None)), ("../../a/x#f", (None, "f", "leaves the source")),
    ("x\ty", (None, "", "control character")), ("x%09#f", (None, "", "encoded control character")), ("//h/x#f", (None, "", "external or active URL")), ("http://[x", (None, "", "invalid URL")),
    ("%43:x", (None, "", "absolute URL")), ("%2Fx", (None, "", "absolute URL")), ("?", ("a/c.html", "", None)),
])
def test_resolve(href, expected):
    assert html.resolve("a/c.html", href) == expected


def table(*rows):
    """Node rows of a table from rows of (text, rowspan, colspan)."""
    nodes, number = [{"node_id": 0, "parent_id": None, "tag": "table"}], 0
    for row in rows:
        number += 1
        line = number
        nodes.append({"node_id": line, "parent_id": 0, "tag": "tr"})
        for text, high, wide in row:
            number += 1
            nodes.append({"node_id": number, "parent_id": line, "tag": "td", "rowspan": high, "colspan": wide, "text": text})
    return nodes


def test_grid_spans():
    rows = [[("a", 2, 1), ("b", 1, 2), ("c", 3, 1)], [("d", 1, 1), ("e", 2, 1)], [("f", 1, 2)]]
    assert html.grid(table(*rows)) == [["a", "b", "b", "c"], ["a", "d", "e", "c"], ["f", "f", "e", "c"]]
    assert [(cell["text"], row, column) for cell, row, column in html.placed_cells(table(*rows))] == [
        ("a", 0, 0), ("b", 0, 1), ("c", 0, 3), ("d", 1, 1), ("e", 1, 2), ("f", 2, 0)
    ]


@pytest.mark.parametrize("rows", [
    [], [[]], [[("a", 1, 1), ("b", 1, 1)], [("c", 1, 1)]], [[("a", 2, 1)]], [[("a", 1, 65)]], [[("a", 1, 40), ("b", 1, 40)]], [[("a", 0, 1)]], [[("a", 1, 1), ("b", 2, 1)], [("c", 1, 2)]],
    [[("a", 1, 2), ("b", 1, 1)], [("c", 1, 1)]], [[("a", 1, 1)]] * 2001,
])
def test_tables_that_are_no_grid(rows):
    with pytest.raises(html.PageError):
        html.grid(table(*rows))


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 1, 1) + b"\x08\x00\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_drawings():
    import base64

    inline = "data:image/png;base64," + base64.b64encode(png()).decode()
    drawn = lambda inside, more="": f'<svg xmlns="http://www.w3.org/2000/svg" {more}>{inside}</svg>'.encode()
    image = '<g id="a"><image href="{}"/></g>'
    assert svg.svg_problem(drawn(image.format(inline))) is None
    assert svg.svg_problem(drawn(image.format("http://x/"))) == "reference isn't an inline PNG of a fitting size"
    kept = svg.safe_svg(drawn('<metadata><rdf x="y">gone</rdf></metadata><g id="p" data-x="1" xml:space="preserve" style="fill: red;stroke:url(#p)">a &amp; b</g>', 'viewBox="0 0 1 1"'))
    assert kept.decode().split("\n", 1)[1] == '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1 1"><g id="p" fill="red" stroke="url(#p)">a &amp; b</g></svg>'
    assert svg.safe_svg(kept) == kept
    inside = [
        "<script/>", "<style>a</style>", '<use href="#a"/>', "<symbol/>", "<foreignObject/>", '<g onload="x"/>', '<g unknown="1"/>', '<g xmlns:x="y" x:fill="red"/>', '<x xmlns="y"/>',
        '<g fill="http://e/"/>', '<g fill="url(http://x)"/>', '<g fill="url(#none)"/>', '<g style="fill:url(http://x)"/>', '<g style="id:x"/>', '<g style="behavior:x"/>',
        '<g id="a"/><g id="a"/>', '<g href="#a"/>', '<g fill="a@b"/>', '<g fill="\\x"/>', "<g>" * 102 + "</g>" * 102, "<g/>" * 100_001,
    ]
    for bad in (*map(drawn, inside), b"<svg/>", b"<!DOCTYPE x><svg/>", b"<svg>", b"\xff", b"", drawn("\0"), drawn("<metadata>")):
        assert svg.svg_problem(bad), bad[:80]
    assert svg.png_problem(inline[:-8] + "AAAAAAAA") and svg.png_problem(inline + "AAAA") and svg.png_problem(inline[:40])


def test_inventory(spark, tmp_path):
    for name in ("m/index.html", "m/pages/1.html", "m/Pages2/x.txt", "d.pdf", ".DS_Store", "A.txt", "a.TXT", "m/b\tc.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-1 /Type /Page /Type/Pages /Type /Page" if name.endswith("pdf") else name.encode())
    members, failures = files.inventory(spark, str(tmp_path))
    assert {r["path"] for r in members.collect()} == {"m/index.html", "m/pages/1.html", "m/Pages2/x.txt", "d.pdf", "A.txt"}
    assert sorted((r["path"], r["code"]) for r in failures.collect()) == [("a.TXT", "path_collision"), ("m/b\tc.txt", "unsafe_path")]
    assert {(r["root"], r["format"]) for r in files.source_format(members).collect()} == {("m/", "html_export"), ("d.pdf", "pdf")}
    assert [(r["pages"], r["error"]) for r in files.pdf_pages(spark, str(tmp_path)).collect()] == [(2, None)]
    assert files.source_digest(members).first()["digest"] == files.source_digest(members.orderBy("size")).first()["digest"]


@pytest.mark.parametrize(("data", "error"), [(b"x", "not a PDF"), (b"%PDF-1 /Encrypt", "encrypted"), (b"%PDF-1 /ObjStm", "pages are inside object streams"), (b"%PDF-1", "no pages")])
def test_pdf_errors(data, error):
    assert files.pdf_page_count(data) == (None, error)


def test_limits_and_pages(spark):
    members = spark.createDataFrame([(k, f"f{k}", 10) for k in range(20)], "ord long, path string, size long")
    assert sorted(r["path"] for r in files.over_limits(members, most_files=18).collect()) == ["f18", "f19"]
    assert {r["code"] for r in files.over_limits(members, most_bytes=150).collect()} == {"total_size_limit"}
    docs = spark.createDataFrame([(1, "a\f\fc", "x\fy\f")], "id int, native string, ocr string")
    assert [(r["page"], r["text"], r["provenance"]) for r in files.page_texts(docs).orderBy("page").collect()] == [(1, "a", "native"), (2, "y", "ocr"), (3, "c", "native")]


def test_manifests_and_wiring(spark):
    good = "<book><code>C</code><type>t</type><title>A & B</title><vehicles><vehicle><year>2001</year><name>N</name><engine>E</engine></vehicle></vehicles></book>"
    assert files.manifest(good) == {"code": "C", "type": "t", "title": "A & B", "vehicles": [{"year": "2001", "name": "N", "engine": "E"}]}
    assert files.manifest("<code>C</code><year>2001</year><name>N</name><sections><title>no")["vehicles"] == [{"year": "2001", "name": "N", "engine": ""}]
    assert files.manifest("<x/>") is None
    sheets = spark.createDataFrame(
        [("S1", "<x><page><title>T</title><conn><name>c1</name><loc_view>S2</loc_view></conn><fuse><name>f</name></fuse></page></x>"), ("S2", "<page><conn><name>c2</name><loc_view>S9</loc_view></conn></page>"), ("S3", "<page>")],
        "sheet string, xml string",
    )
    assert sorted((r["sheet"], r["kind"], r["name"], r["view"]) for r in files.wiring_parts(sheets).collect()) == [("S1", "conn", "c1", "s2"), ("S1", "fuse", "f", ""), ("S2", "conn", "c2", "")]
    faces = files.connectors('<r><Connector CNumber="C1" Gender="M"><Face File="F.SVG"/><Pins><Pin Cavity="1"/></Pins></Connector></r>')
    assert faces[0]["faces"] == [{"file": "f.svg", "gender": "M", "pins": [{"cavity": "1", "circuit": "", "color": ""}]}]
    pages = spark.createDataFrame([(1, '<a href="z">before</a><h2>H</h2><a href="x"><b>X</b></a>')], "doc_id int, html string")
    assert [(r["heading"], r["title"], r["href"]) for r in files.toc(pages).orderBy("ord").collect()] == [(None, "before", "z"), ("H", "X", "x")]


def test_figures(spark):
    held = {"a.svg": b'<svg xmlns="http://www.w3.org/2000/svg"/>', "x.svg": b"<svg/>", "b.png": png(), "b.jpg": png(), "g.gif": b"GIF89a..", "c.bin": b"zz"}
    figures = spark.createDataFrame([*[(name, None) for name in (*held, "d")], ("e", "blocked")], "path string, reason string")
    members = spark.createDataFrame([(name, bytearray(data)) for name, data in held.items()], "path string, content binary")
    rows = files.figure_status(figures, members).collect()
    assert {r["path"]: r["status"] for r in rows} == {
        "a.svg": "safe_svg", "x.svg": "unsupported", "b.png": "raster", "b.jpg": "unsupported", "g.gif": "raster", "c.bin": "unsupported", "d": "missing", "e": "blocked"
    }
    assert {r["path"] for r in rows if r["svg"]} == {"a.svg"} and {r["path"]: r["detail"] for r in rows if r["detail"]} == {"x.svg": "root isn't an SVG element"}


def test_wiring_lookups(spark):
    sheets = spark.createDataFrame(
        [("S1", "<x><page><title>T</title><conn><name>C12</name></conn><conn><name>C12</name></conn><fuse><name>f</name></fuse></page></x>"), ("S2", "<page><conn><name>c12</name></conn><conn><name>C3</name></conn></page>")],
        "sheet string, xml string",
    )
    parts = files.wiring_parts(sheets)
    assert sorted((r["name"], r["sheet"]) for r in files.wiring_index(parts, "conn", "C1").collect()) == [("C12", "S1"), ("c12", "S2")]
    faces = '<r><Connector CNumber="C12" des="d"><Face File="F.SVG"/><Pins><Pin Cavity="1"/><Pin Cavity="2"/></Pins></Connector><Connector CNumber="C9"/></r>'
    held = files.connector_table(spark.createDataFrame([("x", faces), ("y", None), ("z", "<")], "sheet string, xml string"))
    assert sorted((r["name"], r["pins"]) for r in held.collect()) == [("C12", 2), ("C9", 0)]
    assert sorted(tuple(r) for r in files.connector_sheets(parts, held).collect()) == [("C12", "S1"), ("C12", "S2")]


def test_described_drawings(spark):
    desc = "<desc><x:Modelyear xmlns:x='y'>2005</x:Modelyear><Modelname> Ridge </Modelname><q><Qualifier>6.0L</Qualifier><Qualifier> </Qualifier><Qualifier>VIN X</Qualifier></q></desc>"
    held = [
        ("a.svg", f'<svg xmlns="http://www.w3.org/2000/svg"><g/>{desc}</svg>'), ("b.svg", "<svg><g><desc><Modelyear>1</Modelyear></desc></g></svg>"), ("c.svg", "<svg>"),
        ("d.svg", "<svg><desc><Qualifier>only</Qualifier></desc></svg>"), ("e.html", "<desc><Modelyear>1</Modelyear></desc>"),
    ]
    rows = files.described_vehicles(spark.createDataFrame([(n, bytearray(x.encode())) for n, x in held], "path string, content binary")).collect()
    assert sorted((r["path"], r["selector"], r["statement"], tuple(r["structured"])) for r in rows) == [
        ("a.svg", "svg-desc:qualifier:0", "2005 Ridge 6.0L", ("2005", "Ridge", "6.0L")), ("a.svg", "svg-desc:qualifier:1", "2005 Ridge VIN X", ("2005", "Ridge", "VIN X")),
        ("a.svg", "svg-desc:vehicle", "2005 Ridge", ("2005", "Ridge", "")), ("d.svg", "svg-desc:qualifier:0", "only", ("", "", "only")),
    ]


def test_image_pages(spark):
    listing = "page num type\n-----\n   1 0 image 5 5\n   3 1 smask\n   3 2 image\n x 1\n\n  12"
    rows = files.image_pages(spark.createDataFrame([("a.pdf", listing), ("b.pdf", "page\n---"), ("c.pdf", None)], "path string, listing string")).collect()
    assert sorted((r["path"], r["page"]) for r in rows) == [("a.pdf", 1), ("a.pdf", 3), ("a.pdf", 12)]


def test_zip_bytes_are_read_from_memory():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        out.writestr("a", "b")
    assert [r[1:] for r in archives.zip_rows("x", held.getvalue())] == [("a", 1, b"b", None)]


def test_folding_and_collisions_of_folders(spark):
    """Full folding for every code point that has one, and names that differ in a folder's case alone."""
    from pyspark.sql import functions as F

    from quire.functions import text as T

    odd = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000 and chr(k).casefold() != chr(k)]
    said = [f"a{c}b {c}" for c in odd] + ["Straße STRASSE straẞe", "ΑΣ ας ΑΣ.", "İstanbul", "plain", ""]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").select("k", T.casefold(F.col("s")).alias("f"), T.library_tokens(F.col("s")).alias("t")).collect()
    import re

    for r in rows:
        assert r["f"] == said[r["k"]].casefold(), repr(said[r["k"]])
    words = {r["k"]: r["t"] for r in rows}
    assert words[len(odd)] == ["strasse"] * 3 and words[len(odd) + 1] == ["ας".casefold()] * 3 and words[len(odd) + 2] == [w.casefold() for w in re.findall(r"\w+", "İstanbul")]
    members = spark.createDataFrame([(p,) for p in ("A/x.txt", "a/y.txt", "a/z.txt", "b/Straße/1", "b/STRASSE/2", "c", "C/d", "e/f")], "path string")
    assert {r["path"]: r["kept"] for r in files.collisions(members).collect()} == {"a/y.txt": "A", "a/z.txt": "A", "b/Straße/1": "b/STRASSE", "c": "C"}
