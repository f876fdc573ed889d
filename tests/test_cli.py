"""The command line."""

from quire.__main__ import main


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "m/pages").mkdir(parents=True)
    (tmp_path / "m/index.html").write_text("<h1>Home</h1>")
    (tmp_path / "m/pages/1.html").write_text("<h1>One</h1><p>text")
    assert main(["inspect", str(tmp_path)]) == 0
    assert main(["pages", str(tmp_path), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert main(["query", "extension_counts", "/root/testdata/sf0.001"]) == 0
    assert main(["query", "no_such_query", "/root/testdata/sf0.001"]) == 2
    assert main(["search", str(tmp_path), "s", "q", "--review", "r"]) == 2
    assert main(["normalize", str(tmp_path / "m"), str(tmp_path / "package")]) == 0
    assert main(["verify", str(tmp_path / "package")]) == 0 and main(["normalize", str(tmp_path / "m"), str(tmp_path / "package")]) == 2
    assert main(["extract", str(tmp_path / "m"), str(tmp_path / "copy")]) == 0 and main(["verify", str(tmp_path / "copy")]) == 0
    import quire.api

    assert len(quire.api.__all__) > 60
    assert "complete" in capsys.readouterr().out
