"""The entry module stands without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_training_operators(tmp_path):
    for name in ("__spark_entry__.py", "quire"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "quire/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scoped_search' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_the_rest_stands_alone(tmp_path):
    """Without both folders and the pipeline the other tests are all found, and those of the library's logic pass."""
    for name in ("__spark_entry__.py", "bench.py", "quire", "tests"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    for folder in ("quire/llm", "tests/llm"):
        shutil.rmtree(tmp_path / folder, ignore_errors=True)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True)
    assert found.returncode == 0 and "error" not in found.stdout.lower().splitlines()[-1], found.stdout[-500:]
    some = ["tests/test_shards.py", "tests/test_matching.py::test_every_reason_has_a_case", "tests/test_sources.py::test_drawings"]
    run = subprocess.run([sys.executable, "-m", "pytest", *some, "-q", "-k", "not many_blocks", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-500:]
    code = "import bench, quire.api, quire.__main__, quire.plans.catalog as c; assert c.QUERIES.keys() == c.ORACLE_SQL.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_it():
    for path in (ROOT / "quire").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quire.llm" not in path.read_text()
