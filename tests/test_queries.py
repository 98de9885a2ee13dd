"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import os
import shutil
import subprocess
import sys

import pytest
from tests.compare import table

from quillspark import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = table([tuple(r) for r in df.collect()], df.columns)
    if name in SQL:
        want = duck.sql(SQL[name])
        assert got == table(want.fetchall(), list(want.columns))


def test_entry_survives_without_llm(tmp_path):
    """A copy of the repository without the llm folders and the pipeline still gives all other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    gone = {os.path.join(root, *x) for x in ((".git",), ("quillspark", "llm"), ("tests", "llm"), ("corpus_pipeline.py",))}
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if os.path.join(d, n) in gone or n == "__pycache__"])
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
    assert done.stdout.split() == sorted(QUERIES)


def test_entry_does_not_hide_a_missing_library(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{root}"}, capture_output=True, text=True, timeout=120)
    assert done.returncode and "a_library_that_is_not_there" in done.stderr
