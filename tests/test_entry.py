"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from foliomill.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"tree_edit_distance"}


def test_it_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "foliomill", tmp_path / "foliomill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries() if n[2:3].isdigit() or n == 'pipeline'))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False"], out.stderr


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")
def test_entry_and_all_outline_queries_on_the_smallest_tables(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r.precision <= 1 for r in rows)
    for name, f in catalog.QUERIES.items():
        assert f(spark, str(DATA)).columns, name
