import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_every_group_is_covered():
    ids = {found.group() for name in entry_module.queries() if (found := re.match(r"[a-z]\d\d", name))}
    sizes = {"s": 16, "p": 20, "j": 18, "a": 24, "w": 9, "o": 8, "f": 42, "r": 6, "i": 16, "t": 5, "x": 12, "m": 22}
    missing = {f"{g}{n:02d}" for g, size in sizes.items() for n in range(1, size + 1)} - ids
    assert not missing
    assert {f"u{n}" for n in range(10, 17)} <= ids


@needs_data
def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["url", "price", "predicted_price", "predicted_price_diff", "distance_km"]
    df.collect()


def test_queries_load_without_the_corpus_operators(tmp_path):
    """With the two corpus folders gone, and corpus_pipeline.py there or not, the other queries are all registered."""
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", "tests")
    for name, also in (("kept", ()), ("gone", ("corpus_pipeline.py",))):
        copy = shutil.copytree(root, tmp_path / name, ignore=lambda d, names, also=also: {*skip(d, names), *also})
        told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert told.returncode == 0, told.stderr[-800:]
        from bindings import aggregates, changes, filters, joins, models, pages, scalars, streams

        assert set(told.stdout.split()) == {n for group in (aggregates, changes, filters, joins, models, pages, scalars, streams) for n in group.q.queries}
