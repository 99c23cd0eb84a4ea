"""Registered queries against their SQL, on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from glyphrake import catalog

TABLES = "/root/testdata/sf0.001"


def _rows(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{TABLES}/{name}')")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, TABLES)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]}) q").fetchall()
    assert _rows(got.select(*columns).collect()) == _rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("glyphrake/llm", "tests/llm"), ("glyphrake/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    """With those folders gone the entry point imports and lists the other queries, whether the pipeline's file stays or not."""
    root = Path(__file__).resolve().parents[1]
    for name in ("glyphrake", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    for name in gone:  # what is gone already, in a tree without those folders, stays gone
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        else:
            (tmp_path / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.QUERIES) and set(e.oracle_sql()) <= set(e.queries()))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert ran.stdout.strip() == "True", ran.stderr
