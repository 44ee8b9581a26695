"""The driver's contract, with and without the llm folders."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from packetloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_catalog_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys()
    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())


@needs_data
@pytest.mark.parametrize("name", catalog.QUERIES)
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted((tuple(r) for r in want.select(*map(duckdb.ColumnExpression, columns)).fetchall()), key=str)


def test_imports_without_llm(tmp_path):
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "packetloom", tmp_path / "packetloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith(('op', 'pipeline'))]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    root = Path(__file__).resolve().parents[2] / "packetloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
