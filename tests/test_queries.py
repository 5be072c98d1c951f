"""Every query with SQL against DuckDB, the contract, and import without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lakeask.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    if name in SQL:
        wanted = duck.sql(SQL[name])
        assert sorted(wanted.columns) == columns
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert got == sorted(map(str, duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()))
    else:
        assert got


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_llm_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for p in [root / "__spark_entry__.py", *root.glob("lakeask/**/*.py")]:
        if "llm" not in p.relative_to(root).parts:
            to = tmp_path / p.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) == len(QUERIES), done.stderr
