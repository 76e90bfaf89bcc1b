"""Every registered query runs; those with SQL equal DuckDB's result."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    value = lambda x: None if x is None or x is pd.NA or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(value(x) for x in row) for row in df.astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        want = con.sql(registry.ORACLES[name]).df()
        frame = got.toPandas()
        assert sorted(frame.columns) == sorted(want.columns)
        assert canon(frame) == canon(want)
    else:
        assert got.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("tessera/llm", "tests/llm"), ("corpus_pipeline.py",), ("tessera/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_llm_folders(tmp_path, gone):
    top = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(top, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n.startswith(".") or n == "__pycache__" or os.path.relpath(os.path.join(folder, n), top) in gone])
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    n = len(registry.QUERIES) + 10 * (tmp_path / "copy/tessera/llm/queries.py").exists()
    assert out.stdout.split() == [str(n), "False", "True"]


def test_scalar_functions_of_odd_urls(spark, tmp_path):
    """Long urls (base64 of more than 76 characters), urls without a host, and none at all."""
    urls = ["http://a.b/c", "x", "", "a/b", None, "http://é😀/ü?q=1&z", "//", "http:///x", "h\nx/y/z", "http://h/" + "u" * 200]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    con.execute(f"copy pages to '{tmp_path}/pages.parquet'")
    got = registry.QUERIES["scalar_functions"](spark, str(tmp_path)).toPandas()
    assert canon(got) == canon(con.execute(registry.ORACLES["scalar_functions"]).df())
