"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import ast
import glob
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def table(rows, columns):
    names = sorted(columns)
    at = [list(columns).index(n) for n in names]
    return names, sorted(repr(tuple(r[k] for k in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = table(df.collect(), df.columns)
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name])
        assert got == table(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_does_not_need_the_corpus_package():
    root = Path(__file__).parent.parent / "tidelog"
    for p in root.rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            assert not any("llm" in n.split(".") for n in names), p
