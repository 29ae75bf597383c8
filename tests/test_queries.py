"""Every query against its DuckDB version on the smallest tables, and what must hold without the llm subpackage."""

import ast
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return c


def _plain(v):
    if hasattr(v, "tzinfo"):
        v = v.replace(tzinfo=None)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    made = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(_plain(r[names.index(c)]) for c in cols) for r in made.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_subpackage():
    root = Path(entry.__file__).parent / "graphloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("graphloom.llm") or n == "corpus_pipeline" for n in names), path
