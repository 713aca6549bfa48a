"""Registered queries against DuckDB on the smallest tables, and the contract of the entry module."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from engram.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Long loops run in one of several variants here.
SLOW = {"executable_for_goal", "cascade_abort"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, float) else v
    return sorted(repr([clean(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_query_equals_oracle(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_returns_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_core_does_not_import_the_training_subpackage():
    import pathlib

    root = pathlib.Path(entry_module.__file__).parent / "engram"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "engram.llm" not in p.read_text()


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["provenance_or_filter"](spark, sf)._jdf.queryExecution().toString()
    scan = plan[plan.rindex("FileScan") :]
    assert "PushedFilters: [Or(" in scan and "text" not in scan[scan.index("ReadSchema") :].split("\n")[0]
