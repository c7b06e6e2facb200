"""Every registered query against its SQL counterpart on the same tables."""

import os
import pathlib

import pytest

from policyspark.catalog import load_all
from tests.helpers import plain, rows_of

QUERIES, SQL = load_all()
SLOW = {"text_classifier"}


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"text_classifier"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, duck, sf_dir):
    columns, got = rows_of(QUERIES[name](spark, sf_dir))
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in places) for row in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_no_cross_join(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_source_rules():
    root = pathlib.Path(__file__).resolve().parent.parent / "policyspark"
    for path in root.rglob("*.py"):
        text = path.read_text(encoding="utf-8")
        assert "localCheckpoint" not in text and "crossJoin" not in text, path
        assert "broadcast(" not in text, path
    assert os.path.isdir(root)
