"""Every registered query against its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from lumisift.plans import library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    keys = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in keys) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = library.QUERIES[name](spark, SF)
    want = duck.sql(library.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, map(tuple, got.collect())) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert library.QUERIES[name](spark, SF).count() > 0


def test_entry_is_the_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert 0 < out.count() <= 50 and out.columns == ["id", "ts", "matched", "n_matched", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hot_paths_are_native(spark):
    for name in ("filter_any", "criteria_counts", "order_suspicion", "dup_pairs"):
        plan = library.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_nothing_in_the_library_imports_the_corpus_operators():
    top = Path(library.__file__).parents[1]
    for p in top.rglob("*.py"):
        if "llm" not in p.parts:
            assert "lumisift.llm" not in p.read_text()
