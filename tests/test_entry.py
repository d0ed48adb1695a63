"""Registered queries: the entry imports without the optional subpackage, and every query of its own has SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from codeloom.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parent.parent
TABLES = Path("/root/testdata/sf0.001")


def test_names():
    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_llm():
    hide = "import sys; sys.modules['codeloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", hide], cwd=ROOT, check=True)


@pytest.mark.skipif(not TABLES.is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found, told = QUERIES[name](spark, str(TABLES)), con.sql(SQL[name])
    names = sorted(found.columns)
    assert names == sorted(told.columns)
    rows = [tuple(r) for r in found.select(*names).collect()]
    assert sorted(rows) == sorted(told.project(", ".join(names)).fetchall())


@pytest.mark.skipif(not TABLES.is_dir(), reason="needs the driver's tables")
def test_files_of_a_code_base_are_parsed_by_all_cores(spark):
    assert QUERIES["class_attributes_of_source"](spark, str(TABLES)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not TABLES.is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["conjoined_methods", "shallow_class", "vague_name"])
def test_files_are_parsed_once(spark, name):
    """However many relations are made of the facts, these are read from a table."""
    assert "MapInArrow" not in QUERIES[name](spark, str(TABLES))._jdf.queryExecution().toString()


@pytest.mark.skipif(not TABLES.is_dir(), reason="needs the driver's tables")
def test_findings_are_not_sorted_to_be_suppressed(spark):
    plan = QUERIES["suppressed"](spark, str(TABLES))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
