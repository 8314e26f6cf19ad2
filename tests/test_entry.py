"""The registered queries against DuckDB on the smallest tables, and the independence of the core."""

import glob
import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    own = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert own == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)


def test_null_keys_are_joined_whole(spark, tmp_path):
    spark.createDataFrame([(i, n) for i, n in enumerate(["A", None, "B", None, "", "a"], 1)], "emp_row long, EmployeeName string").write.parquet(f"{tmp_path}/employees.parquet")
    spark.createDataFrame([(i, n) for i, n in enumerate([None, "A", "", "C"], 1)], "info_row long, EmployeeName string").write.parquet(f"{tmp_path}/employee_info.parquet")
    got = {tuple(r) for r in entry.queries()["join_null_keys_whole"](spark, str(tmp_path)).collect()}
    assert got == {("A", 1, 2), (None, 2, 1), (None, 4, 1), ("", 5, 3)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_does_not_import_the_llm_part():
    for p in (ROOT / "quern").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.MULTILINE), p
