import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from snapweave import queries

SF = "/root/testdata/sf0.001"
FAST = ["scope_all", "plan_fast_forward", "plan_prune_force", "plan_tally", "first_parent_chains", "subdivided", "instant_rates", "bench_summary", "resolve_prefixes", "capabilities"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are absent")


def test_every_query_is_listed():
    assert set(queries.SQL) <= set(queries.QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = entry_module.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = con.sql(queries.SQL[name]).df()
    assert sorted(want.columns) == columns
    show = lambda x: "" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    rows = lambda frame: sorted(tuple(map(show, r)) for r in frame[columns].itertuples(index=False))
    assert rows(found.toPandas()) == rows(want)
