"""A few registered queries against their SQL on the smallest tables, and the driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def test_every_query_is_named_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_stay_when_the_subpackage_cannot_be_imported(monkeypatch):
    def refuse(name):
        raise ImportError("no such library here", name="public_tokenizers")

    monkeypatch.setattr(entry.importlib, "import_module", refuse)
    with pytest.warns(UserWarning, match="left out"):
        names = set(entry.queries())
    assert "a1_bfs" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["g5_degree", "g15_delete_batch", "a4_khop", "n13_split", "v3_as_of", "m15_union", "p4_scan", "s8_merge", "agg8_unique", "io11_rmat"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in con.execute(entry.oracle_sql()[name]).description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)
