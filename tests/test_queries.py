"""Every registered query of the engine against its SQL."""

import os

import duckdb
import pytest

from graphloom import tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", list(tables.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = tables.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = duck.sql(tables.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    want = [tuple(dict(zip(sql.columns, r, strict=True))[c] for c in columns) for r in sql.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want)


def test_optional_then_join_is_over_all_documents(spark):
    import pandas as pd

    sf = "/root/testdata/sf0.01"
    docs, labels, events = (pd.read_parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels", "events"))
    want = docs[["doc_id"]].merge(events[["event_id", "value"]], left_on="doc_id", right_on="event_id").merge(labels[["doc_id", "quality"]], on="doc_id", how="left")
    rows = [(d, None if pd.isna(q) else int(q), v if v > 1000000 else None) for d, q, v in zip(want.doc_id, want.quality, want.value, strict=True)]
    df = tables.QUERIES["optional_then_join"](spark, sf)
    assert len(rows) == 1000 and plain((r.d, r.q, r.c) for r in df.collect()) == plain(rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_are_pruned_and_filtered(spark):
    from graphloom.tables import PREFIXES, engine

    df = engine(spark, SF).select(PREFIXES + "SELECT ?o ?t { ?o orders:o_totalprice ?t FILTER(?t > 1000) }", {"o": "local"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderpriority" not in plan and "Join" not in plan


def test_stars_and_optional_columns_are_one_scan(spark):
    from graphloom.tables import PREFIXES, engine

    df = engine(spark, SF).select(PREFIXES + "SELECT * { ?c a :customer ; customer:c_name ?n ; customer:c_acctbal ?b OPTIONAL { ?c customer:c_mktsegment ?s } }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
