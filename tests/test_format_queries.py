"""Registered queries of files, results, accessors and limits against their SQL."""

import pytest
from test_queries import SF, duck, plain  # noqa: F401

from graphloom import format_queries, tables


@pytest.mark.parametrize("name", list(format_queries.QUERIES))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = format_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = duck.sql(format_queries.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    want = [tuple(dict(zip(sql.columns, r, strict=True))[c] for c in columns) for r in sql.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert got and plain(got) == plain(want)
    assert [t for _, t in sorted(df.dtypes)]


def test_names_do_not_clash():
    assert not set(format_queries.QUERIES) & set(tables.QUERIES)
    assert set(format_queries.QUERIES) == set(format_queries.ORACLE_SQL)
