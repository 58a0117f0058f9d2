"""Every registered query against its SQL, over the whole small tables."""

import pytest

from skylag import catalog

SPARK_TO_SQL = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}
SLOW = {"m09_m12_m16_logistic_metrics", "m10_m17_boosted_trees_metrics"}


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def _rows(rows, order):
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


# One key of the smallest table is not unique, so an order by it is not total there.
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    result = catalog.QUERIES[name](spark, sf_dir)
    expected = duck.sql(catalog.ORACLES[name])
    assert sorted(result.columns) == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: SPARK_TO_SQL[t] for c, t in result.dtypes} == types
    by_name = sorted(result.columns)
    got = _rows(result.collect(), [result.columns.index(c) for c in by_name])
    want = _rows(expected.fetchall(), [expected.columns.index(c) for c in by_name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - SLOW))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
