"""Every catalogued query against its SQL twin, over the whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomset.plans.catalog import CATALOG

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield db
    db.close()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(cell(row[i]) for i in order) for row in data), key=repr)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    types = dict(got.dtypes)
    loose = {"bigint", "int"}
    for column, kind, *_ in want.description:
        expected = KINDS.get(str(kind), "bigint")
        assert types[column] == expected or {types[column], expected} <= loose, column
    want_rows = rows(names, want.fetchall())
    assert want_rows, "a check on no rows shows nothing"
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want_rows


def test_every_query_has_a_twin():
    assert all(query.sql for query in CATALOG.values())
    assert set(CATALOG) <= set(entry.queries()) and set(CATALOG) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 4
