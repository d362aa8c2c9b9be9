"""Every query of the library against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from huegrid.plans import queries


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def normal(rows):
    def cell(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v

    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, db, name):
    got = queries.QUERIES[name](spark, sf)
    want = db.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert rows, "the fixture makes no rows"
    assert normal(tuple(r) for r in got.select(*columns).collect()) == normal(rows)


def test_models_without_sql(spark, sf):
    labels = queries.QUERIES["cosine_kmeans"](spark, sf).collect()
    assert len(labels) == 500 and {r.label for r in labels} <= set(range(8))
    assert sorted(labels) == sorted(queries.QUERIES["cosine_kmeans"](spark, sf).collect())
    draws = queries.QUERIES["lfr_by_draw"](spark, sf).collect()
    assert len(draws) == 25 and all(0 <= r.flips <= r.pixels for r in draws)


def test_oracle_sql_is_sql_with_the_rows_of_its_query(spark, sf, db):
    import __spark_entry__

    known, found = __spark_entry__.oracle_sql(), __spark_entry__.queries()
    assert known.keys() <= found.keys() and all(isinstance(sql, str) for sql in known.values())
    for name in sorted(known.keys() - queries.ORACLE_SQL.keys()):  # test_query_equals_its_sql runs the library's own
        want = db.sql(known[name])
        columns = sorted(want.columns)
        assert normal(tuple(r) for r in found[name](spark, sf).select(*columns).collect()) == normal(want.select(*columns).fetchall())
