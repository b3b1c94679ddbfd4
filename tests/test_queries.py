"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from talkgauge.plans import golden, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(str([None if x != x else x for x in r]) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", [q for q in queries.queries() if q not in golden.GOLDEN])
def test_query(spark, db, name):
    got = queries.queries()[name](spark, SF).toPandas()
    if sql := queries.oracle_sql().get(name):
        want = db.execute(sql).df()
        assert rows(got)[0] == rows(want)[0] and len(got) == len(want)
        assert [str(x).rstrip("0").rstrip(".") for x in rows(got)[1]] == [str(x).rstrip("0").rstrip(".") for x in rows(want)[1]]


def test_flagship(spark):
    assert queries.flagship(spark, SF).count() == 4
