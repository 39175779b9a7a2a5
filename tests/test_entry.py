"""The entry points: every query runs on the smallest tables, SQL names known queries."""

import duckdb
import pytest

import __spark_entry__ as entry_points

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def engine():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return db


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 2


def test_names_match():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, engine, name):
    frame = entry_points.queries()[name](spark, SMALL)
    rows = frame.collect()
    assert rows
    sql = entry_points.oracle_sql().get(name)
    if sql:
        result = engine.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert canonical(rows, frame.columns) == canonical(result.fetchall(), names)
