"""Every registered query against its SQL, on whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from rivulet.plans.oracles import ORACLES
from rivulet.plans.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)
    assert set(REGISTRY) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["event_time", "ticker", "price", "dt", "hr"]


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, sf_dir, db, name):
    df = REGISTRY[name](spark, sf_dir)
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(ORACLES[name])
    theirs = normal([c[0] for c in cursor.description], cursor.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1]) > 0
    for left, right in zip(ours[1], theirs[1]):
        for a, b in zip(left, right):
            assert type(a) is type(b)
            assert a == b or (isinstance(a, float) and math.isnan(a) and math.isnan(b))
