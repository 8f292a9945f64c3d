"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry import corpus
from registry.oracle import ORACLE
from registry.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "pages", "conversations"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries())
    assert set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, name):
    table = queries()[name](spark, SF_DIR)
    cursor = database.execute(oracle_sql()[name])
    columns = [item[0] for item in cursor.description]
    assert sorted(table.columns) == sorted(columns)
    expected = ordered(cursor.fetchall(), columns)
    assert expected
    assert ordered([tuple(row) for row in table.collect()], table.columns) == expected


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["scan_totals", "remaining_findings"])
def test_the_damaged_corpus_is_made_once(spark, monkeypatch, name):
    made = []
    plain = corpus.made_corpus
    monkeypatch.setattr(corpus, "made_corpus", lambda *given, **named: made.append(1) or plain(*given, **named))
    queries()[name](spark, SF_DIR)
    assert len(made) == 1
