"""Every registered query against its check SQL, and properties of the answers."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.check_oracle import KINDS, rows_of
from wardline.registry import queries as registry

# those of the corpus operators have their own tests
QUERIES = {k: f for k, f in entry.queries().items() if k in registry.QUERIES}
ORACLE = {k: q for k, q in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_all_queries_have_a_check():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_check(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    res = db.execute(ORACLE[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    types = {d[0]: str(d[1]) for d in res.description}
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == types
    assert got == rows_of(res.fetchall(), columns)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len({(r.state, r.specialty) for r in rows}) == len(rows) == 150


def test_trust_stays_in_its_bounds(spark):
    for r in QUERIES["trust_parts"](spark, SMALL).collect():
        assert 0 <= r.trust_score <= 100
        assert 0 <= r.completeness <= 25 and 0 <= r.consistency <= 30
        assert 0 <= r.verifiability <= 25 and r.recency in (2.0, 8.0) and 0 <= r.digital <= 10


def test_ranks_are_dense_and_repeatable(spark):
    def run():
        return sorted(tuple(r) for r in QUERIES["search_batch"](spark, SMALL).select(
            "query_id", "rank", "gold_id", "silver_id").collect())
    first = run()
    assert first == run()
    by_query = {}
    for q, rank, _, _ in first:
        by_query.setdefault(q, []).append(rank)
    assert all(ranks == list(range(1, len(ranks) + 1)) for ranks in by_query.values())
