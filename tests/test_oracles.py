"""Each query against its SQL, over the smallest tables; queries without SQL run and give rows."""

from __future__ import annotations

import duckdb
import pytest

from tracewarden.plans.queries import ORACLES, QUERIES

SLOW = {"record_linkage_window", "swap_in_clusters", "propensity_score"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = con.execute(ORACLES[name])
    order = [c[0] for c in result.description]
    assert sorted(order) == columns
    want = sorted((tuple(row[order.index(c)] for c in columns) for row in result.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
