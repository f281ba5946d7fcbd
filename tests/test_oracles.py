"""Every query of the engine against its oracle in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lacuna import queries, queries_alignment, queries_bundles, queries_capture, queries_contracts, queries_crossing, queries_curves, queries_fields, queries_more, queries_paths, queries_ranges, queries_reports, queries_source, queries_trust  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        return plain(value.item())
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    right = sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=key)
    assert left == right
