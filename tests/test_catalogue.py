"""Every registered query of the engine against its SQL, or at least for rows."""

import duckdb
import pytest

from tideline.plans import catalogue

SF = "/root/testdata/sf0.001"
SLOW = {"maximum_likelihood", "stream_session"}  # have tests of their own


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in catalogue.ORACLES:
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    columns = sorted(got.columns)
    keys = [c for c in got.columns if c in ("symbol", "ts_ns", "seq", "bucket", "price")]
    got, want = (f[columns].sort_values(keys).reset_index(drop=True) for f in (got, want))
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
