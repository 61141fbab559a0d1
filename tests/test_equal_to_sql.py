"""Prices of nil and cancelling sums: the queries against their SQL, to the last digit."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tideline.functions import book
from tideline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def with_nils(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("nils"))
    price = F.when(F.col("event_id") % 97 == 0, 0.0).otherwise(F.col("value"))
    spark.read.parquet(f"{SF}/events.parquet").withColumn("value", price).coalesce(1).write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", ["block_momentum", "cost_to_trade", "density_exponential", "density_rectangular", "volatility_yang_zhang", "volatility_parkinson", "volatility_close_to_close", "realized_volatility", "price_impact"])
def test_prices_of_nil(spark, with_nils, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{with_nils}/events.parquet/*.parquet'")
    want = {}
    cursor = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    for row in cursor.fetchall():
        r = dict(zip(columns, row, strict=True))
        want[tuple(r[k] for k in ("symbol", "bucket", "ts_ns", "seq") if k in r)] = r
    got = catalogue.QUERIES[name](spark, with_nils).collect()
    assert len(got) == len(want)
    odd = 0
    for row in got:
        r = row.asDict()
        w = want[tuple(r[k] for k in ("symbol", "bucket", "ts_ns", "seq") if k in r)]
        for c in columns:
            assert r[c] == w[c] or (r[c] is not None and w[c] is not None and r[c] != r[c] and w[c] != w[c]), (c, r[c], w[c])
            odd += isinstance(r[c], float) and (r[c] != r[c] or r[c] in (float("inf"), float("-inf")))
    assert odd or name.startswith("density") or name in ("price_impact", "cost_to_trade")


def test_a_level_that_costs_nothing(spark):
    levels = "array<struct<price: double, size: double>>"
    df = spark.createDataFrame([([(99.0, 10.0), (0.0, 1.0)], [(101.0, 10.0)])], f"bids {levels}, asks {levels}")
    got = df.select(*[c.alias(n) for n, c in book.cost_to_trade(F.col("bids"), F.col("asks"), 500.0).items()]).collect()[0]
    assert math.isnan(got["sell_bps"]) and got["sell_filled"] == 1 and got["buy_bps"] == pytest.approx(100)
