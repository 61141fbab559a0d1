"""Pinned values, degenerate cases and plain re-implementations."""

import copy
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import book
from tideline.operators import bars, cross, recurrent, rolling, trend_filters
from tideline.operators.recurrent import scan
from tideline.plans import catalogue

CLOSES = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00]


def series(spark, values, symbol="a"):
    return spark.createDataFrame([(symbol, k * 1_000_000_000, k, float(v)) for k, v in enumerate(values)], "symbol string, ts_ns long, seq long, price double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("symbol", "ts_ns", "seq"))).collect()]


def test_rsi_textbook(spark):
    got = column(scan(series(spark, CLOSES), lambda: recurrent.Rsi(14)), "rsi")
    assert got[:14] == [None] * 14
    assert got[14] == pytest.approx(70.4641, abs=1e-4)
    assert got[15] == pytest.approx(66.2496, abs=1e-4)


def test_rsi_without_movement_is_50(spark):
    assert column(scan(series(spark, [5] * 20), lambda: recurrent.Rsi(14)), "rsi")[-1] == 50
    assert column(rolling.rsi_sma(series(spark, [5] * 20), 14), "rsi")[-1] == 50


def test_realized_volatility(spark):
    assert column(rolling.realized_volatility(series(spark, [1, 2, 1]), 2), "realized")[-1] == pytest.approx(math.log(2))
    assert column(scan(series(spark, [1, 2, 1]), lambda: recurrent.EwmaVolatility(0.94)), "ewma_volatility")[-1] == pytest.approx(math.log(2))


def test_long_and_short_frames_agree(spark):
    values = (np.random.default_rng(1).normal(0, 1, 300).cumsum() + 1e6).round(6)
    df = series(spark, values)
    got = column(rolling.normalized_price(df, 100), "z")
    want = [(values[k] - values[k - 99 : k + 1].mean()) / values[k - 99 : k + 1].std() for k in range(99, 300)]
    assert got[:99] == [None] * 99
    assert np.allclose(got[99:], want, atol=1e-6)


def test_constant_window_has_no_z(spark):
    assert column(rolling.normalized_price(series(spark, [3.1] * 120), 100), "z")[-1] is None
    assert column(rolling.normalized_price(series(spark, [3.1] * 40), 10), "z")[-1] is None


def test_averages_start_when_full(spark):
    for kind, alpha in (("ema", 2 / 5), ("rma", 1 / 4)):
        got = column(scan(series(spark, CLOSES), lambda k=kind: recurrent.MovingAverage(k, 4)), kind)
        v = sum(CLOSES[:4]) / 4
        assert got[:3] == [None] * 3 and got[3] == pytest.approx(v)
        for x, g in zip(CLOSES[4:], got[4:], strict=True):
            v += alpha * (x - v)
            assert g == pytest.approx(v)
    wma = column(scan(series(spark, CLOSES), lambda: recurrent.MovingAverage("wma", 4)), "wma")
    assert wma[3:] == pytest.approx(column(rolling.wma(series(spark, CLOSES), 4), "wma")[3:])


def test_macd_of_any_average_and_promql(spark):
    assert recurrent.Macd.promql().fast.kind == "sma"
    got = column(scan(series(spark, range(40)), recurrent.Macd.promql), "macd")
    assert got[15] is None and got[16] == pytest.approx(4.5)


def test_scan_carries_state_over_batches(spark):
    values = list(range(50))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = column(scan(series(spark, values), lambda: recurrent.MovingAverage("ema", 5)), "ema")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == column(scan(series(spark, values), lambda: recurrent.MovingAverage("ema", 5)), "ema")


def bar_rows(spark, rows):
    return spark.createDataFrame([("a", k, float(o), float(h), float(lo), float(c)) for k, (o, h, lo, c) in enumerate(rows)], "symbol string, open_ns long, open double, high double, low double, close double")


def test_adx_outside_bar(spark):
    rows = bar_rows(spark, [(10, 12, 8, 10), (10, 14, 9, 12), (12, 13, 7, 9)])
    got = scan(rows, lambda: recurrent.Adx(1), order=("open_ns",)).orderBy("open_ns").collect()
    assert got[0]["plus_di"] is None
    assert got[1]["plus_di"] == pytest.approx(100 * 2 / 5)
    assert got[2]["minus_di"] == pytest.approx(100 * 2 / 6)


def test_flat_bars(spark):
    rows = bar_rows(spark, [(5, 5, 5, 5)] * 30)
    assert column(rolling.cci(rows), "cci", "open_ns")[-1] == 0
    assert column(rolling.stochastic(rows), "percent_k", "open_ns")[-1] == 50
    assert column(rolling.ohlc_volatility(rows, 10, "yang_zhang"), "sigma", "open_ns")[-1] == 0


def test_price_metrics_pass_nonpositive_prices(spark):
    got = rolling.price_delta(series(spark, [1, -1, 2])).orderBy("seq").collect()
    assert [r["log_return"] for r in got] == [None, None, None]


def trades(spark, rows):
    return spark.createDataFrame([("a", k, k, float(p), float(s), float(g)) for k, (p, s, g) in enumerate(rows)], "symbol string, ts_ns long, seq long, price double, size double, sign double")


def test_unknown_sides_count_as_sold(spark):
    got = rolling.volume_profile(trades(spark, [(1, 10, 1), (1, 10, -1), (1, 10, 0)]), 3, 3).orderBy("seq").collect()
    assert got[-1]["delta"] == -10 and got[0]["volume"] == 10 and got[-1]["volume_z"] is None


def test_vwap_bands(spark):
    got = rolling.vwap(trades(spark, [(10, 1, 0), (20, 3, 0), (99, 0, 0)])).orderBy("seq").collect()
    assert got[1]["vwap"] == pytest.approx(17.5) and got[1]["sigma"] == pytest.approx(math.sqrt(18.75))
    assert got[2]["vwap"] == pytest.approx(17.5) and got[2]["deviation"] == pytest.approx(81.5 / 17.5)


def test_volume_clock_splits_and_bars_do_not(spark):
    rows = trades(spark, [(10, 25, 1), (11, 5, -1), (12, 10, 0)])
    got = bars.volume_buckets(rows, 10.0).orderBy("bucket").collect()
    assert [(r["buy"], r["sell"]) for r in got] == [(10, 0), (10, 0), (5, 5), (5, 5)]
    greedy = recurrent.volume_bars(rows, 20.0, flush=True).orderBy("bucket").collect()
    assert [r["volume"] for r in greedy] == [25, 15]
    assert [r["volume"] for r in recurrent.volume_bars(rows, 20.0).collect()] == [25]


def test_time_bars_leave_the_open_one(spark):
    rows = series(spark, [1, 2, 3, 4, 5])
    assert bars.time_bars(rows, 2).count() == 2 and bars.time_bars(rows, 2, flush=True).count() == 3


def books(spark, bids, asks):
    level = "array<struct<price:double,size:double>>"
    return spark.createDataFrame([([(float(a), float(b)) for a, b in bids], [(float(a), float(b)) for a, b in asks])], f"bids {level}, asks {level}").select(book.normalise(F.col("bids"), True).alias("bids"), book.normalise(F.col("asks"), False).alias("asks"))


def measures(df, made):
    return df.select(*[v.alias(k) for k, v in made(F.col("bids"), F.col("asks")).items()]).first().asDict()


def test_book_slope_of_one_level(spark):
    assert measures(books(spark, [(99, 10)], [(101, 10)]), book.slope)["bid_slope"] == pytest.approx(1000)


def test_books_are_put_in_order_and_empty_sides_have_no_measure(spark):
    df = books(spark, [(98, 1), (99, 2), (97, 0), (-1, 3)], [(103, 1), (101, 2)])
    row = df.first()
    assert [x["price"] for x in row["bids"]] == [99, 98] and [x["price"] for x in row["asks"]] == [101, 103]
    empty = books(spark, [], [(101, 2)])
    for made in (book.imbalance, book.density, book.weighted_prices, book.slope, book.cost_to_trade):
        assert all(v is None for v in measures(empty, made).values())


def test_cost_to_trade_tells_what_was_filled(spark):
    got = measures(books(spark, [(99, 1)], [(101, 1), (102, 100)]), lambda b, a: book.cost_to_trade(b, a, 1010.0))
    assert got["sell_bps"] is None and got["sell_filled"] == pytest.approx(99 / 1010)
    bought = 1 + (1010 - 101) / 102
    assert got["buy_bps"] == pytest.approx((1010 / bought - 100) / 100 * 1e4)


def test_basket_of_opposite_moves(spark):
    rows = spark.createDataFrame([(s, t, p, 1.0) for s, ps in (("x", (1.0, 2.0)), ("y", (2.0, 1.0))) for t, p in enumerate(ps)], "symbol string, ts_ns long, price double, size double")
    got = cross.basket_return(rows, ["x", "y"]).orderBy("ts_ns").collect()
    assert got[0]["basket"] is None and got[1]["basket"] == pytest.approx(0) and got[1]["dispersion"] == pytest.approx(math.log(2))


def test_missing_constituents_leave_the_time_out(spark):
    rows = spark.createDataFrame([("x", 0, 1.0, 1.0), ("y", 0, 1.0, 1.0), ("x", 1, 1.0, 1.0)], "symbol string, ts_ns long, price double, size double")
    assert cross.basket_return(rows, ["x", "y"]).count() == 1


def test_roll_needs_three_prices(spark):
    assert column(rolling.roll_spread(series(spark, [1, 2])), "roll", "symbol") == [None]
    assert column(rolling.roll_spread(series(spark, [1, 2, 1, 2, 1])), "roll", "symbol")[0] == pytest.approx(2 * math.sqrt(1))


def test_empty_series(spark):
    none = series(spark, [])
    assert rolling.normalized_price(none, 50).count() == 0
    assert scan(none, lambda: recurrent.Macd()).count() == 0
    assert bars.time_bars(none, 60).count() == 0


def test_bad_ticks_are_undefined_and_change_no_state(spark):
    kernels = [recurrent.MovingAverage("ema", 3), recurrent.Rsi(3), recurrent.Macd(2, 3, 2), recurrent.EwmaVolatility(0.9), recurrent.TimedEma(1.0), recurrent.TimedMacd(1.0, 2.0, 1.0), trend_filters.TrendFilter(0.1, 1.0), trend_filters.FilteredDerivative(0.01, None, 4)]
    good = [10.0, 11.0, 10.5, 12.0, 11.0, 13.0, 12.5, 12.0, 14.0, 13.0]
    for kernel in kernels:
        make = lambda k=kernel: copy.deepcopy(k)
        plain = [r.asDict() for r in scan(series(spark, good), make).orderBy("seq").collect()]
        for odd in (None, float("nan")):
            mixed = [x for p in good for x in (p, odd)]
            rows = [("a", 2 * (k // 2 + 1) * 1_000_000_000, k, p) for k, p in enumerate(mixed)]
            got = scan(spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, price double"), make).orderBy("seq").collect()
            clean = scan(spark.createDataFrame([r for k, r in enumerate(rows) if k % 2 == 0], "symbol string, ts_ns long, seq long, price double"), make).orderBy("seq").collect()
            for name in kernel.outputs:
                assert [r[name] for r in got[::2]] == [r[name] for r in clean]
                assert kernel.takes_gaps or all(r[name] is None for r in got[1::2])
        assert len(plain) == len(good)
    zero = column(scan(series(spark, [1, 0, 2, -3, 1]), lambda: recurrent.EwmaVolatility(0.5)), "ewma_volatility")
    assert [zero[k] for k in (0, 1, 3)] == [None] * 3 and zero[2] == pytest.approx(math.log(2)) and zero[4] == pytest.approx(math.log(2))


def test_queries_bear_zero_negative_and_missing_prices(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    odd = F.when(F.col("event_id") % 41 == 0, 0.0).when(F.col("event_id") % 43 == 0, -F.col("value")).when(F.col("event_id") % 47 == 0, None).otherwise(F.col("value"))
    spark.read.parquet(f"{sf}/events.parquet").withColumn("value", odd).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("ewma_volatility", "stochastic_volatility", "time_varying_beta", "normalized_z", "price_delta", "ema", "rsi_wilder", "macd", "macd_timed", "kalman_llt", "kalman_form_ud", "filtered_derivative", "rsi_lagged", "realized_volatility", "range_volatility"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).count() if name in catalogue.QUERIES else True, name
