"""Codecs, registry, books from changes, and streams that equal their batch."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.functions import entities
from tideline.operators import books, calibration, filters, models, recurrent, registry
from tideline.operators.recurrent import scan
from tideline.plans import catalogue, views
from tideline.sources import codecs
from tideline.streaming import run, session


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


def test_json_ticks(spark):
    got = codecs.decode_json(lines(spark, ['{"ts":5,"values":{"1":2.5,"0":1},"rows":{"0":{"1":3}}}'])).first()
    assert got["ts_ns"] == 5 and got["values"] == {0: 1.0, 1: 2.5} and got["rows"] == {0: {1: 3.0}}
    with pytest.raises(Exception, match="not a tick"):
        codecs.decode_json(lines(spark, ['{"values":{"0":1}}'])).collect()
    back = codecs.decode_json(lines(spark, ['{"ts":5,"values":{"1":2.5,"0":1}}']))
    assert json.loads(back.select(codecs.encode_json(back)).first()[0])["values"] == {"0": 1.0, "1": 2.5}


def test_lenient_messages(spark):
    df = lines(spark, ['{"type":"hello"}', '{"ts":1,"values":{"0":"x","1":2}}', '{"ts":2,"values":{"0":"y"}}', "no json"])
    assert [r["values"] for r in codecs.decode_json_messages(df).collect()] == [{1: 2.0}]
    assert [r["values"] for r in codecs.decode_json_messages(df, remap={1: 7}).collect()] == [{7: 2.0}]


def test_csv_ticks(spark):
    got = codecs.decode_csv(lines(spark, ["5,1.5,,2", "6.0,3:4.5,0:1", "7"])).orderBy("ts_ns").collect()
    assert [(r["ts_ns"], r["values"]) for r in got] == [(5, {0: 1.5, 2: 2.0}), (6, {3: 4.5, 0: 1.0}), (7, {})]


def test_frames(spark):
    frame = codecs.encode_frame(9, {3: 1.5, 1: -2.0})
    assert codecs.decode_frame(frame) == (9, {1: -2.0, 3: 1.5}) and codecs.decode_frame(codecs.encode_frame(9, {})) == (9, {})
    assert codecs.decode_frame(b"\x08\0\x02\0\x01\0\0\0" + frame[8:]) is None
    with pytest.raises(ValueError):
        codecs.decode_frame(frame[:-1])
    df = spark.createDataFrame([(bytearray(frame),), (bytearray(codecs.encode_frame(4, {})),)], "frame binary")
    assert {(r["ts_ns"], tuple(sorted(r["values"].items()))) for r in codecs.decode_frames(df).collect()} == {(9, ((1, -2.0), (3, 1.5))), (4, ())}


def test_exchanges(spark):
    trade = '{"stream":"x","data":{"e":"trade","s":"AB","p":"1.5","q":"2","T":3,"m":true}}'
    got = codecs.decode_binance_trades(lines(spark, [trade, trade.replace("AB", "CD"), '{"e":"other"}']), {"AB": 4}).collect()
    assert [(r["channel"], r["ts_ns"], r["price"], r["sign"]) for r in got] == [(4, 3_000_000, 1.5, -1.0)]
    ticker = '{"type":"ticker","product_id":"AB","price":"9","best_bid":"1","best_ask":"2","time":"2024-01-01T00:00:01.123456789Z"}'
    got = codecs.decode_coinbase_tickers(lines(spark, [ticker, ticker.replace('"best_bid":"1",', "")])).collect()
    assert [r["price"] for r in got] == [1.5, 9.0] and got[0]["ts_ns"] == 1_704_067_201_123_456_789


def test_history(spark, tmp_path):
    df = spark.createDataFrame([(1, {0: 1.0}), (2, {0: 2.0})], "ts_ns long, values map<int,double>")
    codecs.write_history(df, str(tmp_path / "h"))
    (tmp_path / "h" / "extra.txt").write_text("# a remark\n\n")
    assert codecs.decode_json(codecs.read_history(spark, str(tmp_path / "h"))).count() == 2


def test_registry(spark):
    told = registry.describe()
    assert len(told) >= 40 and [t["category"] for t in told] == sorted((t["category"] for t in told), key=registry.CATEGORIES.index)
    df = spark.createDataFrame([("a", k, k, float(k + 1)) for k in range(40)], "symbol string, ts_ns long, seq long, price double")
    for name, m in registry.METRICS.items():
        if m.inputs == "prices":
            small = {k: 3 for k, v in m.defaults.items() if k in ("period", "window", "slow", "smooth", "level", "step", "calibration")} | {k: 2 for k in m.defaults if k in ("fast", "lag", "signal", "count")}
            assert set(m.outputs) <= set(registry.build({"type": name, **small})(df).columns)
    with pytest.raises(ValueError):
        registry.build({"type": "unknown"})
    with pytest.raises(ValueError):
        registry.METRICS["sma"](df, speed=1)
    registry.register("own", "price", "prices", ("x",), lambda df: df.withColumn("x", F.lit(1)))
    assert registry.build({"type": "own"})(df).first()["x"] == 1
    del registry.METRICS["own"]
    got = registry.values_of(df.withColumn("z", F.when(F.col("seq") > 0, F.col("price"))), {0: "z", 2: "price"}).orderBy("seq").collect()
    assert got[0]["values"] == {2: 1.0} and got[1]["values"] == {0: 2.0, 2: 2.0}


def test_books_from_changes(spark):
    deltas = spark.createDataFrame([("a", 1, 0, "bid", 99.0, 1.0), ("a", 1, 1, "bid", 98.0, 2.0), ("a", 2, 2, "ask", 101.0, 1.0), ("a", 3, 3, "bid", 99.0, 0.0), ("a", 3, 4, "ask", 101.0, 5.0)], "symbol string, ts_ns long, seq long, side string, price double, size double")
    at = spark.createDataFrame([("a", t) for t in (0, 2, 3)], "symbol string, ts_ns long")
    got = [([tuple(x) for x in r["bids"]], [tuple(x) for x in r["asks"]]) for r in books.from_deltas(deltas, at).orderBy("ts_ns").collect()]
    assert got == [([], []), ([(99, 1), (98, 2)], [(101, 1)]), ([(98, 2)], [(101, 5)])]


def test_entities(spark):
    bars = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 1.0, 0, 1), (1.0, 0.9, 0.5, 1.5, 1.0, 0, 1)], "open double, high double, low double, close double, volume double, open_ns long, close_ns long")
    good, bad = entities.split_valid(bars, "bar")
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(Exception, match="bar"):
        entities.require(bars, "bar").collect()


LLT = {"type": "local-linear-trend", "sigma_a": 1e-4, "half_spread": 20.0, "velocity_std": 1e-3}


def test_session_reorders_and_keeps_policies():
    make = lambda **o: session.Session(filters.make_filter(LLT), **o)
    s = make(reorder_ns=2, every=2)
    told = [x for ts in (1, 3, 2, 5, 4, 9) for x in s.offer(ts, ts, {0: float(ts)}, None)]
    told += s.flush(None)
    plain = filters.make_filter(LLT)
    for ts in (1, 2, 3, 4, 5, 9):
        plain.step(ts, {0: float(ts)})
    assert s.kalman.snapshot() == plain.snapshot() and [t for _, t in told] == [2, 4, 9] and s.dropped == 0
    late = make()
    for ts in (5, 3):
        late.offer(ts, ts, {0: 1.0}, None)
    assert late.dropped == 1 and late.kalman.steps == 1
    kept = make(late="retrodict")
    for ts in (1, 5, 3):
        kept.offer(ts * 1_000_000_000, ts, {0: float(ts)}, None)
    assert kept.retrodicted == 1
    with pytest.raises(ValueError):
        hard = make(late="fail")
        for ts in (5, 3):
            hard.offer(ts, ts, {0: 1.0}, None)


def test_commands():
    s = session.Session(filters.make_filter(LLT))
    s.offer(1, 1, {0: 10.0}, None)
    x = s.kalman.x.copy()
    s.offer(1, 2, None, {"kind": "split", "factors": {"0": 0.5, "1": 0.5}})
    assert s.kalman.x[0] == pytest.approx(x[0] / 2)
    s.offer(1, 3, None, {"kind": "dividend", "amounts": {"0": 1.0}})
    assert s.kalman.x[0] == pytest.approx(x[0] / 2 - 1)
    s.offer(1, 4, None, {"kind": "rebalance", "rows": [{"0": 2.0}], "variances": [1.0], "added": {"0": 5.0}})
    assert s.kalman.observation.rows == [{0: 2.0}]
    assert s.offer(1, 5, None, {"kind": "snapshot"}) == [("requested", 1)]
    s.offer(1, 6, None, {"kind": "reset", "x": [0.0, 0.0], "p": [1.0, 0.0, 0.0, 1.0]})
    assert s.kalman.steps == 0
    with pytest.raises(ValueError):
        s.offer(1, 7, None, {"kind": "dance"})


def test_stream_equals_batch(spark, sf):
    got = {r["symbol"]: r for r in run.final_states(spark, sf, LLT, files=2).collect()}
    steps = codecs.latest_state(filters.run_filter(views.kalman_ticks(spark, sf), LLT)).collect()
    assert len(got) == len(steps)
    for s in steps:
        assert got[s["symbol"]]["level"] == pytest.approx(s["x"][0], abs=1e-6) and got[s["symbol"]]["ll"] == pytest.approx(s["ll"], abs=1e-5)


def test_kernel_stream_equals_scan(spark, sf, tmp_path):
    ticks = views.user_ticks(spark, sf)
    cut = ticks.approxQuantile("ts_ns", [0.5], 0.0)[0]
    for part in (F.col("ts_ns") <= cut, F.col("ts_ns") > cut):
        ticks.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    make = lambda: recurrent.MovingAverage("ema", 5)
    got = run.run_to_end(session.scan_stream(stream, make), "append", str(tmp_path / "out"), str(tmp_path))
    want = scan(ticks, make)
    key = lambda r: (r["symbol"], r["ts_ns"], r["seq"])
    a, b = ({key(r): r["ema"] for r in d.collect()} for d in (got, want))
    assert a == b


def test_grid_adds_blind_ticks(spark):
    ticks = spark.createDataFrame([("a", 500_000_000, 0, {0: 1.0}), ("a", 3_200_000_000, 1, {0: 2.0})], "symbol string, ts_ns long, seq long, values map<int,double>")
    got = session.grid_ticks(ticks, 1)
    assert got.filter(F.size("values") == 0).count() == 3
    steps = filters.run_filter(got, LLT).orderBy("ts_ns").collect()
    assert len(steps) == 5 and not steps[1]["outcomes"]


def test_likelihood_and_calibration(spark, sf):
    rows = catalogue.QUERIES["innovation_likelihood"](spark, sf).collect()
    total = sum(s["ll"] for s in codecs.latest_state(filters.run_filter(views.kalman_ticks(spark, sf), LLT, start=catalogue.start_at_first)).collect())
    assert next(r["ll"] for r in rows if r["half_spread"] == 20.0) == pytest.approx(total, abs=0.01)
    assert models.build(LLT).motion.n == 2


def test_calibrations_run_to_their_ends(spark, sf):
    got = catalogue.QUERIES["maximum_likelihood"](spark, sf).collect()[0]
    # A search to a hundredth of the query's tolerance tells where the maximum is.
    best, ll = calibration.calibrate(views.kalman_ticks(spark, sf), LLT, calibration.Parameters({"half_spread": "log"}), tolerance=1e-8)
    assert got["half_spread"] == pytest.approx(best["half_spread"], rel=1e-3) and got["ll"] == pytest.approx(ll, abs=0.011)
    want = {r["symbol"]: r for r in calibration.em_by_key(views.user_ticks(spark, sf), catalogue.WALK, 30).collect()}
    for r in catalogue.QUERIES["expectation_maximisation"](spark, sf).collect():
        if r["q"] is not None:
            assert [r["q"], r["r"], r["ll"]] == pytest.approx([want[r["symbol"]][k][0] if k != "ll" else want[r["symbol"]][k] for k in ("q", "r", "ll")], abs=1e-5)
