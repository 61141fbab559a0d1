"""Series that go side by side, against the filters that go one by one."""

import copy

import numpy as np
import pyarrow as pa
import pytest

from tideline.operators import calibration, filters, models, side_by_side, smoothing
from tideline.operators.side_by_side import Runs, frame_sums

VELOCITY = {"motion": {"type": "constant-velocity", "sigma_a": 0.1}, "rows": [{"0": 1.0}], "variances": [4.0], "p0_diag": [4.0, 1.0]}
WALK = {"motion": {"type": "random-walk", "sigma": 0.5}, "rows": [{"0": 1.0}], "variances": [4.0], "p0_diag": [4.0]}


def drawn(lengths=(40, 3, 17, 1), seed=3):
    random = np.random.default_rng(seed)
    key = np.repeat([f"k{i}" for i in range(len(lengths))], lengths)
    ts = np.concatenate([np.cumsum(random.integers(1, 5, n)) for n in lengths]) * 1_000_000_000
    z = np.concatenate([50 + np.cumsum(random.normal(0, 1, n)) + random.normal(0, 2, n) for n in lengths])
    return key, ts, z


@pytest.mark.parametrize("config", [WALK, VELOCITY])
def test_expectation_maximisation_of_many(config):
    key, ts, z = drawn()
    ts[43:60] = ts[43]  # one series stands still
    runs = Runs({"symbol": pa.array(key)}, ("symbol",))
    q, r, ll = calibration.em_side_by_side(config, runs, ts, z, 10)
    for i, (s, n) in enumerate(zip(runs.starts, runs.lengths, strict=True)):
        if n < 3:
            continue
        own = copy.deepcopy(config) | {"x0": [z[s], *[0.0] * (len(config["p0_diag"]) - 1)]}
        want = calibration.expectation_maximisation(own, ts[s : s + n].tolist(), [{0: v} for v in z[s : s + n].tolist()], 10)
        assert np.allclose(q[:, :, i], want[0], rtol=1e-7, atol=1e-12)
        assert np.allclose(r[:, i], want[1], rtol=1e-7) and ll[i] == pytest.approx(want[2], rel=1e-9)


def test_expectation_maximisation_takes_gaps_and_short_series(spark):
    rows = [("a", k * 1_000_000_000, k, None if k == 4 else 50.0 + k % 3) for k in range(12)] + [("b", 0, 0, 1.0), ("b", 1, 1, 2.0)]
    got = {r["symbol"]: r for r in calibration.em_by_key(spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, price double"), WALK, 5).collect()}
    values = [{} if p is None else {0: p} for _, _, _, p in rows[:12]]
    q, r, ll = calibration.expectation_maximisation(WALK | {"x0": [50.0]}, [t for _, t, _, _ in rows[:12]], values, 5)
    assert got["a"]["q"] == pytest.approx(q.ravel().tolist()) and got["a"]["r"] == pytest.approx(r) and got["a"]["ll"] == pytest.approx(ll)
    assert got["b"]["q"] is None and got["b"]["r"] is None and got["b"]["ll"] is None


def test_frame_sums_go_by_blocks_of_the_partition():
    x = np.random.default_rng(5).normal(0, 1e6, 300).round(2)
    got = frame_sums(x, 7, 40)
    for i in (0, 1, 9, 100, 260):
        a, total, at = i + 7, 0.0, i
        while at < i + 40:
            if (at + 7) % 16 == 0 and at + 16 <= i + 40:
                block = 0.0
                for v in x[at : at + 16]:
                    block += v
                total, at = total + block, at + 16
            else:
                total, at = total + x[at], at + 1
        assert got[i] == total, a


LLT = {"type": "local-linear-trend", "sigma_a": 0.1, "half_spread": 2.0, "velocity_std": 0.5}


def one_by_one(make, key, ts, z):
    out, held, f = [], None, None
    for k, t, v in zip(key, ts.tolist(), z.tolist(), strict=True):
        if k != held:
            held, f = k, make(v)
        out.append(f(t, v))
    return np.array(out)


def scanned(make, names, key, ts, z):
    columns = {"symbol": pa.array(key), "ts_ns": pa.array(ts), "price": pa.array(z)}
    held, state, clock, out = None, [], 0, []
    for at in range(0, len(z), 13):
        part = {c: a.slice(at, 13) for c, a in columns.items()}
        runs = Runs(part, ("symbol",), held)
        own, prices = ts[at : at + 13], z[at : at + 13]
        many, first = make(prices[runs.starts]), own[runs.starts].copy()
        if runs.goes_on is not None:
            first[runs.goes_on] = clock
            for a, v in zip(many.arrays(), state, strict=True):
                a[..., runs.goes_on] = v
        made = np.empty((len(prices), len(names)))
        dt = (own - runs.before(own, first)) / 1e9
        for _, rows in runs.steps():
            made[rows] = np.array(many.step(dt[rows], prices[rows])).T
        held, clock, state = runs.held, own[-1], [a[..., runs.last].copy() for a in many.arrays()]
        out.append(made)
    return np.concatenate(out)


def test_interacting_models_of_many():
    key, ts, z = drawn()
    ts[5] = ts[4]
    regimes, turn = [LLT | {"half_spread": 1.0}, LLT | {"half_spread": 6.0}], [[0.95, 0.05], [0.05, 0.95]]

    def make(first):
        kalmans = [filters.make_filter(r) for r in regimes]
        for k in kalmans:
            k.x[0] = first
        f = filters.InteractingModels(kalmans, turn)
        return lambda t, v: (f.step(t, {0: v}), f.x[0], f.mu[1], f.regime)[1:]

    got = scanned(lambda first: side_by_side.ManyModels([models.build(r) for r in regimes], turn, first), "abc", key, ts, z)
    assert np.allclose(got, one_by_one(make, key, ts, z), rtol=1e-9)


def test_unscented_filters_of_many():
    key, ts, z = drawn()
    ts[5] = ts[4]

    def make(first):
        model = models.as_nonlinear(models.build(LLT))
        model.x0 = np.array([first, 0.0])
        f = filters.UnscentedKalmanFilter(model, alpha=1.0, kappa=1.0)
        return lambda t, v: (f.step(t, {0: v}), f.x[0], f.x[1] * 100, f.p[0, 0] ** 0.5)[1:]

    got = scanned(lambda first: side_by_side.UnscentedFilters(models.build(LLT), first, alpha=1.0, kappa=1.0), "abc", key, ts, z)
    assert np.allclose(got, one_by_one(make, key, ts, z), rtol=1e-8)


def test_filter_and_lagged_smoother_of_many(spark):
    """Several channels, gaps and a gate, against one filter; the lagged states against the smoother of single steps."""
    random = np.random.default_rng(8)
    key, ts, z = drawn((30, 2, 9))
    values = [{c: float(v + c) for c in range(2) if random.random() < 0.7} for v in z]
    model = {"motion": {"type": "constant-velocity", "sigma_a": 0.1}, "rows": [{"0": 1.0}, {"0": 1.0, "1": 0.5}], "variances": [4.0, 2.0], "p0_diag": [4.0, 1.0], "x0": [50.0, 0.0]}
    df = spark.createDataFrame([(k, t, i, v) for i, (k, t, v) in enumerate(zip(key.tolist(), ts.tolist(), values, strict=True))], "symbol string, ts_ns long, seq long, values map<int,double>")
    for gate in (None, {"kind": "sigma", "k": 1.0}, {"kind": "huber"}):
        got = filters.run_filter(df, model, {"gate": gate}).orderBy("seq").collect()
        held = None
        for r, v in zip(got, values, strict=True):
            if r["symbol"] != held:
                held, f = r["symbol"], filters.make_filter(model, {"gate": gate})
            told = f.step(r["ts_ns"], v)
            assert r["x"] == pytest.approx(f.x.tolist()) and r["p"] == pytest.approx(f.p.ravel().tolist()) and r["ll"] == pytest.approx(f.ll)
            assert r["x_prior"] == pytest.approx(f.prior[1].tolist()) and r["p_prior"] == pytest.approx(f.prior[2].ravel().tolist())
            assert [tuple(o) for o in r["outcomes"]] == [pytest.approx(t) for t in told]
    lagged = {r["seq"]: r["xs"] for r in smoothing.smooth_lagged(filters.run_filter(df, model), model, 3).collect()}
    held, own = None, []
    for i, (k, t, v) in enumerate(zip(key.tolist(), ts.tolist(), values, strict=True)):
        if k != held:
            held, f = k, smoothing.FixedLagSmoother(filters.make_filter(model), 3)
        told = f.step(t, v)
        if told is not None:
            assert lagged[i - 3] == pytest.approx(told[0].tolist())
            own.append(i - 3)
    assert all((x is not None) == (i in own) for i, x in lagged.items())


def test_likelihood_of_a_candidate_that_breaks(spark):
    key, ts, z = drawn((5, 4))
    df = spark.createDataFrame([(k, t, i, {0: v}) for i, (k, t, v) in enumerate(zip(key.tolist(), ts.tolist(), z.tolist(), strict=True))], "symbol string, ts_ns long, seq long, values map<int,double>")
    got = calibration.log_likelihoods(df, VELOCITY, calibration.Parameters({"variances.0": "linear"}), [[4.0], [-1e9]])
    want = 0.0
    for name in ("k0", "k1"):
        f = filters.make_filter(VELOCITY)
        own = np.flatnonzero(key == name)
        f.x[0] = z[own[0]]
        for i in own:
            f.step(int(ts[i]), {0: float(z[i])})
        want += f.ll
    assert got == [pytest.approx(want), -np.inf]


def test_a_long_series_in_pieces(spark):
    """Pieces in different tasks, segments and buffers, times that tie, against one filter."""
    random = np.random.default_rng(9)
    ts = np.sort(random.integers(0, 900, 1500)) * 1_000_000_000
    rows = [("ab"[i % 2], int(t), i, {int(c): float(v)} if i % 9 else {}) for i, (t, c, v) in enumerate(zip(ts, random.integers(0, 3, 1500), 50 + random.normal(0, 5, 1500).cumsum() / 5, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, values map<int,double>")
    config = {"type": "multi-venue", "sigma_a": 1e-2, "tau": 50.0, "sigma": 5.0, "variances": [4.0] * 3, "first": 50.0, "velocity_std": 1e-1}
    got = {r["seq"]: r for r in side_by_side.filter_long(df, models.build(config), rows=200).collect()}
    assert len(got) == 1500
    for symbol in "ab":
        f = filters.make_filter(config)
        for s, t, i, v in rows:
            if s == symbol:
                f.step(t, v)
                assert got[i]["x"] == pytest.approx(f.x.tolist(), rel=1e-7, abs=1e-7) and got[i]["p"] == pytest.approx(f.p.ravel().tolist(), rel=1e-6, abs=1e-8) and got[i]["ll"] == pytest.approx(f.ll, rel=1e-9)
