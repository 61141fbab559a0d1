"""Filters against a plain recursion, each other, and known results."""

import math

import numpy as np
import pytest

from tideline.operators import calibration, filters, linalg, models, smoothing
from tideline.operators.diagnostics import AdaptiveNoise, SageHusa

RNG = np.random.default_rng(5)


def random_model(n=3, m=2):
    f = 0.5 * RNG.normal(size=(n, n))
    a, b = RNG.normal(size=(n, n)), RNG.normal(size=(n, n))
    rows = [dict(enumerate(RNG.normal(size=n))) for _ in range(m)]
    return models.Model(models.Discrete(f, a @ a.T / 10 + 0.01 * np.eye(n), RNG.normal(size=n)), models.Observation(rows, list(RNG.uniform(0.5, 2, m))), RNG.normal(size=n), b @ b.T + np.eye(n))


def textbook(model, readings):
    """Joint correction with an inverse."""
    f, q, u = model.motion.at(1.0)
    x, p, ll = model.x0.copy(), model.p0.copy(), 0.0
    for k, values in enumerate(readings):
        if k:
            x, p = f @ x + u, f @ p @ f.T + q
        if values:
            h = np.stack([model.observation.row(c, len(x)) for c in values])
            r = np.diag([model.observation.variances[c] for c in values])
            y, s = np.array(list(values.values())) - h @ x, h @ p @ h.T + r
            gain = p @ h.T @ np.linalg.inv(s)
            x, p = x + gain @ y, p - gain @ h @ p
            ll -= 0.5 * (y @ np.linalg.solve(s, y) + math.log(np.linalg.det(s)) + len(y) * math.log(2 * math.pi))
    return x, p, ll


@pytest.mark.parametrize("form", list(filters.FORMS))
def test_forms_match_the_textbook(form):
    for _ in range(5):
        model = random_model()
        readings = [{c: float(RNG.normal()) for c in range(2) if RNG.random() < 0.8} for _ in range(40)]
        k = filters.KalmanFilter(model, form)
        for t, v in enumerate(readings):
            k.step(t * 1_000_000_000, v)
        x, p, ll = textbook(model, readings)
        assert np.allclose(k.x, x, atol=1e-8) and np.allclose(k.p, p, atol=1e-8) and k.ll == pytest.approx(ll, rel=1e-7)


def test_first_reading_is_not_predicted_and_time_goes_on():
    k = filters.make_filter({"type": "local-linear-trend", "sigma_a": 0.1, "half_spread": 1.0})
    k.step(5_000_000_000, {0: 1.0})
    assert k.last_dt == 0 and k.steps == 1
    with pytest.raises(ValueError):
        k.step(4_000_000_000, {0: 1.0})
    k.step(5_000_000_000, {})
    assert k.last_dt == 0
    with pytest.raises(IndexError):
        k.step(6_000_000_000, {7: 1.0})


def test_gates():
    base = {"type": "local-linear-trend", "sigma_a": 0.1, "half_spread": 1.0}
    for gate in ({"kind": "sigma", "k": 3.0}, {"kind": "chi_square", "alpha": 0.01}):
        k = filters.make_filter(base, {"gate": gate})
        k.step(0, {0: 0.0})
        before = k.x.copy(), k.ll
        assert k.step(1_000_000_000, {0: 100.0})[0][3] == 0
        assert k.x[0] == before[0][0] + before[0][1] and k.ll == before[1]
    k = filters.make_filter(base, {"gate": {"kind": "huber"}})
    k.step(0, {0: 0.0})
    weight = k.step(1_000_000_000, {0: 100.0})[0][3]
    assert 0 < weight < 0.1 and 0 < k.x[0] < 100


def test_edits_and_snapshots():
    model = models.build({"type": "local-linear-trend", "sigma_a": 0.1, "half_spread": 1.0})
    k = filters.KalmanFilter(model)
    for t in range(5):
        k.step(t * 1_000_000_000, {0: float(t)})
    again = filters.KalmanFilter.restore(model, k.snapshot())
    assert np.array_equal(again.x, k.x) and np.array_equal(again.p, k.p) and again.ll == k.ll and again.ts == k.ts
    x, p = k.x.copy(), k.p.copy()
    k.scale(np.array([0.5, 0.5]))
    assert np.allclose(k.x, x / 2) and np.allclose(k.p, p / 4)
    k.shift(np.array([-1.0, 0.0]))
    assert k.x[0] == pytest.approx(x[0] / 2 - 1)


def test_retrodiction_equals_the_right_order():
    model = models.build({"type": "local-linear-trend", "sigma_a": 0.0001, "half_spread": 1.0})
    late, right = filters.KalmanFilter(model), filters.KalmanFilter(model)
    late.step(0, {0: 1.0}), late.step(2_000_000_000, {0: 3.0})
    assert filters.retrodict(late, 1_000_000_000, {0: 2.0}) is not None
    for t, z in ((0, 1.0), (1, 2.0), (2, 3.0)):
        right.step(t * 1_000_000_000, {0: z})
    assert np.allclose(late.x, right.x, atol=1e-6) and np.allclose(late.p, right.p, atol=1e-6)
    assert filters.retrodict(late, -5_000_000_000, {0: 2.0}) is None


def test_information_filter_starts_from_nothing():
    model = models.build({"type": "local-linear-trend", "sigma_a": 0.1, "half_spread": 1.0})
    f = filters.InformationFilter(model.motion, model.observation)
    f.step(0, {0: 1.0})
    assert f.mean() is None
    f.step(1_000_000_000, {0: 2.0})
    assert f.mean() is not None
    known = filters.InformationFilter(model.motion, model.observation, model.x0, model.p0)
    k = filters.KalmanFilter(model)
    for t, z in enumerate((1.0, 2.0, 2.5)):
        known.step(t * 1_000_000_000, {0: z}), k.step(t * 1_000_000_000, {0: z})
    assert np.allclose(known.mean(), k.x) and np.allclose(known.covariance(), k.p)


def test_gains_at_rest():
    model = models.build({"type": "local-linear-trend", "sigma_a": 0.1, "half_spread": 1.0})
    k, steady = filters.KalmanFilter(model), filters.SteadyStateFilter(model, 1.0)
    for t in range(500):
        k.step(t * 1_000_000_000, {0: math.sin(t / 10)})
    h = np.array([1.0, 0.0])
    f, q, _ = model.motion.at(1.0)
    p = f @ k.p @ f.T + q
    assert np.allclose(steady.k[:, 0], p @ h / (h @ p @ h + 1.0), atol=1e-9)
    ab = filters.AlphaBetaFilter.constant_velocity(0.1, 1.0, 1.0)
    assert ab.alpha == pytest.approx(steady.k[0, 0]) and ab.beta == pytest.approx(steady.k[1, 0])
    index = 0.1
    tracking = filters.AlphaBetaFilter.tracking(0.1, 1.0, 1.0)
    assert tracking.beta**2 / (1 - tracking.alpha) == pytest.approx(index**2)


def test_nonlinear_filters_agree_on_linear_models():
    model = random_model()
    model.motion = models.Blocks([models.ConstantVelocity(0.3), models.OrnsteinUhlenbeck(0.5, 1.0, 0.2)])
    k = filters.KalmanFilter(model)
    e, u = filters.ExtendedKalmanFilter(models.as_nonlinear(model)), filters.UnscentedKalmanFilter(models.as_nonlinear(model), alpha=0.5)
    for t in range(30):
        v = {c: float(RNG.normal()) for c in range(2)}
        for f in (k, e, u):
            f.step(t * 1_000_000_000, v)
    assert np.allclose(e.x, k.x) and np.allclose(u.x, k.x, atol=1e-6) and e.ll == pytest.approx(k.ll) and u.ll == pytest.approx(k.ll, rel=1e-6)


def test_nonlinear_models_follow_their_series():
    etf = models.log_price_etf([0.6, 0.4], np.diag([1e-4, 1e-4]), 0.1, 0.01, [1e-4, 1e-4], 0.01, [math.log(10), math.log(20)])
    f = filters.ExtendedKalmanFilter(etf)
    for t in range(50):
        f.step(t * 1_000_000_000, {0: math.log(10.5), 1: math.log(19.5), 2: 0.6 * 10.5 + 0.4 * 19.5})
    assert np.exp(f.x[:2]) == pytest.approx([10.5, 19.5], rel=1e-2) and abs(f.x[2]) < 0.05
    vol = filters.UnscentedKalmanFilter(models.volatility_with_leverage(-2.0, 0.95, 0.3, -0.5, 0.1), alpha=0.5, kappa=1.0)
    for t in range(200):
        vol.step(t * 1_000_000_000, {0: float(RNG.normal() * math.exp(-1))}, always=True)
    assert np.isfinite(vol.x).all() and linalg.is_positive_definite(vol.p + 1e-12 * np.eye(2))


def test_interacting_models_find_the_noisy_regime():
    quiet, loud = ({"type": "local-linear-trend", "sigma_a": 0.01, "half_spread": s} for s in (0.1, 5.0))
    f = filters.InteractingModels([filters.make_filter(quiet), filters.make_filter(loud)], [[0.95, 0.05], [0.05, 0.95]])
    for t in range(100):
        f.step(t * 1_000_000_000, {0: float(RNG.normal(0, 5 if t >= 50 else 0.1))})
        if t == 45:
            assert f.regime == 0
    assert f.regime == 1 and f.mu.sum() == pytest.approx(1)


def test_rts_equals_the_joint_posterior():
    model = models.build({"type": "local-linear-trend", "sigma_a": 0.5, "half_spread": 1.0})
    readings = RNG.normal(size=6)
    k, steps = filters.KalmanFilter(model), []
    for t, z in enumerate(readings):
        k.step(t * 1_000_000_000, {0: z})
        dt, x, p = k.prior
        steps.append({"dt": dt, "x": k.x.copy(), "p": k.p.copy(), "x_prior": x, "p_prior": p})
    got = smoothing.rauch_tung_striebel(steps, lambda dt: model.motion.at(dt)[0])
    f, q, _ = model.motion.at(1.0)
    n = len(readings)
    mean, cov = np.zeros(2 * n), np.zeros((2 * n, 2 * n))
    marginal = [model.p0]
    for _ in range(n - 1):
        marginal.append(f @ marginal[-1] @ f.T + q)
    for i in range(n):
        for j in range(i, n):
            block = np.linalg.matrix_power(f, j - i) @ marginal[i]
            cov[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = block
            cov[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = block.T
    h = np.zeros((n, 2 * n))
    h[range(n), range(0, 2 * n, 2)] = 1
    gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + np.eye(n))
    post, pcov = gain @ readings, cov - gain @ h @ cov
    for i in range(n):
        assert np.allclose(got[i][0], post[2 * i : 2 * i + 2]) and np.allclose(got[i][1], pcov[2 * i : 2 * i + 2, 2 * i : 2 * i + 2])
        if i < n - 1:
            assert np.allclose(got[i][2], pcov[2 * i + 2 : 2 * i + 4, 2 * i : 2 * i + 2])
    lagged = smoothing.FixedLagSmoother(filters.KalmanFilter(model), n - 1)
    last = [lagged.step(t * 1_000_000_000, {0: z}) for t, z in enumerate(readings)][-1]
    assert np.allclose(last[0], got[0][0])
    assert not mean.any()


def test_discretisations_agree():
    for dt in (0.01, 0.7, 3.0):
        cv = models.ConstantVelocity(0.4).at(dt)
        dense = models.Dense(np.array([[0.0, 1.0], [0.0, 0.0]]), np.array([[0.0], [1.0]]), np.array([[0.16]])).at(dt)
        singer = models.Singer(0.4, 2.0).at(dt)
        reverting = models.Dense(np.array([[0.0, 1.0], [0.0, -0.5]]), np.array([[0.0], [1.0]]), np.array([[0.16]])).at(dt)
        assert np.allclose(cv[0], dense[0]) and np.allclose(cv[1], dense[1])
        assert np.allclose(singer[0], reverting[0]) and np.allclose(singer[1], reverting[1], rtol=1e-8, atol=1e-14)
        ca = models.ConstantAcceleration(0.4).at(dt)
        dense = models.Dense(np.diag([1.0, 1.0], 1), np.array([[0.0], [0.0], [1.0]]), np.array([[0.16]])).at(dt)
        assert np.allclose(ca[0], dense[0]) and np.allclose(ca[1], dense[1])
        f, q, u = models.OrnsteinUhlenbeck(0.5, 2.0, 0.4).at(dt)
        d = models.Dense(np.array([[-0.5]]), np.array([[1.0]]), np.array([[0.16]]), np.array([1.0])).at(dt)
        assert np.allclose(f, d[0]) and np.allclose(q, d[1]) and np.allclose(u, d[2])


def test_whitened_readings_equal_joint_ones():
    rows, r = [{0: 1.0}, {0: 1.0, 1: 2.0}], np.array([[1.0, 0.4], [0.4, 2.0]])
    x0, p0, z = np.zeros(2), np.array([[2.0, 0.3], [0.3, 1.0]]), [0.7, -1.2]
    white = models.Whitened.of(rows, r, 2)
    k = filters.KalmanFilter(models.Model(models.Discrete(np.eye(2), np.eye(2)), white.observation, x0, p0))
    k.step(0, white.values(z))
    h = models.Observation(rows, [1, 1]).matrix(2)
    s = h @ p0 @ h.T + r
    assert np.allclose(k.x, p0 @ h.T @ np.linalg.solve(s, z))
    ll = -0.5 * (np.array(z) @ np.linalg.solve(s, z) + math.log(np.linalg.det(s)) + 2 * math.log(2 * math.pi))
    assert k.ll + white.shift == pytest.approx(ll)


def test_chi_square():
    assert linalg.chi2_quantile(0.95, 1) == pytest.approx(3.841458820694124, rel=1e-12)
    assert linalg.chi2_quantile(0.05, 10) == pytest.approx(3.940299136, rel=1e-8)
    assert linalg.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    lo, hi = linalg.chi2_mean_bounds(1, 100)
    assert lo < 1 < hi


def test_expm_and_observability():
    assert np.allclose(linalg.expm(np.array([[0.0, 5.0], [-5.0, 0.0]])), [[math.cos(5), math.sin(5)], [-math.sin(5), math.cos(5)]])
    assert linalg.observability_rank(np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])) == 2
    assert linalg.observability_rank(np.eye(2), np.array([[1.0, 0.0]])) == 1


def test_consistency_of_a_simulated_model():
    model = models.build({"type": "local-linear-trend", "sigma_a": 0.2, "half_spread": 1.0})
    f, q, _ = model.motion.at(1.0)
    x, root, k = RNG.multivariate_normal(model.x0, model.p0), np.linalg.cholesky(q), filters.KalmanFilter(model)
    nis, nees = [], []
    for t in range(3000):
        if t:
            x = f @ x + root @ RNG.normal(size=2)
        (_, y, s, _), = k.step(t * 1_000_000_000, {0: x[0] + RNG.normal()})
        nis.append(y * y / s)
        nees.append(linalg.nees(x - k.x, k.p))
    assert 0.92 < np.mean(nis) < 1.08 and 1.8 < np.mean(nees) < 2.2


def test_parameters_and_minimum():
    config = {"motion": {"type": "random-walk", "sigma": 2.0}, "variances": [4.0], "cov": [[2.0, 0.5], [0.5, 1.0]]}
    p = calibration.Parameters({"motion.sigma": "log", "variances.0": "linear", "cov": "cholesky:2"})
    theta = p.theta(config)
    again = p.apply(config, theta)
    assert again["motion"]["sigma"] == pytest.approx(2) and again["variances"] == pytest.approx([4]) and np.allclose(again["cov"], config["cov"])
    best, value = calibration.minimise(lambda points: [float((q[0] - 1) ** 2 + 10 * (q[1] + 2) ** 2) for q in points], calibration.spread_starts(np.zeros(2), 3))
    assert np.allclose(best, [1, -2], atol=1e-2) and value < 1e-4
    starts = calibration.spread_starts(np.array([3.0, -1.0]), 5, 2.0)
    assert len(starts) == 5 and np.array_equal(starts[0], [3, -1]) and all(np.abs(s - starts[0]).max() <= 2 for s in starts)
    valley = lambda points: [float(100 * (q[1] - q[0] ** 2) ** 2 + (1 - q[0]) ** 2) if q[0] > -3 else math.inf for q in points]
    assert calibration.minimise(valley, starts, tolerance=1e-10, most=4000)[1] < 0.05
    asked = []
    calibration.minimise(lambda points: asked.append(len(points)) or [float(abs(q[0] - 0.3)) for q in points], [np.zeros(1)], most=7)
    assert len(asked) <= 7 and max(asked) <= 3
    assert calibration.minimise(lambda points: [math.inf] * len(points), [np.zeros(2)], most=20)[1] == math.inf


def test_em_raises_the_likelihood_and_finds_noise():
    true_q, true_r, x, z = 0.04, 1.0, 0.0, []
    for _ in range(600):
        x += RNG.normal() * math.sqrt(true_q)
        z.append({0: x + RNG.normal() * math.sqrt(true_r)})
    config = {"motion": {"type": "random-walk", "sigma": 1.0}, "rows": [{"0": 1.0}], "variances": [0.2]}
    ts = [k * 1_000_000_000 for k in range(600)]
    lls = [calibration.expectation_maximisation(config, ts, z, rounds)[2] for rounds in (1, 5, 30)]
    q, r, _ = calibration.expectation_maximisation(config, ts, z, 30)
    assert lls[0] < lls[1] < lls[2] and 0.01 < q[0, 0] < 0.12 and 0.8 < r[0] < 1.2


def test_backtest_report():
    z = np.sin(np.arange(200) / 20)
    told = calibration.backtest({"type": "local-linear-trend", "sigma_a": 0.02, "half_spread": 0.1}, [k * 1_000_000_000 for k in range(200)], [{0: float(v + RNG.normal() * 0.1)} for v in z], np.stack([z, np.gradient(z)], 1))
    assert told["rmse_smoothed"][0] < told["rmse"][0] < 0.1 and 0 <= told["lag"] <= 20


def test_sage_husa_finds_the_reading_variance():
    k = filters.make_filter({"type": "local-linear-trend", "sigma_a": 0.01, "half_spread": 0.3})
    adaptive = AdaptiveNoise(k, SageHusa(k.observation.variances))
    for t in range(2000):
        adaptive.step(t * 1_000_000_000, {0: float(RNG.normal())})
    assert 0.6 < k.observation.variances[0] < 1.5


def test_profile_and_registry():
    p = models.IntradayProfile.u_shape(9 * 3600, 17 * 3600).normalised()
    assert p.at(0) > 0 and np.mean([p.at(int(s) * 1_000_000_000) for s in range(0, 86_400, 60)]) == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValueError):
        models.build({"type": "unknown"})
    models.register("own", models.local_linear_trend)
    assert models.build({"type": "own", "sigma_a": 1.0, "half_spread": 1.0}).motion.n == 2
