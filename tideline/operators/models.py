"""State-space models: motions with exact discretisation, observations, and the finance catalogue built on them.

A motion gives F, Q and the control over dt seconds. An observation gives, per channel, a row of coefficients and a variance. ``build``
makes a filter's parts from a plain dict, which is what reaches the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tideline.operators.linalg import van_loan


class Motion:
    n: int

    def at(self, dt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """F, Q, control."""
        raise NotImplementedError

    def many(self, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The same over many intervals, on the last axis."""
        own, which = np.unique(dt, return_inverse=True)
        f, q, u = zip(*(self.at(float(d)) for d in own), strict=True)
        return np.stack(f, -1)[..., which], np.stack(q, -1)[..., which], None if u[0] is None else np.stack(u, -1)[..., which]


def ou(theta: float, sigma: float, dt: float) -> tuple[float, float]:
    """Decay and variance of an Ornstein-Uhlenbeck process; a random walk at theta 0."""
    if theta == 0:
        return 1.0, sigma * sigma * dt
    return math.exp(-theta * dt), sigma * sigma * -math.expm1(-2 * theta * dt) / (2 * theta)


@dataclass
class RandomWalk(Motion):
    sigma: float
    n: int = 1

    def at(self, dt):
        return np.eye(1), np.array([[self.sigma**2 * dt]]), None


@dataclass
class ConstantVelocity(Motion):
    sigma_a: float
    n: int = 2

    def at(self, dt):
        q = self.sigma_a**2
        return np.array([[1.0, dt], [0.0, 1.0]]), q * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]), None

    def many(self, dt):
        one, none = np.ones_like(dt), np.zeros_like(dt)
        return np.array([[one, dt], [none, one]]), self.sigma_a**2 * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]), None


@dataclass
class WhiteAcceleration(Motion):
    """Acceleration constant over a step and independent between steps."""

    sigma_a: float
    n: int = 2

    def at(self, dt):
        g = np.array([dt**2 / 2, dt])
        return np.array([[1.0, dt], [0.0, 1.0]]), self.sigma_a**2 * np.outer(g, g), None


@dataclass
class ConstantAcceleration(Motion):
    sigma_j: float
    n: int = 3

    def at(self, dt):
        q = np.array([[dt**5 / 20, dt**4 / 8, dt**3 / 6], [dt**4 / 8, dt**3 / 3, dt**2 / 2], [dt**3 / 6, dt**2 / 2, dt]])
        return np.array([[1.0, dt, dt**2 / 2], [0.0, 1.0, dt], [0.0, 0.0, 1.0]]), self.sigma_j**2 * q, None


@dataclass
class OrnsteinUhlenbeck(Motion):
    theta: float
    mu: float
    sigma: float
    n: int = 1

    def at(self, dt):
        f, q = ou(self.theta, self.sigma, dt)
        return np.array([[f]]), np.array([[q]]), np.array([self.mu * (1 - f)])

    @property
    def half_life(self) -> float:
        return math.log(2) / self.theta if self.theta > 0 else math.inf

    @classmethod
    def of_half_life(cls, half_life: float, mu: float, sigma: float) -> OrnsteinUhlenbeck:
        return cls(math.log(2) / half_life, mu, sigma)


@dataclass
class Singer(Motion):
    """Position and a velocity that reverts with time constant tau."""

    sigma: float
    tau: float
    n: int = 2

    def at(self, dt):
        a, s2, tau = dt / self.tau, self.sigma**2, self.tau
        one, two = -math.expm1(-a), -math.expm1(-2 * a)
        if a < 0.05:  # the differences below cancel: their power series
            pp = sum((-1) ** (k + 1) * (2 ** (k - 1) - 2) * a**k / math.factorial(k) for k in range(3, 17))
            pv = sum((-1) ** k * (2 ** (k - 1) - 1) * a**k / math.factorial(k) for k in range(2, 17))
        else:
            pp, pv = a - 2 * one + two / 2, one - two / 2
        q = s2 * np.array([[tau**3 * pp, tau**2 * pv], [tau**2 * pv, tau * two / 2]])
        return np.array([[1.0, tau * one], [0.0, 1 - one]]), q, None


@dataclass
class Blocks(Motion):
    """Independent motions side by side."""

    parts: list[Motion]

    @property
    def n(self) -> int:
        return sum(p.n for p in self.parts)

    def at(self, dt):
        f, q, u, at, steered = np.zeros((self.n, self.n)), np.zeros((self.n, self.n)), np.zeros(self.n), 0, False
        for part in self.parts:
            own, to = part.at(dt), slice(at, at + part.n)
            f[to, to], q[to, to] = own[0], own[1]
            if own[2] is not None:
                u[to], steered = own[2], True
            at += part.n
        return f, q, u if steered else None


@dataclass
class Dense(Motion):
    """Any linear stochastic differential equation, by Van Loan."""

    a: np.ndarray
    g: np.ndarray
    qc: np.ndarray
    drift: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.a)

    def at(self, dt):
        return van_loan(self.a, self.g, self.qc, dt, self.drift)


@dataclass
class Discrete(Motion):
    """Fixed F, Q and control, whatever dt."""

    f: np.ndarray
    q: np.ndarray
    u: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.f)

    def at(self, dt):
        return np.asarray(self.f, float), np.asarray(self.q, float), self.u

    @classmethod
    def of(cls, motion: Motion, dt: float) -> Discrete:
        return cls(*motion.at(dt))


@dataclass
class Scaled(Motion):
    """A motion whose Q_ij is multiplied by s_i s_j and by a factor, both of which may change."""

    motion: Motion
    scales: np.ndarray
    factor: float = 1.0

    @property
    def n(self) -> int:
        return self.motion.n

    def at(self, dt):
        f, q, u = self.motion.at(dt)
        return f, q * np.outer(self.scales, self.scales) * self.factor, u


@dataclass
class Observation:
    """rows[channel]: coefficients by state; variances[channel]. Both may be changed while a filter runs."""

    rows: list[dict[int, float]]
    variances: list[float]
    names: list[str] = field(default_factory=list)

    def row(self, channel: int, n: int, own: dict | None = None) -> np.ndarray:
        if not 0 <= channel < len(self.rows):
            raise IndexError(f"no channel {channel}")
        h = np.zeros(n)
        for j, c in (own or self.rows[channel]).items():
            h[int(j)] = c
        return h

    def matrix(self, n: int) -> np.ndarray:
        return np.stack([self.row(k, n) for k in range(len(self.rows))])


@dataclass
class Whitened:
    """Channels of a joint covariance turned into independent ones of variance 1; all channels are needed. ``shift`` adds to ll."""

    observation: Observation
    lower: np.ndarray
    shift: float

    @classmethod
    def of(cls, rows: list[dict[int, float]], covariance: np.ndarray, n: int) -> Whitened:
        low = np.linalg.cholesky(np.asarray(covariance, float))
        h = np.linalg.solve(low, Observation(rows, [1.0] * len(rows)).matrix(n))
        return cls(Observation([{j: c for j, c in enumerate(r) if c} for r in h], [1.0] * len(rows)), low, -float(np.log(np.diag(low)).sum()))

    def values(self, z: list[float]) -> dict[int, float]:
        return dict(enumerate(np.linalg.solve(self.lower, np.asarray(z, float)).tolist()))


@dataclass
class Model:
    motion: Motion
    observation: Observation
    x0: np.ndarray
    p0: np.ndarray
    form: str = "sequential"


# ---- finance


def local_linear_trend(sigma_a: float, half_spread: float, tick: float = 0.0, first: float = 0.0, velocity_std: float = 1.0) -> Model:
    r = half_spread**2 + tick**2 / 12
    return Model(ConstantVelocity(sigma_a), Observation([{0: 1.0}], [r], ["price"]), np.array([first, 0.0]), np.diag([r, velocity_std**2]))


@dataclass
class BasketMotion(Motion):
    """k prices with joint noise, their velocities, and a premium that reverts to nil."""

    covariance: np.ndarray
    sigma_v: np.ndarray
    theta: float
    sigma_premium: float

    @property
    def n(self) -> int:
        return 2 * len(self.covariance) + 1

    def at(self, dt):
        k = len(self.covariance)
        f, q = np.eye(2 * k + 1), np.zeros((2 * k + 1, 2 * k + 1))
        v = np.diag(np.asarray(self.sigma_v, float) ** 2)
        f[:k, k : 2 * k] = dt * np.eye(k)
        q[:k, :k] = np.asarray(self.covariance) * dt + v * dt**3 / 3
        q[:k, k : 2 * k] = q[k : 2 * k, :k] = v * dt**2 / 2
        q[k : 2 * k, k : 2 * k] = v * dt
        f[-1, -1], q[-1, -1] = ou(self.theta, self.sigma_premium, dt)
        return f, q, None


def basket_observation(weights: list[float], quote_variances: list[float], etf_variance: float) -> Observation:
    k = len(weights)
    etf = {i: w for i, w in enumerate(weights) if w} | {2 * k: 1.0}
    return Observation([{i: 1.0} for i in range(k)] + [etf], [*quote_variances, etf_variance], [*(f"q{i}" for i in range(k)), "etf"])


def etf_basket(weights, covariance, sigma_v, theta: float, sigma_premium: float, quote_variances, etf_variance: float, first, velocity_std: float = 0.1, premium_std: float = 0.05) -> Model:
    k = len(weights)
    p0 = np.diag([4 * r for r in quote_variances] + [velocity_std**2] * k + [premium_std**2])
    return Model(BasketMotion(np.asarray(covariance, float), sigma_v, theta, sigma_premium), basket_observation(weights, quote_variances, etf_variance), np.array([*first, *[0.0] * k, 0.0]), p0)


def pairs_hedge(q_alpha: float, q_beta: float, r: float, theta: float | None = None, sigma: float | None = None, alpha0: float = 0.0, beta0: float = 1.0, alpha_std: float = 1.0, beta_std: float = 0.5) -> Model:
    """y = alpha + beta x (+ a reverting spread); the row holds x and comes with each tick. q: variances a second."""
    parts: list[Motion] = [RandomWalk(math.sqrt(q_alpha)), RandomWalk(math.sqrt(q_beta))]
    x0, p0, row = [alpha0, beta0], [alpha_std**2, beta_std**2], {0: 1.0, 1: 0.0}
    if theta is not None:
        parts.append(OrnsteinUhlenbeck(theta, 0.0, sigma))
        x0, p0, row = [*x0, 0.0], [*p0, sigma**2 / (2 * theta)], row | {2: 1.0}
    return Model(Blocks(parts), Observation([row], [r], ["y"]), np.array(x0), np.diag(p0), "ud")


def time_varying_beta(q_alpha: float, q_beta: float, r: float, alpha0: float = 0.0, beta0: float = 1.0, alpha_std: float = 0.01, beta_std: float = 0.5) -> Model:
    """r_a = alpha + beta r_m; the row holds r_m and comes with each tick."""
    return Model(Blocks([RandomWalk(math.sqrt(q_alpha)), RandomWalk(math.sqrt(q_beta))]), Observation([{0: 1.0, 1: 0.0}], [r], ["ra"]), np.array([alpha0, beta0]), np.diag([alpha_std**2, beta_std**2]))


@dataclass
class VenueMotion(Motion):
    venues: int
    sigma_a: float
    tau: float
    sigma: float

    @property
    def n(self) -> int:
        return self.venues + 1

    def at(self, dt):
        f, q, _ = ConstantVelocity(self.sigma_a).at(dt)
        d = math.exp(-dt / self.tau)
        wide_f, wide_q = np.diag([1.0, 1.0] + [d] * (self.venues - 1)), np.diag([0.0, 0.0] + [self.sigma**2 * (1 - d * d)] * (self.venues - 1))
        wide_f[:2, :2], wide_q[:2, :2] = f, q
        return wide_f, wide_q, None

    def many(self, dt):
        wide_f, wide_q = np.zeros((self.n, self.n, len(dt))), np.zeros((self.n, self.n, len(dt)))
        wide_f[:2, :2], wide_q[:2, :2], _ = ConstantVelocity(self.sigma_a).many(dt)
        d = np.exp(-dt / self.tau)
        for j in range(2, self.n):
            wide_f[j, j], wide_q[j, j] = d, self.sigma**2 * (1 - d * d)
        return wide_f, wide_q, None


def multi_venue(sigma_a: float, tau: float, sigma: float, variances: list[float], first: float = 0.0, velocity_std: float = 1.0) -> Model:
    """One price seen at venues whose offsets from the first one decay."""
    v = len(variances)
    rows = [{0: 1.0}] + [{0: 1.0, 1 + k: 1.0} for k in range(1, v)]
    return Model(VenueMotion(v, sigma_a, tau, sigma), Observation(rows, list(variances)), np.array([first] + [0.0] * v), np.diag([variances[0], velocity_std**2] + [sigma**2] * (v - 1)))


def microprice(sigma_a: float, half_spread: float, tick: float, depth_scale: float, first: float = 0.0, velocity_std: float = 1.0) -> Model:
    """Mid, and the size-weighted price whose variance is depth_scale over the depth and comes with each tick."""
    r = half_spread**2 + tick**2 / 12
    return Model(ConstantVelocity(sigma_a), Observation([{0: 1.0}, {0: 1.0}], [r, depth_scale], ["mid", "micro"]), np.array([first, 0.0]), np.diag([r, velocity_std**2]))


def micro_reading(bid: float, bid_size: float, ask: float, ask_size: float, depth_scale: float, floor: float = 1e-12) -> tuple[float, float]:
    depth = bid_size + ask_size
    return (bid * ask_size + ask * bid_size) / depth, max(floor, depth_scale / depth)


@dataclass
class BounceMotion(Motion):
    sigma_a: float
    sigma_nu: float
    rho: float
    interval: float
    n: int = 3

    def at(self, dt):
        f, q, _ = ConstantVelocity(self.sigma_a).at(dt)
        d = math.copysign(abs(self.rho) ** (dt / self.interval), self.rho)
        wide_f, wide_q = np.diag([1.0, 1.0, d]), np.diag([0.0, 0.0, self.sigma_nu**2 * (1 - d * d)])
        wide_f[:2, :2], wide_q[:2, :2] = f, q
        return wide_f, wide_q, None


def bid_ask_bounce(sigma_a: float, sigma_nu: float, rho: float, interval: float, tick: float, first: float = 0.0, velocity_std: float = 1.0) -> Model:
    return Model(BounceMotion(sigma_a, sigma_nu, rho, interval), Observation([{0: 1.0, 2: 1.0}], [tick**2 / 12], ["trade"]), np.array([first, 0.0, 0.0]), np.diag([tick**2 / 12 + sigma_nu**2, velocity_std**2, sigma_nu**2]), "ud")


#: The variance of the logarithm of a squared normal, and less its mean.
LOG_CHI_VARIANCE, LOG_CHI_SHIFT = math.pi**2 / 2, 1.2704


@dataclass
class LogVarianceMotion(Motion):
    mu: float
    phi: float
    sigma: float
    interval: float
    n: int = 1

    def at(self, dt):
        f = self.phi ** (dt / self.interval)
        rest = self.sigma**2 / (1 - self.phi**2)
        return np.array([[f]]), np.array([[rest * (1 - f * f)]]), np.array([self.mu * (1 - f)])


def stochastic_volatility(mu: float, phi: float, sigma: float, interval: float = 60.0) -> Model:
    """Log variance by quasi maximum likelihood; readings by ``log_square``."""
    return Model(LogVarianceMotion(mu, phi, sigma, interval), Observation([{0: 1.0}], [LOG_CHI_VARIANCE], ["log_r2"]), np.array([mu]), np.array([[sigma**2 / (1 - phi**2)]]))


def log_square(r: float) -> float:
    return math.log(r * r + 1e-12) + LOG_CHI_SHIFT


def nelson_siegel(lam: float, maturities: list[float], theta, mu, sigma, variances: list[float]) -> Model:
    rows = [dict(enumerate(loadings(lam, t))) for t in maturities]
    p0 = np.diag([s**2 / (2 * t) if t > 0 else 1.0 for t, s in zip(theta, sigma, strict=True)])
    return Model(Blocks([OrnsteinUhlenbeck(t, m, s) for t, m, s in zip(theta, mu, sigma, strict=True)]), Observation(rows, list(variances), [f"y{t}" for t in maturities]), np.array(mu, float), p0)


def loadings(lam: float, maturity: float) -> tuple[float, float, float]:
    x = lam * maturity
    a = -math.expm1(-x) / x
    return 1.0, a, a - math.exp(-x)


@dataclass
class IntradayProfile:
    """A multiplier by time of day, linear between (second, value) points and periodic over a day."""

    points: list[tuple[float, float]]
    utc_offset: float = 0.0

    @classmethod
    def u_shape(cls, start: float, stop: float, edge: float = 2.0, middle: float = 0.7) -> IntradayProfile:
        return cls([(start, edge), ((start + stop) / 2, middle), (stop, edge)])

    def at(self, ts_ns: int) -> float:
        second = (ts_ns / 1e9 + self.utc_offset) % 86_400
        x, y = zip(*sorted(self.points), strict=True)
        return float(np.interp(second, x, y, period=86_400))

    def normalised(self) -> IntradayProfile:
        """The same shape with a mean of one over the day."""
        grid = np.arange(86_400)
        x, y = zip(*sorted(self.points), strict=True)
        mean = float(np.interp(grid, x, y, period=86_400).mean())
        return IntradayProfile([(a, b / mean) for a, b in self.points], self.utc_offset)


# ---- nonlinear models: f(x, dt), its Jacobian, Q(dt); h(x) per channel, its gradient


@dataclass
class Nonlinear:
    n: int
    move: Callable
    jacobian: Callable
    noise: Callable
    see: Callable  # (x, channel) -> value
    gradient: Callable  # (x, channel) -> row
    variances: list[float]
    x0: np.ndarray
    p0: np.ndarray
    angles: dict | None = None


def as_nonlinear(model: Model) -> Nonlinear:
    """A linear model in the interface of the nonlinear filters."""
    n = model.motion.n

    def move(x, dt):
        f, _, u = model.motion.at(dt)
        return f @ x if u is None else f @ x + u

    return Nonlinear(n, move, lambda x, dt: model.motion.at(dt)[0], lambda dt: model.motion.at(dt)[1], lambda x, c: float(model.observation.row(c, n) @ x), lambda x, c: model.observation.row(c, n), model.observation.variances, model.x0, model.p0)


def log_price_etf(weights, covariance, theta: float, sigma_premium: float, quote_variances, etf_variance: float, first_logs, price_std: float = 0.05, premium_std: float = 0.05) -> Nonlinear:
    """k log prices and a premium; quotes are logs, the fund is premium + sum of w e^x."""
    k, w, cov = len(weights), np.asarray(weights, float), np.asarray(covariance, float)

    def parts(dt):
        f, q = np.eye(k + 1), np.zeros((k + 1, k + 1))
        q[:k, :k] = cov * dt
        f[k, k], q[k, k] = ou(theta, sigma_premium, dt)
        return f, q

    def gradient(x, c):
        row = np.zeros(k + 1)
        if c < k:
            row[c] = 1.0
        else:
            row[:k], row[k] = w * np.exp(x[:k]), 1.0
        return row

    return Nonlinear(k + 1, lambda x, dt: parts(dt)[0] @ x, lambda x, dt: parts(dt)[0], lambda dt: parts(dt)[1], lambda x, c: float(x[c]) if c < k else float(x[k] + w @ np.exp(x[:k])), gradient, [*quote_variances, etf_variance], np.array([*first_logs, 0.0]), np.diag([price_std**2] * k + [premium_std**2]))


def volatility_with_leverage(mu: float, phi: float, sigma: float, rho: float, variance: float = 1e-6) -> Nonlinear:
    """[h, e]: log variance driven by the shock e of the return e^(h/2) e, one step a reading."""
    rest = sigma**2 / (1 - phi**2)

    def move(x, dt):
        return np.array([mu + phi * (x[0] - mu) + rho * sigma * x[1], 0.0])

    return Nonlinear(2, move, lambda x, dt: np.array([[phi, rho * sigma], [0.0, 0.0]]), lambda dt: np.diag([sigma**2 * (1 - rho**2), 1.0]), lambda x, c: float(math.exp(x[0] / 2) * x[1]), lambda x, c: np.array([math.exp(x[0] / 2) * x[1] / 2, math.exp(x[0] / 2)]), [variance], np.array([mu, 0.0]), np.diag([rest, 1.0]))


# ---- registry

MOTIONS: dict[str, Callable[..., Motion]] = {
    "random-walk": RandomWalk, "constant-velocity": ConstantVelocity, "white-acceleration": WhiteAcceleration, "constant-acceleration": ConstantAcceleration,
    "ornstein-uhlenbeck": OrnsteinUhlenbeck, "singer": Singer, "dense": Dense, "discrete": Discrete,
}
MODELS: dict[str, Callable[..., Model]] = {
    "local-linear-trend": local_linear_trend, "etf-basket": etf_basket, "pairs-hedge": pairs_hedge, "time-varying-beta": time_varying_beta, "multi-venue": multi_venue,
    "microprice": microprice, "bid-ask-bounce": bid_ask_bounce, "stochastic-volatility": stochastic_volatility, "nelson-siegel": nelson_siegel,
}


def motion_of(config: dict) -> Motion:
    config = dict(config)
    kind = config.pop("type")
    if kind == "blocks":
        return Blocks([motion_of(c) for c in config["parts"]])
    if kind == "scaled":
        return Scaled(motion_of(config["motion"]), np.asarray(config["scales"], float), config.get("factor", 1.0))
    if kind not in MOTIONS:
        raise ValueError(f"no motion {kind}")
    return MOTIONS[kind](**{k: np.asarray(v, float) if isinstance(v, list) else v for k, v in config.items()})


def build(config: dict) -> Model:
    """{"type": name of a model, parameters} or {"motion": {...}, "rows": [...], "variances": [...], "x0", "p0" or "p0_diag"}."""
    config = dict(config)
    if "type" in config:
        kind = config.pop("type")
        if kind not in MODELS:
            raise ValueError(f"no model {kind}")
        return MODELS[kind](**config)
    motion = motion_of(config["motion"])
    n = motion.n
    p0 = np.diag(np.asarray(config["p0_diag"], float)) if "p0_diag" in config else np.asarray(config.get("p0", np.eye(n)), float).reshape(n, n)
    rows = [{int(j): float(c) for j, c in r.items()} for r in config["rows"]]
    return Model(motion, Observation(rows, [float(v) for v in config["variances"]]), np.asarray(config.get("x0", np.zeros(n)), float), p0, config.get("form", "sequential"))


def register(name: str, make: Callable[..., Model]) -> None:
    MODELS[name] = make
