"""Filters for state-space models, and their runs over a table of ticks.

Channels are corrected one after another, each in two phases: the innovation's variance first, then, once a gate has decided, the
commit. The covariance is kept in one of four forms.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tideline.operators.linalg import chi2_quantile, cholesky_semidefinite, dare, is_positive_definite, symmetric
from tideline.operators.models import Model, Motion, Nonlinear, Observation, build
from tideline.operators.side_by_side import Filters, Readings, Runs, buffers, handed_out, lists
from tideline.plans.frames import KEYS, ORDER

LN_2PI = math.log(2 * math.pi)


# ---- gates


@dataclass
class Gate:
    """none; a limit on squared standardised innovations; or Huber's weight past c deviations."""

    kind: str = "none"
    limit: float = 0.0

    @classmethod
    def sigma(cls, k: float) -> Gate:
        return cls("limit", k * k)

    @classmethod
    def chi_square(cls, alpha: float) -> Gate:
        return cls("limit", chi2_quantile(1 - alpha, 1))

    @classmethod
    def huber(cls, c: float = 1.345) -> Gate:
        return cls("huber", c)

    def weigh(self, y: float, s: float, r: float) -> tuple[float, float, float]:
        """weight, effective variance of the reading, effective variance of the innovation; weight 0 rejects."""
        if self.kind == "limit" and y * y / s > self.limit:
            return 0.0, r, s
        if self.kind == "huber" and (u := math.sqrt(y * y / s)) > self.limit:
            wide = r * u / self.limit
            return self.limit / u, wide, s - r + wide
        return 1.0, r, s

    @classmethod
    def of(cls, config: dict | None) -> Gate:
        kind = (config or {}).get("kind", "none")
        return {"none": lambda: cls(), "sigma": lambda: cls.sigma(config["k"]), "chi_square": lambda: cls.chi_square(config["alpha"]), "huber": lambda: cls.huber(config.get("c", 1.345))}[kind]()


# ---- covariance forms


class Sequential:
    """P itself; a commit takes phi phi' / s away."""

    def __init__(self, p: np.ndarray):
        self.set(p)

    def set(self, p: np.ndarray) -> None:
        self.p = symmetric(np.array(p, float))

    def get(self) -> np.ndarray:
        return self.p

    def predict(self, f: np.ndarray, q: np.ndarray) -> None:
        self.p = symmetric(f @ self.p @ f.T + q)

    def prepare(self, h: np.ndarray, r: float) -> tuple[np.ndarray, float]:
        self.h, self.phi = h, self.p @ h
        return self.phi, float(h @ self.phi) + r

    def commit(self, r: float) -> None:
        s = float(self.h @ self.phi) + r
        self.p = self.p - np.outer(self.phi, self.phi) / s


class Joseph(Sequential):
    def commit(self, r: float) -> None:
        s = float(self.h @ self.phi) + r
        k = self.phi / s
        self.p = symmetric(self.p - np.outer(k, self.phi) - np.outer(self.phi, k) + s * np.outer(k, k))


class UD(Sequential):
    """P = U D U' with unit upper U: Thornton's prediction, Bierman's correction."""

    def set(self, p: np.ndarray) -> None:
        p = symmetric(np.array(p, float))
        n = len(p)
        u, d = np.eye(n), np.zeros(n)
        for j in range(n - 1, -1, -1):
            d[j] = max(0.0, p[j, j])
            if d[j] > 0:
                u[:j, j] = p[:j, j] / d[j]
                p[:j, :j] -= d[j] * np.outer(u[:j, j], u[:j, j])
        self.u, self.d = u, d

    def get(self) -> np.ndarray:
        return (self.u * self.d) @ self.u.T

    def predict(self, f: np.ndarray, q: np.ndarray) -> None:
        g = cholesky_semidefinite(q)
        w, weight = np.hstack([f @ self.u, g]), np.concatenate([self.d, np.ones(g.shape[1])])
        n = len(f)
        u, d = np.eye(n), np.zeros(n)
        for j in range(n - 1, -1, -1):
            own = w[j] * weight
            d[j] = own @ w[j]
            if d[j] > 0:
                u[:j, j] = w[:j] @ own / d[j]
                w[:j] -= np.outer(u[:j, j], w[j])
        self.u, self.d = u, d

    def prepare(self, h: np.ndarray, r: float) -> tuple[np.ndarray, float]:
        self.f = self.u.T @ h
        self.v = self.d * self.f
        return self.u @ self.v, float(self.f @ self.v) + r

    def commit(self, r: float) -> None:
        n, alpha, k = len(self.d), r, np.zeros(len(self.d))
        for j in range(n):
            old = alpha
            alpha = old + self.f[j] * self.v[j]
            if alpha <= 0:
                continue
            step = -self.f[j] / old if old > 0 else 0.0
            column = self.u[:j, j].copy()
            self.u[:j, j] = column + k[:j] * step
            k[:j] += column * self.v[j]
            k[j] = self.v[j]
            self.d[j] *= old / alpha


class SquareRoot(Sequential):
    """P = S S': an orthogonal triangle for the prediction, Potter's correction."""

    def set(self, p: np.ndarray) -> None:
        self.s = cholesky_semidefinite(symmetric(np.array(p, float)))

    def get(self) -> np.ndarray:
        return self.s @ self.s.T

    def predict(self, f: np.ndarray, q: np.ndarray) -> None:
        self.s = np.linalg.qr(np.hstack([f @ self.s, cholesky_semidefinite(q)]).T, mode="r").T

    def prepare(self, h: np.ndarray, r: float) -> tuple[np.ndarray, float]:
        self.f = self.s.T @ h
        self.phi = self.s @ self.f
        return self.phi, float(self.f @ self.f) + r

    def commit(self, r: float) -> None:
        s = float(self.f @ self.f) + r
        self.s = self.s - np.outer(self.phi, self.f) / (s + math.sqrt(r * s))


FORMS: dict[str, type[Sequential]] = {"sequential": Sequential, "joseph": Joseph, "ud": UD, "square-root": SquareRoot}


# ---- linear filters


class KalmanFilter:
    """predict and correct; the first reading corrects x0 without a prediction, steps back in time are refused."""

    def __init__(self, model: Model, form: str | None = None, gate: Gate | None = None, quantum: float = 1e-6, cache: int = 64):
        self.motion, self.observation = model.motion, model.observation
        self.gate, self.quantum, self.cache = gate or Gate(), quantum, cache
        self.covariance = FORMS[form or model.form](model.p0)
        self.known: OrderedDict = OrderedDict()
        self.x = np.array(model.x0, float)
        self.ts: int | None = None
        self.ll, self.steps, self.last_dt = 0.0, 0, 0.0
        self.prior: tuple | None = None

    @property
    def p(self) -> np.ndarray:
        return self.covariance.get()

    def matrices(self, dt: float) -> tuple:
        key = round(dt / self.quantum)
        if key not in self.known:
            if len(self.known) >= self.cache:
                self.known.popitem(last=False)
            self.known[key] = self.motion.at(dt)
        return self.known[key]

    def predict(self, dt: float) -> None:
        if dt < 0:
            raise ValueError("a reading is older than the last one")
        if dt > 0:
            f, q, u = self.matrices(dt)
            self.x = f @ self.x if u is None else f @ self.x + u
            self.covariance.predict(f, q)

    def correct(self, values: dict[int, float], rows: dict | None = None, variances: dict | None = None) -> list[tuple[int, float, float, float]]:
        """(channel, innovation, its variance, weight) of each reading."""
        out = []
        for channel, z in values.items():
            h = self.observation.row(channel, len(self.x), (rows or {}).get(channel))
            r = (variances or {}).get(channel, self.observation.variances[channel])
            y = z - float(h @ self.x)
            phi, s = self.covariance.prepare(h, r)
            if not s > 0:
                raise ArithmeticError(f"channel {channel}: innovation variance {s}")
            weight, r_eff, s_eff = self.gate.weigh(y, s, r)
            out.append((channel, y, s, weight))
            if weight:
                self.x = self.x + phi * (y / s_eff)
                self.covariance.commit(r_eff)
                self.ll -= 0.5 * (y * y / s_eff + math.log(s_eff) + LN_2PI)
        return out

    def step(self, ts_ns: int, values: dict[int, float], rows: dict | None = None, variances: dict | None = None) -> list[tuple[int, float, float, float]]:
        dt = 0.0 if self.ts is None else (ts_ns - self.ts) / 1e9
        self.predict(dt)
        self.prior = (dt, self.x.copy(), self.p.copy())
        self.ts, self.last_dt = ts_ns, dt
        out = self.correct(values, rows, variances)
        self.steps += 1
        return out

    def reset(self, x, p, ts_ns: int | None = None) -> None:
        self.x, self.ts, self.ll, self.steps, self.last_dt = np.array(x, float), ts_ns, 0.0, 0, 0.0
        self.covariance.set(np.asarray(p, float))

    def scale(self, factors: np.ndarray) -> None:
        """A split: states and deviations times factors."""
        self.x = self.x * factors
        self.covariance.set(self.p * np.outer(factors, factors))

    def shift(self, amounts: np.ndarray) -> None:
        """A dividend: states move, their uncertainty stays."""
        self.x = self.x + amounts

    def add_variance(self, variances: np.ndarray) -> None:
        self.covariance.set(self.p + np.diag(variances))

    def snapshot(self) -> dict:
        return {"n": len(self.x), "x": self.x.tolist(), "p": self.p.ravel().tolist(), "ts_ns": self.ts, "ll": self.ll, "steps": self.steps}

    @classmethod
    def restore(cls, model: Model, snapshot: dict, **options) -> KalmanFilter:
        made = cls(model, **options)
        n = snapshot["n"]
        made.reset(snapshot["x"], np.reshape(snapshot["p"], (n, n)), snapshot["ts_ns"])
        made.ll, made.steps = snapshot["ll"], snapshot["steps"]
        return made


def retrodict(filter_: KalmanFilter, ts_ns: int, values: dict[int, float]) -> list[tuple[int, float, float, float]] | None:
    """Take in a reading that is late by at most the last step: back to its time, and what it tells carried forward.

    None if it is older or blind. Likelihood and steps start anew, gates do not apply."""
    if filter_.ts is None or not values:
        return None
    late, step = filter_.ts - ts_ns, round(filter_.last_dt * 1e9)
    if late <= 0 or step <= 0 or late > step:
        return None
    f, q, u = filter_.motion.at(late / 1e9)
    back, x, p = np.linalg.inv(f), filter_.x.copy(), filter_.p
    less = p - q if is_positive_definite(p - q) else p
    then, p_then, cross = back @ (x if u is None else x - u), back @ less @ back.T, less @ back.T
    out = []
    for channel, z in values.items():
        h, r = filter_.observation.row(channel, len(x)), filter_.observation.variances[channel]
        y, seen = z - float(h @ then), p_then @ h
        s = float(h @ seen) + r
        gain = cross @ h / s
        x, p = x + gain * y, symmetric(p - s * np.outer(gain, gain))
        then, cross = then + seen * (y / s), cross - np.outer(gain, seen)
        p_then = symmetric(p_then - np.outer(seen, seen) / s)
        out.append((channel, y, s, 1.0))
    filter_.reset(x, p, filter_.ts)
    return out


class InformationFilter:
    """Y = P^-1 and y = Y x; may start from nothing, has a mean once Y can be inverted."""

    def __init__(self, motion: Motion, observation: Observation, x0=None, p0=None):
        self.motion, self.observation, n = motion, observation, motion.n
        self.info = np.zeros((n, n)) if p0 is None else np.linalg.inv(p0)
        self.vector = np.zeros(n) if x0 is None else self.info @ x0
        self.ts: int | None = None

    @property
    def known(self) -> bool:
        return is_positive_definite(self.info)

    def mean(self) -> np.ndarray | None:
        return np.linalg.solve(self.info, self.vector) if self.known else None

    def covariance(self) -> np.ndarray | None:
        return symmetric(np.linalg.inv(self.info)) if self.known else None

    def add(self, info: np.ndarray, vector: np.ndarray) -> None:
        self.info, self.vector = self.info + info, self.vector + vector

    def step(self, ts_ns: int, values: dict[int, float]) -> None:
        dt = 0.0 if self.ts is None else (ts_ns - self.ts) / 1e9
        if dt > 0:
            f, q, u = self.motion.at(dt)
            back = np.linalg.inv(f)
            m = back.T @ self.info @ back
            gain = m @ np.linalg.inv(np.eye(len(m)) + q @ m)
            moved = back.T @ self.vector
            self.vector = moved - gain @ q @ moved
            self.info = symmetric(gain)
            if u is not None:
                self.vector = self.vector + self.info @ u
        self.ts = ts_ns
        for channel, z in values.items():
            h, r = self.observation.row(channel, self.motion.n), self.observation.variances[channel]
            self.add(np.outer(h, h) / r, h * (z / r))


class SteadyStateFilter:
    """The gain at rest for a fixed dt; every channel is needed at every step."""

    def __init__(self, model: Model, dt: float):
        f, q, u = model.motion.at(dt)
        self.f, self.u = f, u
        self.h = model.observation.matrix(model.motion.n)
        self.p, self.k = dare(f, q, self.h, np.diag(model.observation.variances))
        self.x = np.array(model.x0, float)

    def step(self, values: list[float]) -> np.ndarray:
        x = self.f @ self.x if self.u is None else self.f @ self.x + self.u
        self.x = x + self.k @ (np.asarray(values, float) - self.h @ x)
        return self.x


@dataclass
class AlphaBetaFilter:
    alpha: float
    beta: float
    dt: float
    position: float = 0.0
    velocity: float = 0.0

    @classmethod
    def tracking(cls, sigma_a: float, sigma_r: float, dt: float, **start) -> AlphaBetaFilter:
        """Gains of the tracking index in closed form."""
        index = sigma_a * dt * dt / sigma_r
        r = (4 + index - math.sqrt(8 * index + index * index)) / 4
        alpha = 1 - r * r
        return cls(alpha, 2 * (2 - alpha) - 4 * math.sqrt(1 - alpha), dt, **start)

    @classmethod
    def constant_velocity(cls, sigma_a: float, sigma_r: float, dt: float, **start) -> AlphaBetaFilter:
        """Gains at rest of the constant-velocity model in continuous time."""
        from tideline.operators.models import ConstantVelocity

        f, q, _ = ConstantVelocity(sigma_a).at(dt)
        _, k = dare(f, q, np.array([[1.0, 0.0]]), np.array([[sigma_r**2]]))
        return cls(float(k[0, 0]), float(k[1, 0]) * dt, dt, **start)

    def step(self, z: float) -> tuple[float, float]:
        ahead = self.position + self.dt * self.velocity
        y = z - ahead
        self.position, self.velocity = ahead + self.alpha * y, self.velocity + self.beta / self.dt * y
        return self.position, self.velocity


# ---- nonlinear filters


class ExtendedKalmanFilter:
    """The model's Jacobian moves P; each channel is linearised where the one before left the state."""

    def __init__(self, model: Nonlinear, gate: Gate | None = None):
        self.model, self.gate = model, gate or Gate()
        self.x, self.p, self.ts, self.ll, self.steps = np.array(model.x0, float), symmetric(np.array(model.p0, float)), None, 0.0, 0

    def predict(self, dt: float) -> None:
        f = self.model.jacobian(self.x, dt)
        self.x = self.model.move(self.x, dt)
        self.p = symmetric(f @ self.p @ f.T + self.model.noise(dt))

    def seen(self, channel: int) -> tuple[float, np.ndarray, float]:
        """The expected reading, its covariance with the state, and its variance without noise."""
        h = self.model.gradient(self.x, channel)
        phi = self.p @ h
        return self.model.see(self.x, channel), phi, float(h @ phi)

    def step(self, ts_ns: int, values: dict[int, float], always: bool = False) -> list[tuple[int, float, float, float]]:
        dt = 0.0 if self.ts is None else (ts_ns - self.ts) / 1e9
        if dt < 0:
            raise ValueError("a reading is older than the last one")
        if dt > 0 or (always and self.steps):
            self.predict(dt)
        self.ts, out = ts_ns, []
        for channel, z in values.items():
            r = self.model.variances[channel]
            expected, phi, hph = self.seen(channel)
            y, s = z - expected, hph + r
            weight, _, s_eff = self.gate.weigh(y, s, r)
            out.append((channel, y, s, weight))
            if weight:
                self.x = self.x + phi * (y / s_eff)
                self.p = symmetric(self.p - np.outer(phi, phi) / s_eff)
                self.ll -= 0.5 * (y * y / s_eff + math.log(s_eff) + LN_2PI)
        self.steps += 1
        return out


class UnscentedKalmanFilter(ExtendedKalmanFilter):
    """Sigma points in place of Jacobians, drawn anew for every channel."""

    def __init__(self, model: Nonlinear, gate: Gate | None = None, alpha: float = 1e-3, beta: float = 2.0, kappa: float = 0.0):
        super().__init__(model, gate)
        n = model.n
        self.spread = alpha * alpha * (n + kappa)
        rest = self.spread - n
        self.wm = np.full(2 * n + 1, 0.5 / self.spread)
        self.wc = self.wm.copy()
        self.wm[0] = rest / self.spread
        self.wc[0] = self.wm[0] + 1 - alpha * alpha + beta

    def points(self) -> np.ndarray:
        root = cholesky_semidefinite(self.spread * self.p)
        return np.vstack([self.x, self.x + root.T, self.x - root.T])

    def predict(self, dt: float) -> None:
        moved = np.array([self.model.move(s, dt) for s in self.points()])
        # Means are taken around the central point, whose weight is large and negative.
        self.x = moved[0] + self.wm[1:] @ (moved[1:] - moved[0])
        off = moved - self.x
        self.p = symmetric((off.T * self.wc) @ off + self.model.noise(dt))

    def seen(self, channel: int) -> tuple[float, np.ndarray, float]:
        points = self.points()
        z = np.array([self.model.see(s, channel) for s in points])
        mean = z[0] + float(self.wm[1:] @ (z[1:] - z[0]))
        off = z - mean
        return mean, ((points - self.x).T * self.wc) @ off, float(self.wc @ (off * off))


class InteractingModels:
    """Filters of one state under several regimes, mixed by their chances before each step from the second on."""

    def __init__(self, filters: list[KalmanFilter], transition, chances=None, floor: float = 1e-9):
        if len(filters) < 2 or len({len(f.x) for f in filters}) != 1:
            raise ValueError("two filters or more of one state size are needed")
        self.filters, self.pi, self.floor, self.steps = filters, np.asarray(transition, float), floor, 0
        self.mu = np.full(len(filters), 1 / len(filters)) if chances is None else np.asarray(chances, float)
        self.ts: int | None = None

    def step(self, ts_ns: int, values: dict[int, float]) -> None:
        ahead = self.pi.T @ self.mu
        if self.steps:
            means, covariances = [f.x for f in self.filters], [f.p for f in self.filters]
            for j, f in enumerate(self.filters):
                w = self.pi[:, j] * self.mu / ahead[j] if ahead[j] > 0 else np.zeros(len(self.mu))
                x = sum(a * m for a, m in zip(w, means, strict=True))
                p = sum(a * (c + np.outer(m - x, m - x)) for a, m, c in zip(w, means, covariances, strict=True))
                f.reset(x, p, self.ts)
        told = np.zeros(len(self.filters))
        for j, f in enumerate(self.filters):
            before = f.ll
            if f.step(ts_ns, values):
                told[j] = f.ll - before
        mu = np.exp(told - told.max()) * ahead
        mu = np.maximum(self.floor, mu / mu.sum())
        self.mu, self.ts, self.steps = mu / mu.sum(), ts_ns, self.steps + 1

    @property
    def x(self) -> np.ndarray:
        return sum(m * f.x for m, f in zip(self.mu, self.filters, strict=True))

    @property
    def p(self) -> np.ndarray:
        x = self.x
        return symmetric(sum(m * (f.p + np.outer(f.x - x, f.x - x)) for m, f in zip(self.mu, self.filters, strict=True)))

    @property
    def regime(self) -> int:
        return int(self.mu.argmax())


# ---- over tables

OUTCOMES = T.ArrayType(T.StructType([T.StructField("channel", T.IntegerType()), T.StructField("y", T.DoubleType()), T.StructField("s", T.DoubleType()), T.StructField("w", T.DoubleType())]))
STEP_FIELDS = [
    T.StructField("dt", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("ll", T.DoubleType()), T.StructField("outcomes", OUTCOMES),
    T.StructField("x_prior", T.ArrayType(T.DoubleType())), T.StructField("p_prior", T.ArrayType(T.DoubleType())),
]


def make_filter(model: dict | Callable[[], Model], options: dict | None = None) -> KalmanFilter:
    options = dict(options or {})
    built = model() if callable(model) else build(model)
    return KalmanFilter(built, options.get("form"), Gate.of(options.get("gate")), options.get("quantum", 1e-6), options.get("cache", 64))


def run_filter(ticks: DataFrame, model: dict | Callable, options: dict | None = None, keys=KEYS, order=ORDER, start: Callable | None = None) -> DataFrame:
    """Every step of a filter for each key: keys, order columns, dt, x, p, ll (so far), outcomes, x_prior, p_prior.

    ticks: keys, ts_ns, values (map of channel to reading; empty or NULL: predict only) and, if there are any, rows and variances
    by channel. ``start(filter, values)`` may set a new filter up from the first tick. One pass over sorted rows: memory stays that of
    a buffer and its filters. The ``sequential`` form takes the series of a buffer side by side."""
    own = [c for c in ("rows", "variances") if c in ticks.columns]
    names = list(dict.fromkeys([*keys, *order]))
    schema = T.StructType([ticks.schema[c] for c in names] + STEP_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kalman = None, None
        types = [pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.struct([("channel", pa.int32()), ("y", pa.float64()), ("s", pa.float64()), ("w", pa.float64())])), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_pylist()
            key, ts, values = list(zip(*map(column, keys), strict=True)), column("ts_ns"), column("values")
            extra = {c: column(c) for c in own}
            out: list[tuple] = []
            for i, k in enumerate(key):
                now = {int(a): float(b) for a, b in (values[i] or []) if b is not None and not math.isnan(b)}
                if k != held:
                    held, kalman = k, make_filter(model, options)
                    if start is not None:
                        start(kalman, now)
                rows = {int(a): dict(enumerate(b)) for a, b in (extra["rows"][i] or [])} if "rows" in extra else None
                variances = dict(extra["variances"][i] or []) if "variances" in extra else None
                told = kalman.step(ts[i], now, rows, variances)
                dt, x, p = kalman.prior
                out.append((dt, kalman.x.tolist(), kalman.p.ravel().tolist(), kalman.ll, [{"channel": c, "y": y, "s": s, "w": w} for c, y, s, w in told], x.tolist(), p.ravel().tolist()))
            made = list(zip(*out, strict=True)) or [() for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(list(m), t) for m, t in zip(made, types, strict=True)], names=[f.name for f in schema])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, clock, state, ll = None, 0, [], 0.0
        for columns in buffers(batches):
            runs, ts, seen = Runs(columns, keys, held), columns["ts_ns"].to_numpy(), Readings(columns["values"])
            many, first = Filters(built, len(runs), gate), ts[runs.starts].copy()
            for k, row in enumerate(runs.starts if start is not None else ()):
                kalman = make_filter(model, options)
                start(kalman, seen.of(row))
                many.x[:, k], many.p[:, :, k] = kalman.x, kalman.p
            if runs.goes_on is not None:
                first[runs.goes_on], many.ll[runs.goes_on] = clock, ll
                for a, v in zip(many.arrays(), state, strict=True):
                    a[..., runs.goes_on] = v
            dt, n, told = (ts - runs.before(ts, first)) / 1e9, many.n, np.zeros((3, len(seen.z)))
            x, p, prior_x, prior_p, lls = np.empty((runs.rows, n)), np.empty((runs.rows, n * n)), np.empty((runs.rows, n)), np.empty((runs.rows, n * n)), np.empty(runs.rows)
            for k, rows in runs.steps():
                many.predict(dt[rows])
                prior_x[rows], prior_p[rows] = many.x[:, :k].T, many.p[:, :, :k].reshape(n * n, k).T
                for to, which in seen.at(rows):
                    told[:, which] = many.correct(to, seen.channel[which], seen.z[which])
                x[rows], p[rows], lls[rows] = many.x[:, :k].T, many.p[:, :, :k].reshape(n * n, k).T, many.ll[:k]
            held, clock, state, ll = runs.held, ts[-1], [a[..., runs.last].copy() for a in many.arrays()], many.ll[runs.last]
            outcomes = pa.StructArray.from_arrays([pa.array(seen.channel, pa.int32()), *map(pa.array, told)], names=["channel", "y", "s", "w"])
            made = [pa.array(dt), lists(x), lists(p), pa.array(lls), pa.ListArray.from_arrays(pa.array(seen.offsets, pa.int32()), outcomes), lists(prior_x), lists(prior_p)]
            yield from handed_out({c: columns[c] for c in names} | {f.name: a for f, a in zip(STEP_FIELDS, made, strict=True)})

    built, gate = model() if callable(model) else build(model), Gate.of((options or {}).get("gate"))
    if not own and ((options or {}).get("form") or built.form) == "sequential":
        run = together
    return ticks.select(*dict.fromkeys([*names, "ts_ns", "values", *own])).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
