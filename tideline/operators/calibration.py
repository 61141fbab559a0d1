"""Calibration: parameters by maximum likelihood over candidates that run side by side, by expectation-maximisation, and a backtest."""

from __future__ import annotations

import copy
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.filters import LN_2PI, make_filter
from tideline.operators.linalg import nees, symmetric
from tideline.operators.models import build
from tideline.operators.side_by_side import BUFFER, Filters, Readings, Runs, buffers, doubles, even, handed_out, lists, moved, steps, times
from tideline.operators.smoothing import rauch_tung_striebel
from tideline.plans.frames import KEYS, ORDER


class Parameters:
    """Paths into a config and how each is free: log (positive), linear, or cholesky:n (a covariance of n)."""

    def __init__(self, paths: dict[str, str]):
        self.paths = paths

    @staticmethod
    def _place(config, path: str) -> tuple:
        *way, last = path.split(".")
        for part in way:
            config = config[int(part) if isinstance(config, list) else part]
        return config, int(last) if isinstance(config, list) else last

    def theta(self, config: dict) -> np.ndarray:
        out: list[float] = []
        for path, kind in self.paths.items():
            held, last = self._place(config, path)
            if kind.startswith("cholesky"):
                low = np.linalg.cholesky(np.asarray(held[last], float))
                out += [math.log(low[i, j]) if i == j else low[i, j] for i in range(len(low)) for j in range(i + 1)]
            else:
                out.append(math.log(held[last]) if kind == "log" else float(held[last]))
        return np.array(out)

    def apply(self, config: dict, theta) -> dict:
        config, at = copy.deepcopy(config), 0
        for path, kind in self.paths.items():
            held, last = self._place(config, path)
            if kind.startswith("cholesky"):
                n = int(kind.split(":")[1])
                low = np.zeros((n, n))
                for i in range(n):
                    for j in range(i + 1):
                        low[i, j] = math.exp(theta[at]) if i == j else theta[at]
                        at += 1
                held[last] = (low @ low.T).tolist()
            else:
                held[last] = math.exp(theta[at]) if kind == "log" else float(theta[at])
                at += 1
        return config


class Poll:
    """A direct search from one start (generalised pattern search with a quadratic model).

    Each round asks for both neighbours on every axis and for the bottom of the parabolas that the last round's values gave; the best
    of all becomes the centre. The mesh is refined where the centre stays, and widened where a neighbour beat it."""

    def __init__(self, start: np.ndarray, step: float, tolerance: float):
        self.centre, self.value = np.array(start, float), math.inf
        self.mesh, self.tolerance, self.guess, self.done = step, tolerance, np.array(start, float), False

    def asks(self) -> list[np.ndarray]:
        sides = self.mesh * np.eye(len(self.centre))
        return [*(self.centre + sides), *(self.centre - sides)] + ([] if self.guess is None else [self.guess])

    def takes(self, points: list[np.ndarray], values: list[float]) -> None:
        n, was = len(self.centre), self.value
        if not math.isfinite(was) and np.array_equal(points[-1], self.centre):  # the first round also asks for the centre itself
            self.value = was = values[-1]
        up, down = np.array(values[:n]), np.array(values[n : 2 * n])
        bottom = None
        if math.isfinite(was) and np.isfinite(up).all() and np.isfinite(down).all():
            bend = up + down - 2 * was
            slope = np.where(bend > 0, (down - up) / (2 * np.where(bend > 0, bend, 1)), np.sign(down - up))
            bottom = self.centre + self.mesh * np.clip(slope, -2, 2)
        best = int(np.argmin(values))
        if values[best] < self.value:
            near = best >= 2 * n and np.abs(points[best] - self.centre).max() < self.mesh
            self.centre, self.value = points[best], values[best]
            if near:
                self.mesh /= 2
        else:
            self.mesh /= 4
        settled = abs(was - self.value) <= self.tolerance * (1 + abs(self.value))
        self.done = self.mesh <= math.sqrt(self.tolerance) / 2 and settled
        self.guess = None if bottom is None or np.array_equal(bottom, self.centre) else bottom


def minimise(evaluate: Callable[[list[np.ndarray]], list[float]], starts: list[np.ndarray], step: float = 0.5, tolerance: float = 1e-6, most: int = 500) -> tuple[np.ndarray, float]:
    """The least value found from any start, and where: each round evaluates what all searches ask for at once, for ``most`` rounds at most."""
    searches = [Poll(s, step, tolerance) for s in starts]
    for _ in range(most):
        live = [s for s in searches if not s.done]
        if not live:
            break
        asked = [s.asks() for s in live]
        values = iter(evaluate([p for points in asked for p in points]))
        for search, points in zip(live, asked, strict=True):
            search.takes(points, [next(values) for _ in points])
    best = min(searches, key=lambda s: s.value)
    return best.centre, best.value


def spread_starts(theta: np.ndarray, n: int, width: float = 1.0, seed: int = 0) -> list[np.ndarray]:
    """The start and n - 1 others around it: a Latin hypercube, one in each layer of every axis."""
    random = np.random.default_rng(seed)
    layers = np.stack([random.permutation(n - 1) for _ in theta], 1) if n > 1 else np.zeros((0, len(theta)))
    moves = 2 * (layers + random.random(layers.shape)) / max(1, n - 1) - 1
    return [np.array(theta, float), *(np.asarray(theta, float) + width * moves)]


def log_likelihoods(ticks: DataFrame, config: dict, parameters: Parameters, thetas: list[np.ndarray], keys=KEYS, order=ORDER, first_value: bool = True) -> list[float]:
    """The likelihood of every candidate over all series: one job; each row is read once for all candidates, and the series of a buffer go side by side.

    No gates. A candidate that breaks a filter counts as minus infinity. Only one number per candidate reaches the driver."""
    configs = [parameters.apply(config, t) for t in thetas]

    def run(batches):
        sums, dead, held, clock, state = [0.0] * len(configs), [False] * len(configs), None, 0, {}
        for columns in buffers(batches):
            runs, ts, seen = Runs(columns, keys, held), columns["ts_ns"].to_numpy(), Readings(columns["values"])
            first = ts[runs.starts].copy()
            if runs.goes_on is not None:
                first[runs.goes_on] = clock
            dt = (ts - runs.before(ts, first)) / 1e9
            starts = [seen.of(row).get(0) for row in runs.starts] if first_value else []
            for c, own in enumerate(configs):
                if dead[c]:
                    continue
                try:
                    many = Filters(build(own), len(runs))
                    for k, z in enumerate(starts):
                        many.x[0, k] = many.x[0, k] if z is None else z
                    if runs.goes_on is not None:
                        for a, v in zip(many.arrays(), state[c], strict=True):
                            a[..., runs.goes_on] = v
                    for _, rows in runs.steps():
                        many.predict(dt[rows])
                        for to, which in seen.at(rows):
                            many.correct(to, seen.channel[which], seen.z[which])
                    sums[c] += float(many.ll.sum())
                    state[c] = [a[..., runs.last].copy() for a in many.arrays()]
                except (ValueError, ArithmeticError, np.linalg.LinAlgError):
                    dead[c] = True
            held, clock = runs.held, ts[-1]
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(configs)), pa.int64()), "ll": pa.array([-math.inf if d else s for s, d in zip(sums, dead, strict=True)], pa.float64())})

    parts = ticks.select(*dict.fromkeys([*keys, *order, "ts_ns", "values"])).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, "k long, ll double")
    found = {r["k"]: r["ll"] for r in parts.groupBy("k").agg(F.sum("ll").alias("ll")).collect()}
    return [found.get(k, 0.0) for k in range(len(configs))]


def calibrate(ticks: DataFrame, config: dict, parameters: Parameters, starts: int = 1, keys=KEYS, order=ORDER, **options) -> tuple[dict, float]:
    """The config of greatest likelihood found, and that likelihood."""
    held = ticks.persist()
    try:
        evaluate = lambda points: [-v for v in log_likelihoods(held, config, parameters, points, keys, order)]
        theta, value = minimise(evaluate, spread_starts(parameters.theta(config), starts), **options)
    finally:
        held.unpersist()
    return parameters.apply(config, theta), -value


def expectation_maximisation(config: dict, ts_ns: list[int], values: list[dict[int, float]], rounds: int = 30, floor: float = 1e-12) -> tuple[np.ndarray, list[float], float]:
    """Q of one step and the reading variances of a series at even steps: the smoothed moments of each round give the next."""
    if len(ts_ns) < 3:
        raise ValueError("three ticks at least are needed")
    dt = (ts_ns[1] - ts_ns[0]) / 1e9
    start = make_filter(config)
    f, q, _ = start.motion.at(dt)
    r, n, ll = list(start.observation.variances), len(start.x), -math.inf
    for _ in range(rounds):
        kalman = make_filter(config)
        kalman.observation.variances[:] = r
        kalman.motion = type("Fixed", (), {"n": n, "at": staticmethod(lambda _, f=f, q=q: (f, q, None))})()
        steps = []
        for k, v in enumerate(values):
            kalman.step(round(k * dt * 1e9), v)
            d, x, p = kalman.prior
            steps.append({"dt": d, "x": kalman.x.copy(), "p": kalman.p.copy(), "x_prior": x, "p_prior": p})
        ll = kalman.ll
        found = rauch_tung_striebel(steps, lambda _: f)
        total = np.zeros((n, n))
        for (x0, p0, lag), (x1, p1, _) in zip(found[:-1], found[1:], strict=True):
            d = x1 - f @ x0
            total += np.outer(d, d) + p1 + f @ p0 @ f.T - f @ lag.T - lag @ f.T
        q = symmetric(total / (len(found) - 1))
        q += max(0.0, floor - float(np.linalg.eigvalsh(q)[0])) * np.eye(n)
        for c in range(len(r)):
            h = kalman.observation.row(c, n)
            errors = [(v[c] - h @ x) ** 2 + h @ p @ h for v, (x, p, _) in zip(values, found, strict=True) if c in v]
            if errors:
                r[c] = max(floor, float(np.mean(errors)))
    return q, r, ll


def em_by_key(ticks: DataFrame, config: dict, rounds: int = 30, keys=KEYS, order=ORDER) -> DataFrame:
    """EM of every series: keys, q (flat), r, ll. A series is held by one task, as its smoother needs it whole; the series of a buffer
    go side by side. A row without a price is a step without a reading."""
    names = list(dict.fromkeys([*keys, *order, "ts_ns", "price"]))
    schema = T.StructType([*[ticks.schema[k] for k in keys], T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("r", T.ArrayType(T.DoubleType())), T.StructField("ll", T.DoubleType())])

    def run(batches):
        for columns in whole_series(batches, keys):
            runs = Runs(columns, keys)
            q, r, ll = em_side_by_side(config, runs, columns["ts_ns"].to_numpy(), doubles(columns["price"]), rounds)
            short = pa.array(runs.lengths < 3)
            told = [lists(q.reshape(-1, len(runs)).T), lists(r.T), pa.array(ll)]
            yield from handed_out({k: columns[k].take(pa.array(runs.starts)) for k in keys} | {c: pc.if_else(short, pa.scalar(None, a.type), a) for c, a in zip(("q", "r", "ll"), told, strict=True)})

    return ticks.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def whole_series(batches, keys, rows: int = BUFFER):
    """Buffers that end where a series ends: a longer one is held whole."""
    held: dict | None = None
    for columns in buffers(batches, rows):
        if held is not None:
            columns = {c: pa.concat_arrays([held[c], a]) for c, a in columns.items()}
        cut = int(Runs(columns, keys).first[-1])
        if cut:
            yield {c: a.slice(0, cut) for c, a in columns.items()}
        held = {c: a.slice(cut) for c, a in columns.items()}
    if held is not None:
        yield held


def em_side_by_side(config: dict, runs: Runs, ts_ns: np.ndarray, z: np.ndarray, rounds: int, floor: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``expectation_maximisation`` of every run by its prices z (NaN: none): q (n, n, runs), r (channels, runs), ll (runs)."""
    model = build(config)
    n, k, h = model.motion.n, len(runs), model.observation.row(0, model.motion.n)[:, None]
    has = ~np.isnan(z)
    second = np.minimum(runs.starts + 1, runs.starts + runs.lengths - 1)
    dt = (ts_ns[second] - ts_ns[runs.starts]) / 1e9
    f, q, _ = model.motion.many(dt)
    r = np.repeat(np.asarray(model.observation.variances, float)[:, None], k, 1)
    x0, p0, ll = np.repeat(np.asarray(model.x0, float)[:, None], k, 1), np.repeat(np.asarray(model.p0, float)[:, :, None], k, 2), np.zeros(k)
    x0[0] = np.where(has[runs.starts], z[runs.starts], x0[0])
    run_of = np.empty(runs.rows, np.int64)
    run_of[runs.first] = np.argsort(runs.starts)
    run_of = run_of[np.repeat(runs.first, np.diff(np.append(runs.first, runs.rows)))]
    x, p, xp, pp, xs, ps = (np.empty((n, *deep, runs.rows)) for deep in ((), (n,), (), (n,), (), (n,)))
    more = np.ones(runs.rows, bool)
    more[runs.starts + runs.lengths - 1] = False
    here = np.flatnonzero(more)
    own = run_of[here]
    f_own, still = f[..., own], dt[own] <= 0
    for _ in range(rounds):
        ll = np.zeros(k)
        now, cov = x0.copy(), p0.copy()
        for step, (m, rows) in enumerate(runs.steps()):
            if step and (to := np.flatnonzero(dt[:m] > 0)).size:
                now[:, to], cov[:, :, to] = times(f[..., to], now[:, to]), even(moved(f[..., to], cov[:, :, to]) + q[..., to])
            xp[:, rows], pp[:, :, rows] = now[:, :m], cov[:, :, :m]
            to = slice(0, m) if has[rows].all() else np.flatnonzero(has[rows])
            seen = rows[to]
            phi = (cov[:, :, to] * h).sum(1)
            s, y = (h * phi).sum(0) + r[0, to], z[seen] - (h * now[:, to]).sum(0)
            now[:, to] += phi * (y / s)
            cov[:, :, to] -= phi[:, None] * phi[None] / s
            ll[to] -= 0.5 * (y * y / s + np.log(s) + LN_2PI)
            x[:, rows], p[:, :, rows] = now[:, :m], cov[:, :, :m]
        # The gain of each row, towards the row after it.
        ahead = times(f_own, p[:, :, here])
        before = np.where(still, np.eye(n)[:, :, None], pp[:, :, here + 1])
        gain = np.empty((n, n, runs.rows))
        gain[:, :, here] = (ahead / before).transpose(1, 0, 2) if n == 1 else np.linalg.solve(before.transpose(2, 0, 1), ahead.transpose(2, 0, 1)).transpose(2, 1, 0)
        ends = runs.starts + runs.lengths - 1
        xs[:, ends], ps[:, :, ends] = x[:, ends], p[:, :, ends]
        for step, (m, rows) in enumerate(steps(ends, runs.lengths, -1)):
            if not step:
                continue
            g, after = gain[:, :, rows], rows + 1
            back = x[:, rows] + (g * (xs[:, after] - xp[:, after])).sum(1)
            spread = even(p[:, :, rows] + moved(g, ps[:, :, after] - pp[:, :, after]))
            stays = dt[:m] <= 0
            xs[:, rows], ps[:, :, rows] = np.where(stays, xs[:, after], back), np.where(stays, ps[:, :, after], spread)
        late, mean, cov0, cov1 = xs[:, here + 1], xs[:, here], ps[:, :, here], ps[:, :, here + 1]
        d = late - times(f_own, mean)
        lag = np.where(still, cov1, np.einsum("ijk,ljk->ilk", cov1, gain[:, :, here]))
        cross = times(f_own, lag.transpose(1, 0, 2))
        term = d[:, None] * d[None] + cov1 + moved(f_own, cov0) - cross - cross.transpose(1, 0, 2)
        sums = lambda a, at: np.bincount(at, a, minlength=k)
        total = np.array([[sums(term[i, j], own) for j in range(n)] for i in range(n)])
        q = even(total / np.maximum(runs.lengths - 1, 1))
        least = q[0, 0] if n == 1 else np.linalg.eigvalsh(q.transpose(2, 0, 1))[:, 0]
        q += np.maximum(0.0, floor - least) * np.eye(n)[:, :, None]
        errors = (z - (h * xs).sum(0)) ** 2 + (h * (ps * h).sum(1)).sum(0)
        count = sums(has.astype(float), run_of)
        r[0] = np.where(count > 0, np.maximum(floor, sums(np.where(has, errors, 0.0), run_of) / np.maximum(count, 1)), r[0])
    return q, r, ll


def backtest_report(steps: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """A row per key from the steps of a filter (run_filter): steps, readings, rejected, mean_nis and ll of the whole series. All of
    it are sums, so a series of any length is reported without being held."""
    told = steps.select(*keys, F.struct(*order).alias("__at"), "ll", "outcomes")
    seen = F.filter("outcomes", lambda o: o["w"] > 0)
    nis = F.aggregate(seen, F.lit(0.0), lambda a, o: a + o["y"] * o["y"] / o["s"])
    told = told.withColumns({"__seen": F.size(seen), "__nis": nis, "__all": F.size("outcomes")})
    sums = told.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.sum("__all").alias("readings"), F.sum(F.col("__all") - F.col("__seen")).alias("rejected"), F.sum("__nis").alias("__nis"), F.sum("__seen").alias("__seen"), F.max_by("ll", "__at").alias("ll"))
    return sums.withColumn("mean_nis", F.when(F.col("__seen") > 0, F.col("__nis") / F.when(F.col("__seen") > 0, F.col("__seen")))).drop("__nis", "__seen")


def backtest(config: dict, ts_ns: list[int], values: list[dict[int, float]], truth: np.ndarray | None = None, most_lag: int = 20) -> dict:
    """Likelihood, mean nis, and, if the true states are known, nees, errors filtered and smoothed, and the lag of the filtered first state."""
    kalman, steps, nis = make_filter(config), [], []
    for t, v in zip(ts_ns, values, strict=True):
        nis += [y * y / s for _, y, s, w in kalman.step(t, v) if w > 0]
        d, x, p = kalman.prior
        steps.append({"dt": d, "x": kalman.x.copy(), "p": kalman.p.copy(), "x_prior": x, "p_prior": p})
    smoothed = rauch_tung_striebel(steps, lambda dt: kalman.motion.at(dt)[0])
    out = {"steps": len(steps), "ll": kalman.ll, "mean_nis": float(np.mean(nis)) if nis else None}
    if truth is not None:
        truth = np.asarray(truth, float)
        x, s = np.array([k["x"] for k in steps]), np.array([k[0] for k in smoothed])
        out |= {"mean_nees": float(np.mean([nees(t - k["x"], k["p"]) for t, k in zip(truth, steps, strict=True)])), "rmse": np.sqrt(((x - truth) ** 2).mean(0)).tolist(), "rmse_smoothed": np.sqrt(((s - truth) ** 2).mean(0)).tolist()}
        if len(steps) >= 50:
            gaps = [float(((x[k:, 0] - truth[: len(truth) - k, 0]) ** 2).mean()) for k in range(most_lag + 1)]
            out["lag"] = int(np.argmin(gaps))
    return out
