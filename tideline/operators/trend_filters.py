"""Two-state filters on one price as kernels of plain numbers: the local linear trend, alpha-beta, the gain at rest, the filtered derivative."""

from __future__ import annotations

import math
import statistics
from collections import deque

from tideline.operators.filters import LN_2PI, AlphaBetaFilter, Gate, SteadyStateFilter
from tideline.operators.models import local_linear_trend
from tideline.operators.recurrent import Kernel


class TrendState:
    """The local linear trend's recursion, written out for two states and one channel."""

    __slots__ = ("gate", "level", "ll", "p00", "p01", "p11", "q", "r", "rate", "s", "steps", "ts", "w", "y")

    def __init__(self, q: float, r: float, level: float, p00: float, p11: float, ts: int | None = None, gate: Gate | None = None):
        self.q, self.r, self.level, self.rate, self.p00, self.p01, self.p11 = q, r, level, 0.0, p00, 0.0, p11
        self.ts, self.gate, self.ll, self.steps, self.y, self.s, self.w = ts, gate, 0.0, 0, 0.0, 0.0, 1.0

    def step(self, ts: int, z: float) -> None:
        dt = 0.0 if self.ts is None else (ts - self.ts) / 1e9
        if dt < 0:
            raise ValueError("a reading is older than the last one")
        if dt > 0:
            q = self.q
            self.level += dt * self.rate
            self.p00 += dt * (2 * self.p01 + dt * self.p11) + q * dt**3 / 3
            self.p01 += dt * self.p11 + q * dt**2 / 2
            self.p11 += q * dt
        self.ts, self.steps = ts, self.steps + 1
        y, s = z - self.level, self.p00 + self.r
        weight, _, s_eff = (1.0, self.r, s) if self.gate is None else self.gate.weigh(y, s, self.r)
        self.y, self.s, self.w = y, s, weight
        if weight:
            a, b = self.p00, self.p01
            self.level += a * y / s_eff
            self.rate += b * y / s_eff
            self.p00, self.p01, self.p11 = a - a * a / s_eff, b - a * b / s_eff, self.p11 - b * b / s_eff
            self.ll -= 0.5 * (y * y / s_eff + math.log(s_eff) + LN_2PI)


class TrendFilter(Kernel):
    """Starts at the first price."""

    inputs, outputs = ("ts_ns", "price"), ("level", "rate", "level_var", "rate_var", "innovation", "innovation_var", "weight", "ll", "score")

    def __init__(self, sigma_a: float, half_spread: float, tick: float = 0.0, velocity_std: float = 1.0, gate: Gate | None = None):
        self.q, self.r, self.v, self.gate, self.state = sigma_a**2, half_spread**2 + tick**2 / 12, velocity_std**2, gate, None

    def step(self, ts_ns, price):
        if self.state is None:
            self.state = TrendState(self.q, self.r, price, self.r, self.v, gate=self.gate)
        s = self.state
        s.step(ts_ns, price)
        return s.level, s.rate, s.p00, s.p11, s.y, s.s, s.w, s.ll, s.rate / math.sqrt(s.p11) if s.p11 > 0 else None


class AlphaBeta(Kernel):
    outputs = ("position", "velocity")

    def __init__(self, sigma_a: float, sigma_r: float, dt: float, closed_form: bool = True):
        make = AlphaBetaFilter.tracking if closed_form else AlphaBetaFilter.constant_velocity
        self.filter, self.started = make(sigma_a, sigma_r, dt), False

    def step(self, price):
        if not self.started:
            self.filter.position, self.started = price, True
        return self.filter.step(price)


class SteadyTrend(Kernel):
    outputs = ("level", "rate")

    def __init__(self, sigma_a: float, half_spread: float, dt: float):
        self.filter, self.started = SteadyStateFilter(local_linear_trend(sigma_a, half_spread), dt), False

    def step(self, price):
        if not self.started:
            self.filter.x[0], self.started = price, True
        x = self.filter.step([price])
        return float(x[0]), float(x[1])


class FilteredDerivative(Kernel):
    """The rate of a series by a trend filter whose noises come from the first ``calibration`` differences."""

    takes_gaps = True
    inputs, outputs = ("ts_ns", "price"), ("rate", "level", "rate_std", "level_std", "t_stat")

    def __init__(self, tracking: float = 0.01, noise: float | None = None, calibration: int = 50):
        self.tracking, self.noise, self.state, self.last, self.clock = tracking, noise, None, None, None
        self.changes, self.intervals = deque(maxlen=calibration), deque(maxlen=calibration)

    def step(self, ts_ns, price):
        if price is None or math.isnan(price):
            return self._told()
        if self.state is not None:
            self.state.step(ts_ns, price)
        else:
            if self.last is not None:
                self.changes.append(price - self.last)
                if (dt := (ts_ns - self.clock) / 1e9) > 0:
                    self.intervals.append(dt)
            if len(self.changes) == self.changes.maxlen:
                self._start(ts_ns, price)
        self.last, self.clock = price, ts_ns
        return self._told()

    def _start(self, ts_ns, price):
        noise = self.noise if self.noise is not None else statistics.stdev(self.changes) / math.sqrt(2)
        if not noise > 0:
            self.changes.clear()
            return
        interval = statistics.fmean(self.intervals) if self.intervals else 1.0
        sigma_a = self.tracking * noise * math.sqrt(3) / interval**1.5
        self.state = TrendState(sigma_a**2, noise**2, price, noise**2, (noise / interval) ** 2, ts_ns)

    def _told(self):
        s = self.state
        if s is None or not s.steps:
            return None, None, None, None, None
        rate_std = math.sqrt(s.p11) if s.p11 > 0 else None
        return s.rate, s.level, rate_std, math.sqrt(s.p00) if s.p00 > 0 else None, None if rate_std is None else s.rate / rate_std
