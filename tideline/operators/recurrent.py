"""Metrics that depend on all that went before: one small state per symbol, carried over sorted rows.

``scan`` shuffles rows to their symbol's partition, sorts them and passes them through a kernel batch by batch, so a symbol of any
length needs the memory of one batch. The same kernels run in the streaming session, which keeps their pickled state.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tideline.plans.frames import KEYS, ORDER

BAR_ORDER = ("open_ns",)


class Kernel:
    """inputs: columns that a step takes; outputs: names of the doubles that it returns (None: undefined).

    A row whose inputs are not all there (NULL or NaN) has undefined outputs and leaves the state as it is; a kernel with
    ``takes_gaps`` gets such rows, too."""

    takes_gaps = False
    inputs: tuple[str, ...] = ("price",)
    outputs: tuple[str, ...] = ()

    def step(self, *values: float) -> tuple:
        raise NotImplementedError


def scan(df: DataFrame, make: Callable[[], Kernel], keys=KEYS, order=ORDER) -> DataFrame:
    """df with the kernel's outputs."""
    model = make()
    outputs, inputs, takes_gaps = model.outputs, model.inputs, model.takes_gaps
    blank = (None,) * len(outputs)
    names = [c for c in df.columns if c not in outputs]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(o, T.DoubleType()) for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kernel = None, make()
        for batch in batches:
            key = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
            columns = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs), strict=True)
            out = []
            for k, values in zip(key, columns, strict=True):
                if k != held:
                    held, kernel = k, make()
                out.append(kernel.step(*values) if takes_gaps or all(v is not None and v == v for v in values) else blank)
            made = list(zip(*out, strict=True)) or [() for _ in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(m, pa.float64()) for m in made], names=names + list(outputs))

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


# ---- averages


class Average:
    """sma, wma, ema (2 / (n + 1)) or rma (1 / n); the last two start at the mean of the first n."""

    def __init__(self, kind: str, n: int):
        if kind not in ("sma", "wma", "ema", "rma") or n < 1:
            raise ValueError(f"no average {kind} of {n}")
        self.kind, self.n, self.count, self.value = kind, n, 0, None
        self.alpha = 2 / (n + 1) if kind == "ema" else 1 / n
        self.window: deque = deque(maxlen=n)
        self.total = 0.0

    def push(self, x: float) -> float | None:
        if self.kind in ("sma", "wma"):
            self.window.append(x)
            if len(self.window) < self.n:
                return None
            if self.kind == "sma":
                return math.fsum(self.window) / self.n
            return math.fsum((k + 1) * v for k, v in enumerate(self.window)) / (self.n * (self.n + 1) / 2)
        self.count += 1
        if self.count < self.n:
            self.total += x
        elif self.count == self.n:
            self.value = (self.total + x) / self.n
        else:
            self.value += self.alpha * (x - self.value)
        return self.value


class TimedAverage:
    """Starts at its first reading, decays with market time; ready once ``tau`` seconds have passed. Steps back in time change nothing but the clock."""

    def __init__(self, tau: float):
        self.tau, self.value, self.clock, self.elapsed = tau, None, None, 0.0

    def push(self, ts_ns: int, x: float) -> float | None:
        if self.value is None:
            self.value = x
        else:
            dt = (ts_ns - self.clock) / 1e9
            if dt > 0:
                self.value += -math.expm1(-dt / self.tau) * (x - self.value)
                self.elapsed += dt
        self.clock = ts_ns
        return self.value if self.elapsed >= self.tau else None


class MovingAverage(Kernel):
    def __init__(self, kind: str = "ema", period: int = 20, x: str = "price", out: str | None = None):
        self.inputs, self.outputs, self.average = (x,), (out or kind,), Average(kind, period)

    def step(self, x):
        return (self.average.push(x),)


class TimedEma(Kernel):
    inputs, outputs = ("ts_ns", "price"), ("ema_timed",)

    def __init__(self, tau: float):
        self.average = TimedAverage(tau)

    def step(self, ts_ns, x):
        return (self.average.push(ts_ns, x),)


class Macd(Kernel):
    outputs = ("macd", "macd_signal", "macd_histogram")

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9, kind: str = "ema"):
        self.fast, self.slow, self.signal = Average(kind, fast), Average(kind, slow), Average(kind, signal)

    @classmethod
    def promql(cls) -> Macd:
        return cls(8, 17, 9, "sma")

    def step(self, x):
        f, s = self.fast.push(x), self.slow.push(x)
        if f is None or s is None:
            return None, None, None
        line = f - s
        signal = self.signal.push(line)
        return line, signal, None if signal is None else line - signal


class TimedMacd(Kernel):
    inputs, outputs = ("ts_ns", "price"), ("macd", "macd_signal", "macd_histogram")

    def __init__(self, fast: float, slow: float, signal: float):
        self.fast, self.slow, self.signal = TimedAverage(fast), TimedAverage(slow), TimedAverage(signal)

    def step(self, ts_ns, x):
        f, s = self.fast.push(ts_ns, x), self.slow.push(ts_ns, x)
        if f is None or s is None:
            return None, None, None
        line = f - s
        signal = self.signal.push(ts_ns, line)
        return line, signal, None if signal is None else line - signal


class MaSpread(Kernel):
    outputs = ("fast", "slow", "spread", "relative")

    def __init__(self, fast: int = 120, slow: int = 2880, kind: str = "ema"):
        if not fast < slow:
            raise ValueError("fast must be shorter than slow")
        self.fast, self.slow = Average(kind, fast), Average(kind, slow)

    def step(self, x):
        f, s = self.fast.push(x), self.slow.push(x)
        if f is None or s is None:
            return f, s, None, None
        return f, s, f - s, (f - s) / s if s > 0 else None


# ---- momentum


def rsi_index(gain: float, loss: float) -> float:
    return 100 * gain / (gain + loss) if gain + loss > 0 else 50.0


class Rsi(Kernel):
    """Wilder's relative strength of changes over ``lag`` steps."""

    outputs = ("rsi", "avg_gain", "avg_loss")

    def __init__(self, period: int = 14, lag: int = 1, kind: str = "rma"):
        if kind not in ("rma", "sma"):
            raise ValueError("rsi takes rma or sma")
        self.gain, self.loss, self.prices = Average(kind, period), Average(kind, period), deque(maxlen=lag + 1)

    def step(self, price):
        self.prices.append(price)
        if len(self.prices) < self.prices.maxlen:
            return None, None, None
        change = price - self.prices[0]
        g, loss = self.gain.push(max(change, 0.0)), self.loss.push(max(-change, 0.0))
        return (None, None, None) if g is None else (rsi_index(g, loss), g, loss)


class TimedRsi(Kernel):
    inputs, outputs = ("ts_ns", "price"), ("rsi", "avg_gain", "avg_loss")

    def __init__(self, tau: float):
        self.tau, self.gain, self.loss, self.last, self.clock, self.elapsed = tau, 0.0, 0.0, None, None, 0.0

    def step(self, ts_ns, price):
        if self.last is not None and (dt := (ts_ns - self.clock) / 1e9) > 0:
            alpha, change = -math.expm1(-dt / self.tau), price - self.last
            self.gain += alpha * (max(change, 0.0) - self.gain)
            self.loss += alpha * (max(-change, 0.0) - self.loss)
            self.elapsed += dt
        self.last, self.clock = price, ts_ns
        return (rsi_index(self.gain, self.loss), self.gain, self.loss) if self.elapsed >= self.tau else (None, None, None)


# ---- bars


class Atr(Kernel):
    inputs, outputs = ("high", "low", "close"), ("true_range", "atr")

    def __init__(self, period: int = 14):
        self.average, self.close = Average("rma", period), None

    def step(self, high, low, close):
        tr = high - low if self.close is None else max(high - low, abs(high - self.close), abs(low - self.close))
        self.close = close
        return tr, self.average.push(tr)


class Adx(Kernel):
    inputs, outputs = ("high", "low", "close"), ("plus_di", "minus_di", "dx", "adx", "settled")

    def __init__(self, period: int = 14):
        self.parts = [Average("rma", period) for _ in range(4)]
        self.bar, self.bars, self.settle = None, 0, 11 * period

    def step(self, high, low, close):
        self.bars += 1
        settled = 1.0 if self.bars >= self.settle else 0.0
        if self.bar is None:
            self.bar = (high, low, close)
            return None, None, None, None, settled
        h, lo, c = self.bar
        self.bar = (high, low, close)
        up, down = high - h, lo - low
        tr = self.parts[0].push(max(high - low, abs(high - c), abs(low - c)))
        plus = self.parts[1].push(up if up > down and up > 0 else 0.0)
        minus = self.parts[2].push(down if down > up and down > 0 else 0.0)
        if tr is None or not tr > 0:
            return None, None, None, None, settled
        p, m = 100 * plus / tr, 100 * minus / tr
        dx = 100 * abs(p - m) / (p + m) if p + m > 0 else 0.0
        return p, m, dx, self.parts[3].push(dx), settled


# ---- volatility


class EwmaVolatility(Kernel):
    """A price that is not above zero has no return: it is undefined there, and the next return is from the last price that was."""

    outputs = ("ewma_volatility",)

    def __init__(self, decay: float = 0.94):
        self.decay, self.last, self.var = decay, None, None

    def step(self, price):
        if not price > 0:
            return (None,)
        if self.last is not None:
            r = math.log(price / self.last)
            self.var = r * r if self.var is None else self.decay * self.var + (1 - self.decay) * r * r
        self.last = price
        return (None if self.var is None else math.sqrt(self.var),)


# ---- greedy bars


class VolumeBarNumber(Kernel):
    """The bar of each trade: a bar closes with the trade that brings it to the threshold, and the next starts from nothing."""

    inputs, outputs = ("size",), ("bar", "closes")

    def __init__(self, threshold: float):
        self.threshold, self.volume, self.bar = threshold, 0.0, 0

    def step(self, size):
        self.volume += size
        bar = float(self.bar)
        if self.volume >= self.threshold:
            self.volume, self.bar = 0.0, self.bar + 1
            return bar, 1.0
        return bar, 0.0


def volume_bars(df: DataFrame, threshold: float, flush: bool = False) -> DataFrame:
    from pyspark.sql import functions as F

    from tideline.operators.bars import _collect

    numbered = scan(df, lambda: VolumeBarNumber(threshold))
    bars = _collect(numbered, F.col("bar").cast("long"))
    if flush:
        return bars
    closed = numbered.groupBy(*KEYS, F.col("bar").cast("long").alias("bucket")).agg(F.max("closes").alias("c")).filter("c = 1").drop("c")
    return bars.join(closed, [*KEYS, "bucket"], "left_semi")
