"""Many series take their steps together: numpy over series, with the series on the last axis of every array.

Sorted rows are taken in buffers of bounded size and cut into runs of one key. Step t of all runs that have one is done at once; the
state of the run that a buffer's end cuts is handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tideline.operators.models import Model, Motion
from tideline.plans.frames import KEYS, ORDER

LN_2PI = float(np.log(2 * np.pi))
#: Rows that are held at once.
BUFFER = 100_000


def buffers(batches: Iterator[pa.RecordBatch], rows: int = BUFFER) -> Iterator[dict[str, pa.Array]]:
    """Columns of ``rows`` rows or a little more at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield joined(held)
            held = []
    if sum(b.num_rows for b in held):
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> dict[str, pa.Array]:
    whole = pa.Table.from_batches(batches)
    return {c: pa.concat_arrays(whole.column(c).chunks) for c in whole.column_names}


def handed_out(columns: dict[str, pa.Array], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_arrays(list(columns.values()), names=list(columns)).to_batches(max_chunksize=rows)


def doubles(column: pa.Array) -> np.ndarray:
    """NULL as NaN."""
    return column.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def lists(values: np.ndarray) -> pa.Array:
    """A row of a list column for each row of a matrix."""
    n = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


class Runs:
    """The runs of equal keys in a buffer, the longest first; ``goes_on``: the place of the one that began in the buffer before (or None)."""

    def __init__(self, columns: dict[str, pa.Array], keys, held: tuple | None = None):
        self.rows = len(columns[keys[0]])
        new = np.zeros(self.rows, bool)
        new[0] = True
        for k in keys:
            codes = columns[k].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        self.first = np.flatnonzero(new)
        lengths = np.diff(np.append(self.first, self.rows))
        by_length = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = self.first[by_length], lengths[by_length]
        self.key = lambda row: tuple(columns[k][int(row)].as_py() for k in keys)
        self.last, self.held = int(np.flatnonzero(self.starts == self.first[-1])[0]), self.key(self.rows - 1)
        self.goes_on = int(np.flatnonzero(self.starts == 0)[0]) if held is not None and held == self.key(0) else None

    def __len__(self) -> int:
        return len(self.starts)

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        """How many runs have a step t, and its row in each."""
        yield from steps(self.starts, self.lengths)

    def before(self, values: np.ndarray, first: np.ndarray | int | float) -> np.ndarray:
        """The values a row earlier; ``first`` for the runs' first rows, by run."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out


def steps(starts: np.ndarray, lengths: np.ndarray, way: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """The same for any runs whose lengths fall; ``way`` -1 goes back from their ends."""
    for t in range(int(lengths[0])):
        k = int(np.searchsorted(-lengths, -t))
        yield k, starts[:k] + way * t


def moved(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    """F P F', nothing done for coefficients that are nil everywhere."""
    used = list(zip(*np.nonzero(f.any(2)), strict=True))
    half, out = np.zeros_like(p), np.zeros_like(p)
    for i, j in used:
        half[i] += f[i, j] * p[j]
    for i, j in used:
        out[:, i] += f[i, j] * half[:, j]
    return out


def times(f: np.ndarray, x: np.ndarray) -> np.ndarray:
    """F X for vectors (n, k) or matrices (n, m, k)."""
    out = np.zeros_like(x)
    for i, j in zip(*np.nonzero(f.any(2)), strict=True):
        out[i] += f[i, j] * x[j]
    return out


def even(p: np.ndarray) -> np.ndarray:
    return (p + p.transpose(1, 0, 2)) / 2


class Readings:
    """The readings of a buffer's rows, from maps of channel to value; NULL and NaN are none."""

    def __init__(self, values: pa.Array):
        at = values.offsets.to_numpy()
        counts = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        held = np.concatenate([np.arange(a, a + c) for a, c in zip(at[:-1], counts, strict=True)]) if counts.sum() != at[-1] - at[0] else np.arange(at[0], at[-1])
        z = doubles(values.items)[held]
        kept = ~np.isnan(z)
        self.z, self.channel = z[kept], values.keys.to_numpy(zero_copy_only=False)[held][kept].astype(np.int64)
        self.counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[kept], minlength=len(counts))
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self.most = int(self.counts.max(initial=0))

    def of(self, row: int) -> dict[int, float]:
        to = slice(self.offsets[row], self.offsets[row + 1])
        return dict(zip(self.channel[to].tolist(), self.z[to].tolist(), strict=True))

    def at(self, rows: np.ndarray) -> Iterator[tuple[slice | np.ndarray, np.ndarray]]:
        """The first reading of all these rows that have one, then the second: which rows, and which readings."""
        for j in range(self.most):
            has = self.counts[rows] > j
            if has.all():
                yield slice(0, len(rows)), self.offsets[rows] + j
            elif has.any():
                at = np.flatnonzero(has)
                yield at, self.offsets[rows[at]] + j


def frame_sums(x: np.ndarray, first: int, n: int) -> np.ndarray:
    """The sums of all whole frames of n rows, added up as databases with segment trees do: what stands before the first whole block of
    16 rows of the partition, then the blocks' own sums, then the rest. ``first``: the place of x[0] in its partition."""
    out = np.empty(max(0, len(x) - n + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, n) if len(out) else None
    for phase in range(min(16, len(out))):
        w, done = frames[phase::16], 0.0
        head = min(n, -(first + phase) % 16)
        blocks = (n - head) // 16
        for j in range(head):
            done = done + w[:, j]
        for k in range(blocks):
            block = 0.0
            for j in range(16):
                block = block + w[:, head + 16 * k + j]
            done = done + block
        for j in range(head + 16 * blocks, n):
            done = done + w[:, j]
        out[phase::16] = done
    return out


def blockwise_sums(df: DataFrame, x: str, n: int, out: str, keys=KEYS, order=ORDER) -> DataFrame:
    """df with the sum of x over the last n rows (NULL counts as 0; NULL until there are n). Sums that cancel come out equal to those of
    the database to the last bit (up to 256 rows), whatever the length of the series."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, seen = None, np.zeros(0), 0
        for columns in buffers(batches):
            runs, values, sums = Runs(columns, keys, held), np.nan_to_num(doubles(columns[x])), np.full(len(columns[x]), np.nan)
            for k, (start, stop) in enumerate(zip(runs.first, [*runs.first[1:], runs.rows], strict=True)):
                if k or runs.goes_on is None:
                    kept, seen = np.zeros(0), 0
                own = np.concatenate([kept, values[start:stop]])
                made = frame_sums(own, seen - len(kept), n)
                sums[stop - len(made) : stop] = made
                kept, seen = own[max(0, len(own) - n + 1) :], seen + int(stop - start)
            held = runs.held
            yield from handed_out(columns | {out: pa.array(sums, from_pandas=True)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Filters:
    """The filter of one model for many series (the ``sequential`` form): x (n, k), p (n, n, k), ll (k)."""

    def __init__(self, model: Model, k: int, gate=None):
        self.motion: Motion = model.motion
        self.n = n = model.motion.n
        self.h, self.r = model.observation.matrix(n), np.asarray(model.observation.variances, float)
        self.x, self.p, self.ll = np.repeat(np.asarray(model.x0, float)[:, None], k, 1), np.repeat(((model.p0 + model.p0.T) / 2).astype(float)[:, :, None], k, 2), np.zeros(k)
        self.gate = gate

    def predict(self, dt: np.ndarray) -> None:
        """The first len(dt) series move; no time, no move."""
        if (dt < 0).any():
            raise ValueError("a reading is older than the last one")
        to = slice(0, len(dt)) if (dt > 0).all() else np.flatnonzero(dt > 0)
        dt = dt[to]
        if len(dt):
            f, q, u = self.motion.many(dt)
            x = times(f, self.x[:, to])
            self.x[:, to] = x if u is None else x + u
            self.p[:, :, to] = even(moved(f, self.p[:, :, to]) + q)

    def seen(self, channel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (n, k or 1) and variances of readings."""
        return (self.h[0][:, None], self.r[0]) if len(self.h) == 1 and not channel.any() else (self.h[channel].T, self.r[channel])

    def correct(self, to, channel: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One reading for each of the series ``to``: innovation, its variance, weight."""
        h, r = self.seen(channel)
        x, p = self.x[:, to], self.p[:, :, to]
        y = z - (h * x).sum(0)
        phi = (p * h).sum(1)
        s = (h * phi).sum(0) + r
        if not (s > 0).all():
            raise ArithmeticError(f"innovation variance {s[~(s > 0)][0]}")
        w, s_eff = np.ones_like(s), s
        if self.gate is not None and self.gate.kind == "limit":
            w = np.where(y * y / s > self.gate.limit, 0.0, 1.0)
        elif self.gate is not None and self.gate.kind == "huber":
            u = np.sqrt(y * y / s)
            far = u > self.gate.limit
            w = np.where(far, self.gate.limit / np.where(far, u, 1.0), 1.0)
            s_eff = np.where(far, s - r + r * u / self.gate.limit, s)
        on = w > 0
        self.x[:, to] = np.where(on, x + phi * (y / s_eff), x)
        self.p[:, :, to] = np.where(on, p - phi[:, None] * phi[None] / s_eff, p)
        self.ll[to] -= np.where(on, 0.5 * (y * y / s_eff + np.log(s_eff) + LN_2PI), 0.0)
        return y, s, w



    def arrays(self) -> list[np.ndarray]:
        return [self.x, self.p]


class ManyModels:
    """``InteractingModels`` for many series: regimes of one state, all starting at the first price; mu (regimes, k)."""

    def __init__(self, regimes: list[Model], transition, first: np.ndarray, floor: float = 1e-9):
        self.filters, self.pi, self.floor = [Filters(m, len(first)) for m in regimes], np.asarray(transition, float), floor
        for f in self.filters:
            f.x[0] = first
        self.mu, self.mixes = np.full((len(regimes), len(first)), 1 / len(regimes)), np.zeros(len(first), bool)

    def arrays(self) -> list[np.ndarray]:
        return [a for f in self.filters for a in f.arrays()] + [self.mu, self.mixes]

    def step(self, dt: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
        k, none = len(z), np.zeros(len(z), np.int64)
        mu, on = self.mu[:, :k], self.mixes[:k]
        ahead = (self.pi.T[:, :, None] * mu[None]).sum(1)
        means, covariances = [f.x[:, :k].copy() for f in self.filters], [f.p[:, :, :k].copy() for f in self.filters]
        told = np.zeros_like(mu)
        for j, f in enumerate(self.filters):
            w = np.where(ahead[j] > 0, self.pi[:, j][:, None] * mu / np.where(ahead[j] > 0, ahead[j], 1.0), 0.0)
            x = sum(a * m for a, m in zip(w, means, strict=True))
            p = sum(a * (c + (m - x)[:, None] * (m - x)[None]) for a, m, c in zip(w, means, covariances, strict=True))
            f.x[:, :k], f.p[:, :, :k] = np.where(on, x, means[j]), np.where(on, even(p), covariances[j])
            f.ll[:k] = 0.0
            f.predict(dt)
            f.correct(slice(0, k), none, z)
            told[j] = f.ll[:k]
        mu = np.exp(told - told.max(0)) * ahead
        mu = np.maximum(self.floor, mu / mu.sum(0))
        self.mu[:, :k], self.mixes[:k] = mu / mu.sum(0), True
        mu = self.mu[:, :k]
        return sum(m * f.x[0, :k] for m, f in zip(mu, self.filters, strict=True)), mu[1].copy(), mu.argmax(0).astype(float)


class UnscentedFilters(Filters):
    """``UnscentedKalmanFilter`` of a linear model for many series, starting at the first price."""

    def __init__(self, model: Model, first: np.ndarray, alpha: float = 1e-3, beta: float = 2.0, kappa: float = 0.0):
        super().__init__(model, len(first))
        self.x[0] = first
        n = self.n
        self.spread = alpha * alpha * (n + kappa)
        self.wm = np.full((2 * n + 1, 1), 0.5 / self.spread)
        self.wc = self.wm.copy()
        self.wm[0] = (self.spread - n) / self.spread
        self.wc[0] = self.wm[0] + 1 - alpha * alpha + beta

    def points(self, to) -> np.ndarray:
        """(points, n, k)"""
        x, p, n = self.x[:, to], self.spread * self.p[:, :, to], self.n
        low = np.zeros_like(p)
        scale = np.maximum(1e-300, np.abs(np.einsum("iik->ik", p)).max(0))
        for j in range(n):
            d = p[j, j] - (low[j, :j] ** 2).sum(0)
            on = d > 1e-14 * scale
            low[j, j] = np.sqrt(np.where(on, d, 0.0))
            low[j + 1 :, j] = np.where(on, (p[j + 1 :, j] - (low[j + 1 :, :j] * low[j, :j]).sum(1)) / np.where(on, low[j, j], 1.0), 0.0)
        return np.concatenate([x[None], x + low.transpose(1, 0, 2), x - low.transpose(1, 0, 2)])

    def predict(self, dt: np.ndarray) -> None:
        if (dt < 0).any():
            raise ValueError("a reading is older than the last one")
        to = slice(0, len(dt)) if (dt > 0).all() else np.flatnonzero(dt > 0)
        if len(dt := dt[to]):
            f, q, u = self.motion.many(dt)
            ahead = np.array([times(f, x) for x in self.points(to)])
            ahead = ahead if u is None else ahead + u
            # Means are taken around the central point, whose weight is large and negative.
            self.x[:, to] = ahead[0] + (self.wm[1:, None] * (ahead[1:] - ahead[0])).sum(0)
            off = ahead - self.x[:, to]
            self.p[:, :, to] = even(((self.wc[:, None] * off)[:, :, None] * off[:, None]).sum(0) + q)

    def step(self, dt: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
        to = slice(0, len(z))
        self.predict(dt)
        h, r = self.seen(np.zeros(1, np.int64))
        points = self.points(to)
        seen = (points * h).sum(1)
        mean = seen[0] + (self.wm[1:] * (seen[1:] - seen[0])).sum(0)
        off = seen - mean
        phi, s = ((self.wc * off)[:, None] * (points - self.x[:, to])).sum(0), (self.wc * off * off).sum(0) + r
        self.x[:, to] += phi * ((z - mean) / s)
        self.p[:, :, to] = even(self.p[:, :, to] - phi[:, None] * phi[None] / s)
        return self.x[0, to].copy(), self.x[1, to] * 100, np.sqrt(self.p[0, 0, to])


def scan_prices(df: DataFrame, make, outputs: tuple[str, ...], keys=KEYS, order=ORDER) -> DataFrame:
    """df (ts_ns, price) with the outputs of a filter: make(first prices) gives step(seconds passed, prices) for many series. As in
    ``scan``, a row without a price has undefined outputs and changes nothing."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, clock, state = None, 0, []
        for columns in buffers(batches):
            price = doubles(columns["price"])
            has = np.flatnonzero(~np.isnan(price))
            made = np.full((len(outputs), len(price)), np.nan)
            if len(has):
                runs = Runs({k: columns[k].take(pa.array(has)) for k in keys}, keys, held)
                z, ts = price[has], columns["ts_ns"].to_numpy()[has]
                many, first = make(z[runs.starts]), ts[runs.starts].copy()
                if runs.goes_on is not None:
                    first[runs.goes_on] = clock
                    for a, own in zip(many.arrays(), state, strict=True):
                        a[..., runs.goes_on] = own
                dt = (ts - runs.before(ts, first)) / 1e9
                for _, rows in runs.steps():
                    for k, o in enumerate(many.step(dt[rows], z[rows])):
                        made[k, has[rows]] = o
                held, clock, state = runs.held, ts[-1], [a[..., runs.last].copy() for a in many.arrays()]
            yield from handed_out(columns | {o: pa.array(m, from_pandas=True) for o, m in zip(outputs, made, strict=True)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


#: Rows of a segment: all segments of a buffer go side by side.
SEGMENT = 512


class Segments(Filters):
    """What stretches of a series do to any state before them, without knowing it (Särkkä and García-Fernández 2021): a state x0 ends at
    A x0 + b with covariance C, and the readings have the likelihood exp(c + eta' x0 - x0' J x0 / 2)."""

    def __init__(self, model: Model, k: int):
        super().__init__(model, k)
        n = self.n
        self.x[:], self.p[:] = 0.0, 0.0
        self.a, self.eta, self.j, self.ll = np.repeat(np.eye(n)[:, :, None], k, 2), np.zeros((n, k)), np.zeros((n, n, k)), np.zeros(k)

    def predict(self, dt: np.ndarray) -> None:
        super().predict(dt)
        if (to := np.flatnonzero(dt > 0)).size:
            self.a[:, :, to] = times(self.motion.many(dt[to])[0], self.a[:, :, to])

    def correct(self, to, channel: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, _ = self.seen(channel)
        a, phi = self.a[:, :, to], (self.p[:, :, to] * h).sum(1)
        y, s, w = super().correct(to, channel, z)
        own = (a * h[:, None]).sum(0)
        self.eta[:, to] += own * (y / s)
        self.j[:, :, to] += own[:, None] * own[None] / s
        self.a[:, :, to] = a - phi[:, None] * own[None] / s
        return y, s, w

    def parts(self, k: int) -> tuple:
        return self.a[:, :, k], self.x[:, k], self.p[:, :, k], self.eta[:, k], self.j[:, :, k], float(self.ll[k])


def follow(one: tuple, two: tuple) -> tuple:
    """Two stretches as one."""
    (a1, b1, c1, eta1, j1, l1), (a2, b2, c2, eta2, j2, l2) = one, two
    d, y = np.eye(len(b1)) + c1 @ j2, eta2 - j2 @ b1
    wide = np.linalg.solve(d, c1)
    ll = l1 + l2 + eta2 @ b1 - b1 @ j2 @ b1 / 2 - np.linalg.slogdet(d)[1] / 2 + y @ wide @ y / 2
    j = a1.T @ np.linalg.solve(d.T, j2) @ a1 + j1
    c = a2 @ wide @ a2.T + c2
    return a2 @ np.linalg.solve(d, a1), a2 @ np.linalg.solve(d, b1 + c1 @ eta2) + b2, (c + c.T) / 2, a1.T @ np.linalg.solve(d.T, y) + eta1, (j + j.T) / 2, float(ll)


def past(state: tuple, stretch: tuple) -> tuple:
    """The state (x, p, ll so far) after a stretch."""
    (x, p, ll), (a, b, c, eta, j, l) = state, stretch
    d, y = np.eye(len(x)) + p @ j, eta - j @ x
    wide = np.linalg.solve(d, p)
    q = a @ wide @ a.T + c
    told = l + eta @ x - x @ j @ x / 2 - np.linalg.slogdet(d)[1] / 2 + y @ wide @ y / 2
    return a @ np.linalg.solve(d, x + p @ eta) + b, (q + q.T) / 2, float(ll + told)


def segments(runs: Runs, most: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Starts and lengths of the runs' segments, the longest first; and, for each run from the first row on, its segments in order."""
    stops = np.append(runs.first[1:], runs.rows)
    cuts = [np.arange(a, b, most) for a, b in zip(runs.first, stops, strict=True)]
    starts = np.concatenate(cuts)
    lengths = np.minimum(most, np.repeat(stops, [len(c) for c in cuts]) - starts)
    by_length = np.argsort(-lengths, kind="stable")
    place = np.argsort(by_length)
    at = np.cumsum([0, *map(len, cuts)])
    return starts[by_length], lengths[by_length], [place[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def through(many: Filters, starts: np.ndarray, lengths: np.ndarray, dt: np.ndarray, seen: Readings, each=None) -> None:
    for k, rows in steps(starts, lengths):
        many.predict(dt[rows])
        for to, which in seen.at(rows):
            many.correct(to, seen.channel[which], seen.z[which])
        if each is not None:
            each(k, rows)


def filter_long(ticks: DataFrame, model: Model, keys=KEYS, order=ORDER, rows: int = 50_000, most: int = 1024) -> DataFrame:
    """keys, order columns, x, p and ll of a filter over series of any length: each is cut by time into pieces that go to different
    tasks. One pass tells what each piece does to any state, the driver carries the state over them (a few matrices for each of at
    most about ``most`` pieces of a series), a second pass filters all pieces from where they begin. Exact but for rounding; no gates."""
    ticks = ticks.select(*dict.fromkeys([*keys, *order, "ts_ns", "values"]))
    pieces = max(1, min(most, ticks.count() // rows))
    bounds = np.unique(ticks.approxQuantile("ts_ns", [k / pieces for k in range(1, pieces)], 0.1 / pieces)) if pieces > 1 else np.zeros(0)
    n = model.motion.n
    own, numbers = [*keys, "__piece"], T.ArrayType(T.DoubleType())

    def cut(batches):
        for b in batches:
            place = np.searchsorted(bounds, b.column(b.schema.get_field_index("ts_ns")).to_numpy().astype(float))
            yield b.append_column("__piece", pa.array(place, pa.int64()))

    placed = ticks.mapInArrow(cut, T.StructType([*ticks.schema.fields, T.StructField("__piece", T.LongType())]))
    placed = placed.repartition(*own).sortWithinPartitions(*own, *order)

    def read(batches):
        """Buffers with their runs, intervals (nil where a piece begins) and readings, and what each segment does."""
        held, clock = None, 0
        for columns in buffers(batches):
            runs, ts, seen = Runs(columns, own, held), columns["ts_ns"].to_numpy(), Readings(columns["values"])
            first = ts[runs.starts].copy()
            if runs.goes_on is not None:
                first[runs.goes_on] = clock
            dt = (ts - runs.before(ts, first)) / 1e9
            starts, lengths, order_of = segments(runs)
            done = Segments(model, len(starts))
            through(done, starts, lengths, dt, seen)
            yield columns, runs, ts, dt, seen, starts, lengths, order_of, done
            held, clock = runs.held, ts[-1]

    def tell(batches):
        held: dict | None = None
        schema = pa.schema([(k, t) for k, t in (("key", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("parts", pa.list_(pa.float64())))])

        def told(h):
            return pa.RecordBatch.from_pylist([{"key": repr(h["key"]), "first": int(h["first"]), "last": int(h["last"]), "parts": np.concatenate([np.ravel(v) for v in h["parts"]]).tolist()}], schema)

        for _, runs, ts, _, _, _, _, order_of, done in read(batches):
            stops = np.append(runs.first[1:], runs.rows)
            for k, places in enumerate(order_of):
                key, parts = runs.key(runs.first[k]), [done.parts(p) for p in places]
                if held is None or held["key"] != key:
                    if held is not None:
                        yield told(held)
                    held = {"key": key, "first": ts[runs.first[k]], "parts": parts.pop(0)}
                for p in parts:
                    held["parts"] = follow(held["parts"], p)
                held["last"] = ts[stops[k] - 1]
        if held is not None:
            yield told(held)

    found = placed.mapInArrow(tell, "key string, first long, last long, parts array<double>").collect()
    begins: dict[str, tuple] = {}
    series, state, clock = None, None, 0
    for r in sorted(found, key=lambda r: (r["key"][: r["key"].rindex(",")], r["first"])):
        flat, name = np.array(r["parts"]), r["key"][: r["key"].rindex(",")]
        if name != series:
            series, state = name, (np.asarray(model.x0, float), (model.p0 + model.p0.T) / 2, 0.0)
        elif (dt := (r["first"] - clock) / 1e9) > 0:
            f, q, u = model.motion.at(dt)
            x, p, ll = state
            state = (f @ x if u is None else f @ x + u, f @ p @ f.T + q, ll)
        begins[r["key"]], clock = state, r["last"]
        m = n * n
        state = past(state, (flat[:m].reshape(n, n), flat[m : m + n], flat[m + n : 2 * m + n].reshape(n, n), flat[2 * m + n : 2 * m + 2 * n], flat[2 * m + 2 * n : 3 * m + 2 * n].reshape(n, n), flat[-1]))
    shared = ticks.sparkSession.sparkContext.broadcast(begins)
    names = list(dict.fromkeys([*keys, *order]))

    def run(batches):
        state = None
        for columns, runs, _, dt, seen, starts, lengths, order_of, done in read(batches):
            many, going = Filters(model, len(starts)), runs.goes_on is not None
            for k, places in enumerate(order_of):
                if k or not going:
                    state = shared.value[repr(runs.key(runs.first[k]))]
                for p in places:
                    many.x[:, p], many.p[:, :, p], many.ll[p] = state
                    state = past(state, done.parts(p))
            x, p, ll = np.empty((runs.rows, n)), np.empty((runs.rows, n * n)), np.empty(runs.rows)

            def keep(k, rows, many=many, x=x, p=p, ll=ll):
                x[rows], p[rows], ll[rows] = many.x[:, :k].T, many.p[:, :, :k].reshape(n * n, k).T, many.ll[:k]

            through(many, starts, lengths, dt, seen, keep)
            yield from handed_out({c: columns[c] for c in names} | {"x": lists(x), "p": lists(p), "ll": pa.array(ll)})

    return placed.mapInArrow(run, T.StructType([*[ticks.schema[c] for c in names], T.StructField("x", numbers), T.StructField("p", numbers), T.StructField("ll", T.DoubleType())]))
