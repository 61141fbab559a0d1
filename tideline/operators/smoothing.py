"""Smoothing of filtered steps: Rauch-Tung-Striebel over a whole series, or over the last steps only."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.filters import KalmanFilter, make_filter
from tideline.operators.linalg import symmetric
from tideline.operators.models import Motion
from tideline.operators.side_by_side import Runs, buffers, doubles, handed_out
from tideline.plans.frames import KEYS


def smooth_back(x, p, x_prior, p_prior, f, x_next, p_next) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance and lag-one covariance of a step from its own filtered state and the smoothed next one."""
    gain = np.linalg.solve(p_prior, f @ p).T
    return x + gain @ (x_next - x_prior), symmetric(p + gain @ (p_next - p_prior) @ gain.T), p_next @ gain.T


def rauch_tung_striebel(steps: list[dict], transition: Callable[[float], np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """steps: dt, x, p, x_prior, p_prior (arrays), oldest first."""
    out: list = [None] * len(steps)
    if steps:
        out[-1] = (steps[-1]["x"], steps[-1]["p"], None)
    for k in range(len(steps) - 2, -1, -1):
        s, t = steps[k], steps[k + 1]
        if t["dt"] <= 0:  # no time passed: the next state is this one, better known
            out[k] = (out[k + 1][0], out[k + 1][1], out[k + 1][1])
            continue
        out[k] = smooth_back(s["x"], s["p"], t["x_prior"], t["p_prior"], transition(t["dt"]), *out[k + 1][:2])
    return out


def _arrays(row: dict, n: int) -> dict:
    return {"dt": row["dt"], "x": np.array(row["x"]), "p": np.reshape(row["p"], (n, n)), "x_prior": np.array(row["x_prior"]), "p_prior": np.reshape(row["p_prior"], (n, n))}


def smooth(steps: DataFrame, model: dict | Callable, keys=KEYS, order=("ts_ns", "seq")) -> DataFrame:
    """steps (of run_filter) with xs and ps. The rows of a key pass once more, in reverse order: memory stays that of a batch."""
    schema = T.StructType([*steps.schema.fields, T.StructField("xs", T.ArrayType(T.DoubleType())), T.StructField("ps", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        motion = make_filter(model).motion
        held, later, found = None, None, None
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_pylist()
            key = list(zip(*map(column, keys), strict=True))
            parts = {c: column(c) for c in ("dt", "x", "p", "x_prior", "p_prior")}
            xs, ps = [], []
            for i, k in enumerate(key):
                own = _arrays({c: v[i] for c, v in parts.items()}, len(parts["x"][i]))
                if k != held:
                    found = (own["x"], own["p"])
                elif later["dt"] > 0:
                    found = smooth_back(own["x"], own["p"], later["x_prior"], later["p_prior"], motion.at(later["dt"])[0], *found)[:2]
                held, later = k, own
                xs.append(found[0].tolist())
                ps.append(found[1].ravel().tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(xs, kind), pa.array(ps, kind)], names=[f.name for f in schema])

    return steps.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).desc() for c in order]).mapInArrow(run, schema)


class FixedLagSmoother:
    """The state of ``lag`` steps ago given all readings so far; None until there are so many."""

    def __init__(self, kalman: KalmanFilter, lag: int):
        self.kalman, self.lag = kalman, lag
        self.held: deque = deque(maxlen=lag + 1)

    def step(self, ts_ns: int, values: dict[int, float]) -> tuple[np.ndarray, np.ndarray] | None:
        self.kalman.step(ts_ns, values)
        dt, x, p = self.kalman.prior
        self.held.append({"dt": dt, "x": self.kalman.x.copy(), "p": self.kalman.p.copy(), "x_prior": x, "p_prior": p})
        if len(self.held) <= self.lag:
            return None
        return rauch_tung_striebel(list(self.held), lambda dt: self.kalman.motion.at(dt)[0])[0][:2]


def smooth_lagged(steps: DataFrame, model: dict | Callable, lag: int, keys=KEYS, order=("ts_ns", "seq")) -> DataFrame:
    """steps with xs: each step's state given the ``lag`` readings after it; NULL for the last ``lag`` steps of a key."""
    schema = T.StructType([*steps.schema.fields, T.StructField("xs", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        motion, rest = make_filter(model).motion, None
        for columns in buffers(batches):
            if rest is not None:
                columns = {c: pa.concat_arrays([rest[c], a]) for c, a in columns.items()}
            made = columns | {"xs": lagged_states(columns, keys, motion, lag)}
            runs = Runs(columns, keys)
            cut = max(runs.rows - lag, int(runs.first[-1]))  # what stays: the end of a series that may go on
            yield from handed_out({c: a.slice(0, cut) for c, a in made.items()})
            rest = {c: a.slice(cut) for c, a in columns.items()}
        if rest is not None and len(rest["x"]):
            yield from handed_out(rest | {"xs": lagged_states(rest, keys, motion, lag)})

    return steps.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def lagged_states(columns: dict[str, pa.Array], keys, motion: Motion, lag: int) -> pa.Array:
    """The smoothed state of every row whose ``lag`` later rows are there; all rows go back a step at once."""
    runs, rows = Runs(columns, keys), len(columns["x"])
    flat = lambda c: columns[c].flatten().to_numpy().reshape(rows, -1)
    x, n = flat("x"), flat("x").shape[1]
    dt, prior = doubles(columns["dt"]), flat("x_prior")
    ends = np.repeat(np.append(runs.first[1:], rows), np.diff(np.append(runs.first, rows)))
    on = np.flatnonzero((np.arange(rows) + 1 < ends) & (np.append(dt[1:], 0.0) > 0))
    gain = np.zeros((rows, n, n))
    if len(on):
        f = motion.many(dt[on + 1])[0].transpose(2, 0, 1)
        gain[on] = np.linalg.solve(flat("p_prior").reshape(rows, n, n)[on + 1], f @ flat("p").reshape(rows, n, n)[on]).transpose(0, 2, 1)
    moves = np.zeros(rows, bool)
    moves[on] = True
    told = np.flatnonzero(np.arange(rows) + lag < ends)
    now = x[told + lag]
    for j in range(lag - 1, -1, -1):
        r = told + j
        back = x[r] + (gain[r] * (now - prior[np.minimum(r + 1, rows - 1)])[:, None]).sum(2)
        now = np.where(moves[r][:, None], back, now)
    has = np.zeros(rows, bool)
    has[told] = True
    offsets = np.concatenate([[0], np.cumsum(has) * n])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(now.ravel()), mask=pa.array(~has))
