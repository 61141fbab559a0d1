"""Stateful sessions in Structured Streaming: one per symbol, with reordering, a policy for late ticks, commands and snapshots.

Ticks wait until the watermark (the greatest event time seen less ``reorder`` seconds) has passed them and then go in order of
(ts_ns, seq). A tick older than the last one taken is dropped, fails the query, or is retrodicted. Commands are rows that flush
what is ripe and then act. The state of a session is its pickled filter and the ticks that wait.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tideline.operators.filters import KalmanFilter, make_filter, retrodict
from tideline.operators.models import Observation
from tideline.operators.recurrent import Kernel

OUT = "symbol string, ts_ns bigint, kind string, x array<double>, p array<double>, ll double, steps bigint, dropped bigint, retrodicted bigint"


@dataclass
class Session:
    """The owner of a filter; also usable on its own, row by row."""

    kalman: KalmanFilter
    reorder_ns: int = 0
    late: str = "drop"
    every: int = 100
    waiting: list = field(default_factory=list)
    watermark: int | None = None
    dropped: int = 0
    retrodicted: int = 0
    taken: int = 0

    def offer(self, ts_ns: int, seq: int, values: dict | None, command: dict | None) -> list[tuple[str, int]]:
        """Take a row in; the snapshots it brings: (kind, time)."""
        out: list[tuple[str, int]] = []
        if command:
            out += self.flush(self.watermark)
            return out + self.command(command, ts_ns)
        self.waiting.append((ts_ns, seq, values or {}))
        newest = ts_ns - self.reorder_ns
        self.watermark = newest if self.watermark is None else max(self.watermark, newest)
        return out + self.flush(self.watermark)

    def flush(self, until: int | None) -> list[tuple[str, int]]:
        """Pass on what is ripe, in order; all of it without a bound."""
        out = []
        ripe = sorted((w for w in self.waiting if until is None or w[0] <= until), key=lambda w: w[:2])
        self.waiting = [w for w in self.waiting if until is not None and w[0] > until]
        for ts, _, values in ripe:
            out += self.tick(ts, values)
        return out

    def tick(self, ts: int, values: dict) -> list[tuple[str, int]]:
        if self.kalman.ts is not None and ts < self.kalman.ts:
            if self.late == "fail":
                raise ValueError(f"tick at {ts} after {self.kalman.ts}")
            if self.late == "retrodict" and retrodict(self.kalman, ts, values) is not None:
                self.retrodicted += 1
            else:
                self.dropped += 1
            return []
        self.kalman.step(ts, values)
        self.taken += 1
        return [("periodic", ts)] if self.taken % self.every == 0 else []

    def command(self, command: dict, ts: int) -> list[tuple[str, int]]:
        kind, k = command["kind"], self.kalman
        n = len(k.x)
        per_state = lambda name, rest: np.array([command.get(name, {}).get(str(i), rest) for i in range(n)], float)
        if kind == "split":
            k.scale(per_state("factors", 1.0))
        elif kind == "dividend":
            k.shift(-per_state("amounts", 0.0))
        elif kind == "rebalance":
            k.observation = Observation([{int(j): c for j, c in r.items()} for r in command["rows"]], list(command["variances"]))
            k.add_variance(per_state("added", 0.0))
        elif kind == "reset":
            k.reset(command["x"], np.reshape(command["p"], (n, n)), command.get("ts_ns"))
        elif kind == "snapshot":
            return [("requested", ts)]
        else:
            raise ValueError(f"no command {kind}")
        return []

    def row(self, symbol: str, kind: str, ts: int) -> dict:
        k = self.kalman
        return {"symbol": symbol, "ts_ns": ts, "kind": kind, "x": k.x.tolist(), "p": k.p.ravel().tolist(), "ll": k.ll, "steps": k.steps, "dropped": self.dropped, "retrodicted": self.retrodicted}


class _Processor(StatefulProcessor):
    def __init__(self, make: Callable[[], Session], drain: bool):
        self.make, self.drain = make, drain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        session = pickle.loads(self.state.get()[0]) if self.state.exists() else self.make()
        out = []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                values = {int(a): float(b) for a, b in (dict(r.values) if r.values is not None else {}).items()}
                for kind, ts in session.offer(int(r.ts_ns), int(r.seq), values, json.loads(r.command) if r.command else None):
                    out.append(session.row(key[0], kind, ts))
        if self.drain:
            for kind, ts in session.flush(None):
                out.append(session.row(key[0], kind, ts))
        out.append(session.row(key[0], "batch", session.kalman.ts or 0))
        self.state.update((pickle.dumps(session),))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def filter_stream(ticks: DataFrame, model: dict, options: dict | None = None, reorder_seconds: float = 0.0, late: str = "drop", every: int = 100, drain: bool = False) -> DataFrame:
    """A streaming DataFrame (symbol, ts_ns, seq, values, command) to snapshots: every ``every`` ticks, on request, and the last of each batch.

    ``drain`` passes on all that waits at the end of each batch, for sources that end."""
    if late not in ("drop", "retrodict", "fail"):
        raise ValueError(f"no policy {late}")
    make = lambda: Session(make_filter(model, options), round(reorder_seconds * 1e9), late, every)
    return ticks.select("symbol", "ts_ns", "seq", "values", "command").groupBy("symbol").transformWithStateInPandas(_Processor(make, drain), OUT, "Update", "None")


class _KernelProcessor(StatefulProcessor):
    def __init__(self, make: Callable[[], Kernel], inputs: tuple[str, ...], outputs: tuple[str, ...]):
        self.make, self.inputs, self.outputs = make, inputs, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kernel", "held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        kernel = pickle.loads(self.state.get()[0]) if self.state.exists() else self.make()
        pdf = pd.concat(list(rows)).sort_values(["ts_ns", "seq"])
        made = [kernel.step(*v) for v in pdf[list(self.inputs)].itertuples(index=False, name=None)]
        self.state.update((pickle.dumps(kernel),))
        out = pdf[["symbol", "ts_ns", "seq"]].reset_index(drop=True)
        for k, name in enumerate(self.outputs):
            out[name] = [m[k] for m in made]
        yield out

    def close(self) -> None:
        pass


def scan_stream(df: DataFrame, make: Callable[[], Kernel]) -> DataFrame:
    """A kernel over a stream: the outputs of ``scan``, with the state kept between batches; rows of a batch go in order."""
    model = make()
    schema = ", ".join(["symbol string, ts_ns bigint, seq bigint", *[f"{o} double" for o in model.outputs]])
    columns = dict.fromkeys(["symbol", "ts_ns", "seq", *model.inputs])
    return df.select(*columns).groupBy("symbol").transformWithStateInPandas(_KernelProcessor(make, model.inputs, model.outputs), schema, "Append", "None")


def stream_bars(ticks: DataFrame, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Time bars of a stream (symbol, ts, seq, price, size), each given out once its interval is past the watermark."""
    from pyspark.sql import functions as F

    at = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"))
        .select("symbol", (F.unix_seconds("w.start") / seconds).cast("bigint").alias("bucket"), "open", "high", "low", "close", "volume", "trades")
    )


def grid_ticks(ticks: DataFrame, seconds: int) -> DataFrame:
    """Ticks and, for each symbol, a blind one at every whole interval between its first and last: the filter's clock goes on."""
    from pyspark.sql import functions as F

    step = seconds * 1_000_000_000
    span = ticks.groupBy("symbol").agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence(F.expr(f"(a div {step} + 1) * {step}"), F.greatest(F.expr(f"b div {step} * {step}"), F.expr(f"(a div {step} + 1) * {step}")), F.lit(step))).alias("ts_ns"), F.lit(-1).cast("bigint").alias("seq"))
    blind = grid.withColumn("values", F.create_map().cast("map<int,double>"))
    return ticks.select("symbol", "ts_ns", "seq", "values").unionByName(blind.select("symbol", "ts_ns", "seq", "values"))
