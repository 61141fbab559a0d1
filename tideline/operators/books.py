"""Books from changes of their levels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = "array<struct<price:double,size:double>>"


class BookState:
    """The levels of both sides; a size of nil or less takes a level away."""

    def __init__(self):
        self.sides: dict[str, dict[float, float]] = {"bid": {}, "ask": {}}

    def change(self, side: str, price: float, size: float) -> None:
        if size > 0:
            self.sides[side][price] = size
        else:
            self.sides[side].pop(price, None)

    def side(self, name: str) -> list[dict[str, float]]:
        """Best price first."""
        return [{"price": p, "size": s} for p, s in sorted(self.sides[name].items(), reverse=name == "bid")]


def from_deltas(deltas: DataFrame, at: DataFrame) -> DataFrame:
    """symbol, ts_ns, bids, asks at each time of ``at`` (symbol, ts_ns), after all changes up to it.

    deltas: symbol, ts_ns, seq, side (bid or ask), price, size. Rows of a symbol pass in order through one state; memory is that of
    a batch and a book."""
    changes = deltas.select("symbol", "ts_ns", F.lit(0).alias("kind"), "seq", "side", "price", "size")
    asked = at.select("symbol", "ts_ns", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("size"))
    rows = changes.unionByName(asked).repartition("symbol").sortWithinPartitions("symbol", "ts_ns", "kind", "seq")
    kind = pa.list_(pa.struct([("price", pa.float64()), ("size", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, BookState()
        for batch in batches:
            out = []
            for symbol, ts, asked_for, _, side, price, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if symbol != held:
                    held, state = symbol, BookState()
                if asked_for:
                    out.append((symbol, ts, state.side("bid"), state.side("ask")))
                else:
                    state.change(side, price, size)
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), kind, kind), strict=True)], names=["symbol", "ts_ns", "bids", "asks"])

    return rows.mapInArrow(run, f"symbol string, ts_ns long, bids {LEVELS}, asks {LEVELS}")
