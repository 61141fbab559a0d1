"""Sharding by histogram sort: shards of near-equal bytes over the order (hash of the text, doc_id).

Each round counts, in one pass over narrow rows and with map-side sums, the exact bytes below every probe, and narrows the
interval of each splitter to the two probes around its target, until a probe is within the tolerance or an interval is one
key. Only probes and their counts (at most ``shards * probes`` of them, whatever the input) reach the driver. Equal texts are
neighbours in that order, and a group that holds many rows is split at doc_ids. Then rows are exchanged once.

Null text counts as empty; a null doc_id sorts as the least long; rows that agree in text and doc_id share a shard;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.scratch import materialise

LOW, HIGH = -(1 << 63), (1 << 63) - 1
SPAN = 1 << 64


def _wide(h: int, i: int) -> int:
    return (h - LOW) * SPAN + (i - LOW)


def _split(key: int) -> tuple[int, int]:
    return key // SPAN + LOW, key % SPAN + LOW


def bucket(h: np.ndarray, i: np.ndarray, probes: list[int]) -> np.ndarray:
    """How many of the sorted probes are at or below each key."""
    ends = np.array([_split(p) for p in probes], np.int64).reshape(-1, 2)
    out = np.searchsorted(ends[:, 0], h, "left")
    for v in np.unique(ends[:, 0]):
        tied = h == v
        if tied.any():
            lo, hi = np.searchsorted(ends[:, 0], v, "left"), np.searchsorted(ends[:, 0], v, "right")
            out[tied] = lo + np.searchsorted(ends[lo:hi, 1], i[tied], "right")
    return out


def _counts(rows: DataFrame, probes: list[int]) -> dict:
    """Exact bytes, rows and end keys between the probes: sums of each batch first, then of all; a row per probe at most."""

    def run(batches):
        for batch in batches:
            h, i, size = (batch.column(k).to_numpy() for k in ("h", "i", "size"))
            order = np.lexsort((i, h))
            h, i, size = h[order], i[order], size[order]
            b, start, n = np.unique(bucket(h, i, probes), return_index=True, return_counts=True)
            if len(b):
                last = start + n - 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (b, np.add.reduceat(size, start), n, h[start], i[start], h[last], i[last])], names=list("bsn") + ["lh", "li", "hh", "hi"])

    parts = rows.select("h", "i", "size").mapInArrow(run, "b long, s long, n long, lh long, li long, hh long, hi long")
    found = parts.groupBy("b").agg(F.sum("s").alias("bytes"), F.sum("n").alias("n"), F.min(F.struct("lh", "li")).alias("lo"), F.max(F.struct("hh", "hi")).alias("hi"))
    return {r["b"]: r for r in found.collect()}


def _assign(rows: DataFrame, ends: list[int]) -> DataFrame:
    def run(batches):
        for batch in batches:
            b = bucket(batch.column("h").to_numpy(), batch.column("i").to_numpy(), ends)
            yield batch.append_column("shard", pa.array(b, pa.int32()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))


def splitters(rows: DataFrame, shards: int, probes: int = 8, tolerance: float = 0.001, trace: list | None = None) -> list[int]:
    """``shards - 1`` keys in ascending order; a row belongs to as many shards on as keys are at or below its own.

    rows: h long, i long, size long."""
    key = F.struct("h", "i")
    sums = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")]
    all_rows = rows.agg(*sums).first()
    total = all_rows["bytes"]
    if not total:
        return [_wide(HIGH, HIGH)] * (shards - 1)
    slack = tolerance * total / shards
    below = {_wide(*all_rows["lo"]): 0, _wide(*all_rows["hi"]) + 1: total}  # probe: exact bytes of the rows under it
    gaps = {_wide(*all_rows["lo"]): (all_rows["n"], _wide(*all_rows["lo"]), _wide(*all_rows["hi"]))}  # probe: rows from it to the next, their ends
    goals = [total * k // shards for k in range(1, shards)]
    while True:
        keys = sorted(below)
        marks = [below[x] for x in keys]
        asked: set[int] = set()
        best = []
        for goal in goals:
            at = min(max(1, bisect_left(marks, goal)), len(keys) - 1)
            best.append(min(keys[at - 1 : at + 1], key=lambda x: abs(below[x] - goal)))
            n, lo, hi = gaps.get(keys[at - 1], (0, 0, 0))
            if abs(below[best[-1]] - goal) > slack and n > 1 and hi > lo:
                asked |= {lo + (hi - lo) * j // (probes + 1) for j in range(1, probes + 1)} | {hi}
                if lo // SPAN != hi // SPAN:  # where a group of equal texts may begin or end
                    asked |= {(lo // SPAN + 1) * SPAN, hi // SPAN * SPAN}
        asked = sorted(asked - below.keys())
        if trace is not None:
            trace.append((len(asked), best, dict(below)))
        if not asked:
            return best
        asked = sorted({*asked, *keys[:-1]})
        found = _counts(rows, asked)
        sofar = 0
        for j, x in enumerate(asked):
            below[x] = sofar
            r = found.get(j + 1)
            gaps[x] = (r["n"], _wide(*r["lo"]), _wide(*r["hi"])) if r else (0, x, x)
            sofar += r["bytes"] if r else 0


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, spread: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row; ``spread`` parts of a shard are numbered side by side."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("i"))
    rows = materialise(narrow, "shard-keys")
    ends = splitters(rows.select("h", "i", "size"), shards, tolerance=tolerance)
    placed = _assign(rows, ends).withColumn("part", F.pmod(F.hash("i", "h"), F.lit(spread)))
    counts = placed.groupBy("shard", "part").count()
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "i"))
    # ``before`` has shards * spread rows at most.
    out = placed.withColumn("number", number).join(F.broadcast(before), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents in 24 shards of near-equal bytes."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 24)
