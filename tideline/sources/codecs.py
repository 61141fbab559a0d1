"""Ticks as text, JSON, CSV, binary frames and exchange messages, read and written by column expressions where they can be."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
VALUES = "map<int,double>"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, plain or gzipped, without blank ones and those that begin with #."""
    return spark.read.text(path).filter(~C("value").rlike(r"^\s*(#|$)")).withColumnRenamed("value", "line")


def write_history(ticks: DataFrame, path: str, gzip: bool = True) -> None:
    """Ticks as lines of JSON."""
    ticks.select(encode_json(ticks)).write.text(path, compression="gzip" if gzip else "none")


def _int_keys(m: Column) -> Column:
    return F.transform_keys(m, lambda k, v: k.cast("int"))


def decode_json(df: DataFrame, line: str = "line") -> DataFrame:
    """Strict: ts_ns, values and rows of every line; a line without a ts or values, or with other types, fails the query."""
    told = F.from_json(line, "ts bigint, values map<string,double>, rows map<string,map<string,double>>", {"mode": "PERMISSIVE"})
    df = df.withColumn("__t", told)
    bad = C("__t.ts").isNull() | C("__t.values").isNull() | F.exists(F.map_values("__t.values"), lambda v: v.isNull())
    df = df.withColumn("ts_ns", F.when(bad, F.raise_error(F.concat(F.lit("not a tick: "), C(line))).cast("bigint")).otherwise(C("__t.ts")))
    rows = F.transform_values(_int_keys(C("__t.rows")), lambda k, v: _int_keys(v))
    return df.withColumns({"values": _int_keys(C("__t.values")), "rows": rows}).drop("__t", line)


def decode_json_messages(df: DataFrame, line: str = "line", remap: dict[int, int] | None = None) -> DataFrame:
    """Lenient: frames that are no ticks, and ticks without a number, are left out; channels may be renamed, others then go."""
    told = F.from_json(line, "ts bigint, values map<string,string>")
    df = df.withColumn("__t", told).filter("__t.ts is not null and __t.values is not null")
    values = F.map_filter(F.transform_values("__t.values", lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull() & k.try_cast("int").isNotNull())
    if remap is not None:
        names = F.create_map(*[F.lit(x) for pair in remap.items() for x in (str(pair[0]), pair[1])])
        values = F.map_filter(values, lambda k, v: F.map_contains_key(names, k))
        values = F.transform_keys(values, lambda k, v: F.element_at(names, k))
    else:
        values = _int_keys(values)
    return df.withColumns({"ts_ns": C("__t.ts"), "values": values}).drop("__t", line).filter(F.size("values") > 0)


def encode_json(df: DataFrame) -> Column:
    """{"ts", "values", "rows"} with channels in ascending order."""
    ordered = lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))
    parts = [C("ts_ns").alias("ts"), ordered(C("values")).alias("values")]
    if "rows" in df.columns:
        parts.append(C("rows"))
    return F.to_json(F.struct(*parts)).alias("value")


def decode_csv(df: DataFrame, line: str = "line") -> DataFrame:
    """``ts,v0,v1`` by place (empty: missing) or ``ts,channel:value``; a time may be written as a whole-valued decimal."""
    parts = F.split(C(line), ",", -1)
    df = df.withColumn("__p", F.transform(parts, lambda x: F.trim(x)))
    ts = F.get("__p", 0)
    cells = F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0)))
    pairs = F.transform(cells, lambda x, i: F.struct(F.when(F.contains(x, F.lit(":")), F.split_part(x, F.lit(":"), F.lit(1)).cast("int")).otherwise(i).alias("k"), F.when(F.contains(x, F.lit(":")), F.split_part(x, F.lit(":"), F.lit(2))).otherwise(x).alias("v")))
    kept = F.filter(pairs, lambda p: p["v"] != "")
    values = F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"].alias("key"), p["v"].cast("double").alias("value"))))
    return df.withColumns({"ts_ns": F.coalesce(ts.try_cast("bigint"), ts.cast("decimal(38,9)").cast("bigint")), "values": values}).drop("__p", line)


def encode_csv(channels: int) -> Column:
    """``ts,v0,v1,...`` with empty cells for missing channels; numbers in full."""
    return F.concat_ws(",", C("ts_ns").cast("string"), *[F.coalesce(F.element_at("values", k).cast("string"), F.lit("")) for k in range(channels)]).alias("value")


# ---- binary frames: a header of 8 bytes, the time, a group header, then (channel, value) entries, all little endian

HEADER, GROUP, ENTRY = struct.Struct("<HHHH"), struct.Struct("<HH"), struct.Struct("<Hd")
#: Fixed values of the schema.
BLOCK_BYTES, TEMPLATE, SCHEMA, VERSION = 8, 1, 1, 0


def encode_frame(ts_ns: int, values: dict[int, float]) -> bytes:
    body = b"".join(ENTRY.pack(c, v) for c, v in sorted(values.items()))
    return HEADER.pack(BLOCK_BYTES, TEMPLATE, SCHEMA, VERSION) + struct.pack("<Q", ts_ns) + GROUP.pack(ENTRY.size, len(values)) + body


def decode_frame(frame: bytes) -> tuple[int, dict[int, float]] | None:
    """The tick of a frame; None for other templates; a cut frame raises."""
    if len(frame) < HEADER.size:
        raise ValueError("cut frame")
    _, template, schema, _ = HEADER.unpack_from(frame)
    if template != TEMPLATE or schema != SCHEMA:
        return None
    if len(frame) < HEADER.size + 12:
        raise ValueError("cut frame")
    ts = struct.unpack_from("<Q", frame, HEADER.size)[0]
    size, count = GROUP.unpack_from(frame, HEADER.size + 8)
    at = HEADER.size + 12
    if len(frame) < at + size * count:
        raise ValueError("cut frame")
    return ts, dict(ENTRY.unpack_from(frame, at + k * size) for k in range(count))


def decode_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Frames to ticks, by Arrow batches."""

    @F.pandas_udf(f"struct<ts_ns:bigint,values:{VALUES}>")
    def told(frames: pd.Series) -> pd.DataFrame:
        found = [decode_frame(bytes(f)) for f in frames]
        return pd.DataFrame({"ts_ns": pd.array([None if f is None else f[0] for f in found], "Int64"), "values": [None if f is None else f[1] for f in found]})

    return df.withColumn("__t", told(C(frame))).filter("__t.ts_ns is not null").select(*[c for c in df.columns if c != frame], "__t.ts_ns", "__t.values")


def encode_frames(df: DataFrame) -> DataFrame:
    """Ticks to frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"frame": [encode_frame(int(t), dict(v)) for t, v in zip(pdf["ts_ns"], pdf["values"], strict=True)]})

    return df.select("ts_ns", "values").mapInPandas(run, "frame binary")


# ---- exchange messages


def decode_binance_trades(df: DataFrame, channels: dict[str, int], line: str = "line") -> DataFrame:
    """Trade messages, bare or in a ``data`` envelope; symbols without a channel are left out."""
    body = F.coalesce(F.get_json_object(line, "$.data"), C(line))
    df = df.withColumn("__t", F.from_json(body, "e string, s string, p string, q string, T bigint, m boolean"))
    names = F.create_map(*[F.lit(x) for pair in channels.items() for x in pair])
    df = df.filter("__t.e = 'trade'").withColumn("channel", F.try_element_at(names, C("__t.s"))).filter("channel is not null")
    return df.select(C("__t.s").alias("symbol"), "channel", (C("__t.T") * 1_000_000).alias("ts_ns"), C("__t.p").cast("double").alias("price"), C("__t.q").cast("double").alias("size"), F.when(C("__t.m"), -1.0).otherwise(1.0).alias("sign"))


def iso_to_ns(text: Column) -> Column:
    """A UTC time with 0 to 9 digits after the second, as nanoseconds."""
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0").cast("bigint")
    return F.unix_seconds(F.to_timestamp(F.regexp_replace(text, r"\.\d+", ""))) * 1_000_000_000 + fraction


def decode_coinbase_tickers(df: DataFrame, line: str = "line") -> DataFrame:
    """Ticker messages: the mid of the best prices if both are there, else the last price."""
    df = df.withColumn("__t", F.from_json(line, "type string, product_id string, price string, best_bid string, best_ask string, time string"))
    bid, ask = C("__t.best_bid").try_cast("double"), C("__t.best_ask").try_cast("double")
    price = F.coalesce((bid + ask) / 2, C("__t.price").try_cast("double"))
    return df.filter("__t.type = 'ticker'").select(C("__t.product_id").alias("symbol"), iso_to_ns(C("__t.time")).alias("ts_ns"), price.alias("price")).filter("price is not null")


# ---- sinks


def snapshot_json(compact: bool = False) -> Column:
    """A step of a filter as JSON: all of it, or the state and the diagonal only."""
    if not compact:
        return F.to_json(F.struct("symbol", "ts_ns", "x", "p", "ll"))
    n = F.size("x")
    diagonal = F.transform("x", lambda v, i: F.get("p", i * n + i))
    return F.to_json(F.struct("symbol", "ts_ns", "x", diagonal.alias("variance")))


def latest_state(steps: DataFrame, keys=("symbol",)) -> DataFrame:
    """The last step of every key: what a state endpoint would answer."""
    rest = [c for c in steps.columns if c not in keys]
    order = F.struct("ts_ns", "seq") if "seq" in steps.columns else F.col("ts_ns")
    return steps.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, "s.*")


def persist_latest(path: str, write=None):
    """A foreachBatch sink that keeps the last state of each key: a new folder per batch, named last by its marker file."""

    def sink(batch: DataFrame, number: int) -> None:
        latest_state(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if write is not None:
            write(batch, number)

    return sink


def trajectory_window(spark: SparkSession, path: str, first_ns: int, last_ns: int) -> DataFrame:
    """Steps of a stored trajectory between two times: the filter reaches the scan."""
    return spark.read.parquet(path).filter(C("ts_ns").between(first_ns, last_ns))


def merge_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Several feeds as one."""
    first, *rest = feeds
    for feed in rest:
        first = first.unionByName(feed, allowMissingColumns=True)
    return first
