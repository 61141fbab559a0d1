"""Bars and the volume clock: three ways of cutting a stream of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans.frames import KEYS, ordered, running

C = F.col


def _collect(df: DataFrame, bucket: Column, keys=KEYS) -> DataFrame:
    """Bars by bucket; prices open and close by (ts_ns, seq). All parts are sums, so they are added up before the shuffle."""
    at = F.struct("ts_ns", "seq")
    size = C("size") if "size" in df.columns else F.lit(0.0)
    return df.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(
        F.min("ts_ns").alias("open_ns"), F.max("ts_ns").alias("close_ns"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum(size).alias("volume"), F.count(F.lit(1)).alias("trades"),
    )


def time_bars(df: DataFrame, seconds: int, flush: bool = False) -> DataFrame:
    """Bars of whole intervals since the epoch; a symbol's last bar is still open, and only there if ``flush``."""
    bars = _collect(df, F.expr(f"ts_ns div {seconds * 1_000_000_000}"))
    if flush:
        return bars
    return bars.withColumn("__last", F.max("bucket").over(Window.partitionBy(*KEYS))).filter("bucket < __last").drop("__last")


def tick_bars(df: DataFrame, ticks: int, flush: bool = False) -> DataFrame:
    numbered = df.withColumn("__n", F.row_number().over(ordered()) - 1)
    bars = _collect(numbered, F.expr(f"__n div {ticks}"))
    return bars if flush else bars.filter(C("trades") == ticks)


def volume_clock(df: DataFrame, bucket_size: float) -> DataFrame:
    """Trades split over buckets of equal volume: symbol, ts_ns, seq, bucket, overlap, buy."""
    c = F.sum("size").over(running())
    df = df.filter("size > 0").withColumn("__c", c).withColumn("__b", C("__c") - C("size"))
    first, final = F.floor(C("__b") / bucket_size), F.ceil(C("__c") / bucket_size) - 1
    df = df.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, final))))
    df = df.withColumn("overlap", F.least(C("__c"), (C("bucket") + 1) * bucket_size) - F.greatest(C("__b"), C("bucket") * bucket_size))
    share = F.when(C("sign") > 0, 1.0).when(C("sign") < 0, 0.0).otherwise(0.5)
    return df.withColumn("buy", C("overlap") * share).drop("__c", "__b")


def volume_buckets(df: DataFrame, bucket_size: float) -> DataFrame:
    """symbol, bucket, buy, sell, imbalance of the complete buckets."""
    sums = volume_clock(df, bucket_size).groupBy(*KEYS, "bucket").agg(F.sum("overlap").alias("volume"), F.sum("buy").alias("buy"))
    sums = sums.filter(C("volume") >= bucket_size * (1 - 1e-12))
    return sums.select(*KEYS, "bucket", "buy", (C("volume") - C("buy")).alias("sell"), (2 * C("buy") - C("volume")).alias("imbalance"))


def vpin(df: DataFrame, bucket_size: float = 1000.0, buckets: int = 50) -> DataFrame:
    """The toxicity of flow after each complete bucket, NULL until ``buckets`` are complete; also by actual volumes."""
    found = volume_buckets(df, bucket_size)
    w = Window.partitionBy(*KEYS).orderBy("bucket").rowsBetween(1 - buckets, 0)
    ready = F.count("bucket").over(w) == buckets
    total = F.sum(F.abs("imbalance")).over(w)
    return found.withColumns({"vpin": F.when(ready, total / (buckets * bucket_size)), "vpin_actual": F.when(ready, total / F.sum(C("buy") + C("sell")).over(w))})


def vpin_of_trades(df: DataFrame, bucket_size: float = 1000.0, buckets: int = 50) -> DataFrame:
    """Trades with the vpin of the last bucket that was complete then."""
    reached = df.withColumn("bucket", F.floor(F.sum("size").over(running()) / bucket_size) - 1)
    return reached.join(vpin(df, bucket_size, buckets).select(*KEYS, "bucket", "vpin"), [*KEYS, "bucket"], "left")
