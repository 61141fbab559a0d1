"""Measures over several instruments, aligned by timestamp: a timestamp counts if every constituent has a row there."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.rolling import rolling_beta
from tideline.plans.frames import ln

C = F.col
BY = ("ts_ns",)


def _own():
    return Window.partitionBy("symbol").orderBy(*BY)


def aligned(df: DataFrame, constituents: list[str]) -> DataFrame:
    """Rows (ts_ns, symbol, price, size) of the constituents at timestamps that have all of them."""
    rows = df.filter(C("symbol").isin(constituents))
    whole = rows.groupBy("ts_ns").agg(F.countDistinct("symbol").alias("n")).filter(C("n") == len(constituents)).drop("n")
    return rows.join(whole, "ts_ns", "left_semi")


def constituent_weights(rows: DataFrame, constituents: list[str], weighting: str = "equal", window: int = 60) -> DataFrame:
    """rows with r (log return) and w, the share of each constituent at each timestamp."""
    w, frame = _own(), _own().rowsBetween(1 - window, 0)
    rows = rows.withColumn("r", ln(C("price") / F.lag("price").over(w)))
    if weighting == "equal":
        return rows.withColumn("w", F.lit(1 / len(constituents)))
    if weighting == "volume":
        raw = F.avg("size").over(frame)
    elif weighting == "inverse_volatility":
        sigma = F.sqrt(F.avg(C("r") * C("r")).over(frame))
        raw = F.when((F.count("r").over(frame) == window) & (sigma > 0), 1 / F.when(sigma > 0, sigma))
    else:
        raise ValueError(f"no weighting {weighting}")
    rows = rows.withColumn("__raw", raw)
    at = Window.partitionBy("ts_ns")
    total = F.when(F.count("__raw").over(at) == len(constituents), F.sum("__raw").over(at))
    return rows.withColumn("w", F.when(total > 0, C("__raw") / F.when(total > 0, total))).drop("__raw")


def basket_return(df: DataFrame, constituents: list[str], weighting: str = "equal", window: int = 60) -> DataFrame:
    """ts_ns, basket, dispersion; NULL until every constituent has a return and a weight."""
    rows = constituent_weights(aligned(df, constituents), constituents, weighting, window)
    n = len(constituents)
    sums = rows.groupBy("ts_ns").agg(F.count(C("w") * C("r")).alias("k"), F.sum(C("w") * C("r")).alias("m"), F.collect_list(F.struct("w", "r")).alias("all"))
    sums = sums.withColumn("basket", F.when(C("k") == n, C("m")))
    spread = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["w"] * (x["r"] - C("basket")) * (x["r"] - C("basket")))
    return sums.select("ts_ns", "basket", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("__d")).select("ts_ns", "basket", F.when(C("basket").isNotNull(), C("__d")).alias("dispersion"))


def relative_strength(df: DataFrame, asset: str, constituents: list[str], beta_window: int = 60, weighting: str = "equal", window: int = 60) -> DataFrame:
    """ts_ns, excess, beta, beta_adjusted of an asset against the basket."""
    basket = basket_return(df, constituents, weighting, window)
    own = df.filter(C("symbol") == asset).withColumn("ra", ln(C("price") / F.lag("price").over(_own()))).select("ts_ns", "ra")
    both = own.join(basket, "ts_ns").withColumn("symbol", F.lit(asset))
    both = rolling_beta(both, beta_window, "ra", "basket", "beta", order=BY)
    return both.select("ts_ns", (C("ra") - C("basket")).alias("excess"), "beta", (C("ra") - C("beta") * C("basket")).alias("beta_adjusted"))


def market_strength(df: DataFrame, constituents: list[str], window: int = 60, blend: float = 0.5, weighting: str = "volume") -> DataFrame:
    """ts_ns, breadth, momentum, msi over returns of ``window`` steps."""
    rows = constituent_weights(aligned(df, constituents), constituents, weighting, window)
    w, frame = _own(), _own().rowsBetween(1 - window, 0)
    rows = rows.withColumn("__long", ln(C("price") / F.lag("price", window).over(w)))
    sigma = F.sqrt(F.avg(C("r") * C("r")).over(frame))
    rows = rows.withColumn("__s", F.when((F.count("r").over(frame) == window) & (sigma > 0), sigma))
    rows = rows.withColumn("__m", C("w") * C("__long") / (C("__s") * sqrt(window)))
    n = len(constituents)
    out = rows.groupBy("ts_ns").agg(
        F.when(F.count("__long") == n, 2 * F.sum(F.when(C("__long") > 0, 1.0).otherwise(0.0)) / n - 1).alias("breadth"), F.when(F.count("__m") == n, F.sum("__m")).alias("momentum")
    )
    return out.withColumn("msi", blend * C("breadth") + (1 - blend) * F.tanh("momentum"))
