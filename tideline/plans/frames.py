"""Ordered windows: one symbol a partition, rows by event time and sequence, undefined values as NULL.

A mean over a short frame is a built-in window aggregate. Over a longer one it is the difference of two running sums of values
taken relative to the partition's first one, since Spark adds up a bounded frame anew for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS, ORDER = ("symbol",), ("ts_ns", "seq")
#: Longest frame that is aggregated directly.
SHORT = 32


def ordered(keys=KEYS, order=ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def last(n: int, keys=KEYS, order=ORDER) -> WindowSpec:
    return ordered(keys, order).rowsBetween(1 - n, 0)


def running(keys=KEYS, order=ORDER) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def full(x: Column, value: Column, n: int, over: WindowSpec) -> Column:
    """value once n readings of x are in the frame."""
    return F.when(F.count(x).over(over) == n, value)


def positive(denominator: Column, value: Column) -> Column:
    """value where the denominator is above zero. Division only happens there."""
    return F.when(denominator > 0, value)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.log(F.when(x > 0, x)))


def log_of(a: Column, b: Column) -> Column:
    """ln(a / b) of prices that are not below zero, by the rules of IEEE: a price of nil gives an infinity, two give NaN."""
    some = (a > 0) & (b > 0)
    value = F.when(some, F.log(F.when(some, a) / F.when(some, b))).when(a > 0, float("inf")).when(b > 0, float("-inf"))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(value, F.lit(float("nan"))))


def moments(df: DataFrame, x: str, n: int, prefix: str, keys=KEYS, order=ORDER, partial: bool = False) -> DataFrame:
    """df with {prefix}_mean, {prefix}_var (population) and {prefix}_n over the last n readings; NULL until full, unless partial.

    Rows without a reading are to be dropped first."""
    if n <= SHORT:
        w = last(n, keys, order)
        count, mean, var = F.count(x).over(w), F.avg(x).over(w), F.var_pop(x).over(w)
        ready = F.lit(True) if partial else count == n
        return df.withColumns({f"{prefix}_n": count, f"{prefix}_mean": F.when(ready, mean), f"{prefix}_var": F.when(ready, var)})
    w, r = ordered(keys, order), running(keys, order)
    df = df.withColumn("__mod", F.col(x) - F.first(x).over(r))
    df = df.withColumns({"__mos": F.sum("__mod").over(r), "__moq": F.sum(F.col("__mod") * F.col("__mod")).over(r), "__mok": F.count("__mod").over(r)})
    df = df.withColumns({"__mos": F.col("__mos") - F.coalesce(F.lag("__mos", n).over(w), F.lit(0.0)), "__moq": F.col("__moq") - F.coalesce(F.lag("__moq", n).over(w), F.lit(0.0))})
    count = F.least(F.col("__mok"), F.lit(n))
    mean = F.col("__mos") / count
    var = F.greatest(F.col("__moq") / count - mean * mean, F.lit(0.0))
    # What cancellation leaves of a constant window is no spread.
    var = F.when(var > 1e-13 * (F.col("__moq") / count + 1e-300), var).otherwise(0.0)
    ready = F.lit(True) if partial else F.col("__mok") >= n
    df = df.withColumns({f"{prefix}_n": count, f"{prefix}_mean": F.when(ready, mean + F.col(x) - F.col("__mod")), f"{prefix}_var": F.when(ready, var)})
    return df.drop("__mod", "__mos", "__moq", "__mok")


def rolling_mean(df: DataFrame, x: str, n: int, out: str, keys=KEYS, order=ORDER, partial: bool = False) -> DataFrame:
    return moments(df, x, n, "__m", keys, order, partial).withColumnRenamed("__m_mean", out).drop("__m_var", "__m_n")
