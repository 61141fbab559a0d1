"""Schemas and checks of the rows that operators take, and helpers of trades and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: What must hold of a row, by kind.
RULES: dict[str, list[str]] = {
    "tick": ["ts_ns is not null", "values is null or forall(map_keys(values), k -> k >= 0)", "values is null or forall(map_values(values), v -> v is not null and not isnan(v) and abs(v) < double('inf'))"],
    "trade": ["ts_ns is not null", "price > 0 and price < double('inf')", "size >= 0 and size < double('inf')"],
    "bar": ["open > 0 and high > 0 and low > 0 and close > 0", "high >= low", "high >= greatest(open, close)", "low <= least(open, close)", "volume >= 0", "close_ns >= open_ns"],
}


def split_valid(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The rows that keep the rules, and the others."""
    ok = F.lit(True)
    for rule in RULES[kind]:
        ok = ok & F.coalesce(F.expr(rule), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def require(df: DataFrame, kind: str) -> DataFrame:
    """df, or an error on the first row that breaks a rule."""
    for rule in RULES[kind]:
        df = df.filter(F.when(F.coalesce(F.expr(rule), F.lit(False)), True).otherwise(F.raise_error(F.lit(f"{kind}: {rule}")).cast("boolean")))
    return df


def notional() -> Column:
    return C("price") * C("size")


def signed_size() -> Column:
    return C("size") * C("sign")


def sign_of(side: Column) -> Column:
    return F.when(side == "buy", 1.0).when(side == "sell", -1.0).otherwise(0.0)


def side_of(sign: Column) -> Column:
    return F.when(sign > 0, "buy").when(sign < 0, "sell").otherwise("unknown")


def typical_price() -> Column:
    return (C("high") + C("low") + C("close")) / 3


def weighted_close() -> Column:
    return (C("high") + C("low") + 2 * C("close")) / 4


def true_range(previous_close: Column) -> Column:
    return F.when(previous_close.isNull(), C("high") - C("low")).otherwise(F.greatest(C("high") - C("low"), F.abs(C("high") - previous_close), F.abs(C("low") - previous_close)))


def latency_ns() -> Column:
    return C("received_ns") - C("ts_ns")
