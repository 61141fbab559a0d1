"""All metrics by name: what they take, how they are called, and new ones beside them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import book
from tideline.operators import bars, cross, recurrent, rolling, trend_filters
from tideline.operators.recurrent import scan

#: The categories in the order in which they are listed.
CATEGORIES = ("price", "momentum", "trend", "volume", "liquidity", "volatility", "cross", "regime", "microstructure", "filtered")


@dataclass(frozen=True)
class Metric:
    """inputs: prices, trades, bars, books or instruments; outputs: the columns that it adds."""

    name: str
    category: str
    inputs: str
    outputs: tuple[str, ...]
    call: Callable[..., DataFrame]
    defaults: dict = field(default_factory=dict)

    def __call__(self, df: DataFrame, **parameters) -> DataFrame:
        unknown = set(parameters) - set(self.defaults)
        if unknown:
            raise ValueError(f"{self.name} has no {', '.join(sorted(unknown))}")
        return self.call(df, **(self.defaults | parameters))


METRICS: dict[str, Metric] = {}


def register(name: str, category: str, inputs: str, outputs: tuple[str, ...], call: Callable[..., DataFrame], **defaults) -> None:
    if category not in CATEGORIES:
        raise ValueError(f"no category {category}")
    METRICS[name] = Metric(name, category, inputs, outputs, call, defaults)


def build(config: dict) -> Callable[[DataFrame], DataFrame]:
    """{"type": name, parameters} as a function of a DataFrame."""
    config = dict(config)
    name = config.pop("type", None)
    if name not in METRICS:
        raise ValueError(f"no metric {name}")
    return lambda df: METRICS[name](df, **config)


def describe() -> list[dict]:
    """All metrics, by category as listed and name."""
    return [{"name": m.name, "category": m.category, "inputs": m.inputs, "outputs": list(m.outputs), "defaults": m.defaults} for m in sorted(METRICS.values(), key=lambda m: (CATEGORIES.index(m.category), m.name))]


def kernel(make: Callable, order=("ts_ns", "seq")) -> Callable[..., DataFrame]:
    return lambda df, **p: scan(df, lambda: make(**p), order=order)


def on_book(made: Callable[..., dict[str, Column]]) -> Callable[..., DataFrame]:
    return lambda df, **p: df.withColumns(made(F.col("bids"), F.col("asks"), **p))


def values_of(df: DataFrame, channels: dict[int, str]) -> DataFrame:
    """Metrics as readings of a filter: ``values`` maps channels to columns; undefined ones are left out, so a row without any is blind."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(x).cast("double").alias("value")) for c, x in channels.items()])
    return df.withColumn("values", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))


BAR = ("open_ns",)
register("normalized-price", "price", "prices", ("z", "ratio", "log_ratio"), rolling.normalized_price, period=120)
register("price-delta", "price", "prices", ("log_return", "simple_return"), rolling.price_delta, lag=1)
register("mean-price-difference", "price", "prices", ("difference", "overlap"), rolling.mean_price_difference, smooth=30, lag=15, level=120)
register("rsi", "momentum", "prices", ("rsi", "avg_gain", "avg_loss"), kernel(recurrent.Rsi), period=14, lag=1, kind="rma")
register("rsi-timed", "momentum", "prices", ("rsi", "avg_gain", "avg_loss"), kernel(recurrent.TimedRsi), tau=60.0)
register("stochastic", "momentum", "bars", ("percent_k", "percent_d"), rolling.stochastic, k=14, smooth=1, d=3)
register("cci", "momentum", "bars", ("cci", "typical", "mad"), rolling.cci, period=20, constant=0.015)
register("normalized-momentum", "momentum", "prices", ("napm", "block_mean", "block_sd"), rolling.block_momentum, step=60, count=8)
register("sma", "trend", "prices", ("sma",), rolling.sma, period=20)
register("wma", "trend", "prices", ("wma",), rolling.wma, period=20)
register("ema", "trend", "prices", ("ema",), kernel(lambda period: recurrent.MovingAverage("ema", period)), period=20)
register("rma", "trend", "prices", ("rma",), kernel(lambda period: recurrent.MovingAverage("rma", period)), period=20)
register("ema-timed", "trend", "prices", ("ema_timed",), kernel(recurrent.TimedEma), tau=60.0)
register("macd", "trend", "prices", recurrent.Macd.outputs, kernel(recurrent.Macd), fast=12, slow=26, signal=9, kind="ema")
register("macd-timed", "trend", "prices", recurrent.TimedMacd.outputs, kernel(recurrent.TimedMacd), fast=12.0, slow=26.0, signal=9.0)
register("ma-spread", "trend", "prices", ("spread", "relative", "fast", "slow"), rolling.ma_spread, fast=120, slow=2880)
register("ma-spread-recurrent", "trend", "prices", recurrent.MaSpread.outputs, kernel(recurrent.MaSpread), fast=120, slow=2880, kind="ema")
register("adx", "trend", "bars", recurrent.Adx.outputs, kernel(recurrent.Adx, BAR), period=14)
register("volume-profile", "volume", "trades", ("volume", "volume_z", "normalized", "buy_volume", "sell_volume", "delta", "imbalance", "notional"), rolling.volume_profile, window=100, reference=2000)
register("vwap", "volume", "trades", ("vwap", "sigma", "upper", "lower", "deviation", "vwap_z"), rolling.vwap, window=0, band=2.0)
register("order-book-imbalance", "liquidity", "books", ("imbalance", "ratio", "log_ratio"), on_book(book.imbalance), n=5, decay_bps=0.0)
register("liquidity-density", "liquidity", "books", ("density", "density_share", "density_notional"), on_book(book.density), band=10.0, kernel="rectangular")
register("weighted-prices", "liquidity", "books", ("bid_price", "ask_price", "weighted_mid", "mid", "tilt"), on_book(book.weighted_prices), n=5)
register("spread", "liquidity", "books", ("quoted", "relative_bps"), on_book(lambda b, a: {"quoted": book.spread(b, a), "relative_bps": book.relative_spread_bps(b, a)}))
register("book-slope", "liquidity", "books", ("bid_slope", "ask_slope", "slope", "slope_asymmetry"), on_book(book.slope), n=20)
register("cost-to-trade", "liquidity", "books", ("buy_bps", "sell_bps", "round_trip_bps"), on_book(book.cost_to_trade), notional=10_000.0)
register("range-volatility", "volatility", "prices", ("range", "range_sigma"), rolling.range_volatility, period=120, smoothing=1)
register("ohlc-volatility", "volatility", "bars", ("sigma",), rolling.ohlc_volatility, period=20, estimator="yang_zhang")
register("atr", "volatility", "bars", recurrent.Atr.outputs, kernel(recurrent.Atr, BAR), period=14)
register("realized-volatility", "volatility", "prices", ("realized",), rolling.realized_volatility, window=60)
register("ewma-volatility", "volatility", "prices", ("ewma_volatility",), kernel(recurrent.EwmaVolatility), decay=0.94)
register("basket-return", "cross", "instruments", ("basket", "dispersion"), cross.basket_return, constituents=(), weighting="equal", window=60)
register("relative-strength", "cross", "instruments", ("excess", "beta", "beta_adjusted"), cross.relative_strength, asset="", constituents=(), beta_window=60, weighting="equal", window=60)
register("market-strength", "cross", "instruments", ("breadth", "momentum", "msi"), cross.market_strength, constituents=(), window=60, blend=0.5, weighting="volume")
register("flat-market", "regime", "prices", ("efficiency", "band_width", "displacement", "path_length"), rolling.flat_market, window=60, k=2.0)
register("order-flow-imbalance", "microstructure", "books", ("event", "ofi", "implied_move"), rolling.order_flow_imbalance, window=50)
register("vpin", "microstructure", "trades", ("vpin",), bars.vpin_of_trades, bucket_size=1000.0, buckets=50)
register("price-impact", "microstructure", "trades", ("lambda", "depth", "amihud"), rolling.price_impact, window=500)
register("trade-classifier", "microstructure", "trades", ("classified", "mean_sign", "quote_share"), rolling.trade_classifier, use_quotes=True, window=100)
register("bulk-volume", "microstructure", "trades", ("buy_share",), rolling.bulk_volume, window=50)
register("filtered-derivative", "filtered", "prices", trend_filters.FilteredDerivative.outputs, kernel(trend_filters.FilteredDerivative), tracking=0.01, noise=None, calibration=50)
