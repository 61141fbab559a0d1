"""Metrics over windows of observations. Each takes rows of a series and adds its outputs; undefined ones are NULL.

Prices: (symbol, ts_ns, seq, price). Trades: also size and sign (+1, -1, 0). Bars: (symbol, open_ns, open, high, low, close,
volume). Windows count observations.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.side_by_side import blockwise_sums
from tideline.plans.frames import KEYS, ORDER, full, last, ln, log_of, moments, ordered, positive, ratio, rolling_mean, running

BAR_ORDER = ("open_ns",)
C = F.col


# ---- price


def normalized_price(df: DataFrame, period: int = 120) -> DataFrame:
    """z, ratio and log of the price against its mean and population deviation."""
    df = moments(df, "price", period, "__p")
    sd = F.sqrt("__p_var")
    out = {"z": positive(sd, (C("price") - C("__p_mean")) / F.when(sd > 0, sd)), "ratio": ratio(C("price"), C("__p_mean")), "log_ratio": F.when(C("price") > 0, ln(ratio(C("price"), C("__p_mean"))))}
    return df.withColumns(out).drop("__p_mean", "__p_var", "__p_n")


def price_delta(df: DataFrame, lag: int = 1) -> DataFrame:
    before = F.lag("price", lag).over(ordered())
    ok = (before > 0) & (C("price") > 0)
    change = ratio(C("price"), before)
    return df.withColumns({"log_return": F.when(ok, ln(change)), "simple_return": F.when(ok, change - 1)})


def mean_price_difference(df: DataFrame, smooth: int = 30, lag: int = 15, level: int = 120) -> DataFrame:
    df = rolling_mean(rolling_mean(df, "price", smooth, "__s"), "price", level, "__l")
    out = ratio(C("__s") - F.lag("__s", lag).over(ordered()), C("__l"))
    return df.withColumns({"difference": out, "overlap": F.lit(max(0.0, (smooth - lag) / smooth))}).drop("__s", "__l")


# ---- momentum


def rsi_sma(df: DataFrame, period: int = 14, lag: int = 1) -> DataFrame:
    """Relative strength by rolling means of gains and losses; 50 where nothing moved."""
    df = df.withColumn("__c", C("price") - F.lag("price", lag).over(ordered()))
    w = last(period)
    gain, loss = (full(C("__c"), F.avg(F.greatest(x, F.lit(0.0))).over(w), period, w) for x in (C("__c"), -C("__c")))
    df = df.withColumns({"avg_gain": gain, "avg_loss": loss})
    both = C("avg_gain") + C("avg_loss")
    return df.withColumn("rsi", F.when(both.isNull(), None).when(both > 0, 100 * C("avg_gain") / F.when(both > 0, both)).otherwise(50.0)).drop("__c")


def stochastic(bars: DataFrame, k: int = 14, smooth: int = 1, d: int = 3) -> DataFrame:
    """percent_k and percent_d; 50 where the range is nil."""
    w = last(k, order=BAR_ORDER)
    low, high = F.min("low").over(w), F.max("high").over(w)
    span = high - low
    raw = F.when(F.count("close").over(w) == k, F.when(span > 0, 100 * (C("close") - low) / F.when(span > 0, span)).otherwise(50.0))
    bars = bars.withColumn("percent_k", raw)
    for name, source, n in (("percent_k", "percent_k", smooth), ("percent_d", "percent_k", d)):
        own = last(n, order=BAR_ORDER)
        bars = bars.withColumn(name, full(C(source), F.avg(source).over(own), n, own))
    return bars


def cci(bars: DataFrame, period: int = 20, constant: float = 0.015) -> DataFrame:
    """Typical price against its mean in mean absolute deviations; 0 where there is none."""
    w = last(period, order=BAR_ORDER)
    bars = bars.withColumn("typical", (C("high") + C("low") + C("close")) / 3)
    bars = bars.withColumns({"__w": F.collect_list("typical").over(w), "__m": F.avg("typical").over(w)})
    spread = F.aggregate("__w", F.lit(0.0), lambda a, x: a + F.abs(x - C("__m"))) / period
    bars = bars.withColumn("mad", F.when(F.size("__w") == period, spread))
    value = F.when(C("mad") > 0, (C("typical") - C("__m")) / (constant * F.when(C("mad") > 0, C("mad")))).when(C("mad").isNotNull(), 0.0)
    return bars.withColumn("cci", value).drop("__w", "__m")


def block_momentum(df: DataFrame, step: int = 60, count: int = 8) -> DataFrame:
    """Mean over sample deviation of the log returns of ``count`` blocks that end here. A price of nil has an infinite return."""
    w = ordered()
    prices = [C("price")] + [F.lag("price", step * k).over(w) for k in range(1, count + 1)]
    df = df.withColumn("__p", F.array(*prices))
    ok = F.forall("__p", lambda p: p.isNotNull() & (p >= 0))
    returns = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: log_of(F.get("__p", k), F.get("__p", k + 1)))
    df = df.withColumn("__r", F.when(ok, returns))
    mean = F.aggregate("__r", F.lit(0.0), lambda a, x: a + x) / count
    df = df.withColumn("block_mean", mean)
    df = df.withColumn("block_sd", F.sqrt(F.aggregate("__r", F.lit(0.0), lambda a, x: a + (x - C("block_mean")) * (x - C("block_mean"))) / (count - 1)))
    return df.withColumn("napm", positive(C("block_sd"), C("block_mean") / F.when(C("block_sd") > 0, C("block_sd")))).drop("__p", "__r")


# ---- trend


def sma(df: DataFrame, period: int = 20, x: str = "price", out: str = "sma") -> DataFrame:
    return rolling_mean(df, x, period, out)


def wma(df: DataFrame, period: int = 20, x: str = "price", out: str = "wma") -> DataFrame:
    """Weights 1 to n, the last the heaviest: a running sum of k x_k less what the rows before the frame hold."""
    w, r = ordered(), running()
    df = df.withColumns({"__k": F.row_number().over(w).cast("double"), "__d": C(x) - F.first(x).over(r)})
    df = df.withColumns({"__s": F.sum("__d").over(r), "__t": F.sum(C("__d") * C("__k")).over(r)})
    s = C("__s") - F.coalesce(F.lag("__s", period).over(w), F.lit(0.0))
    t = C("__t") - F.coalesce(F.lag("__t", period).over(w), F.lit(0.0))
    value = (t - (C("__k") - period) * s) / (period * (period + 1) / 2)
    return df.withColumn(out, F.when(C("__k") >= period, value + C(x) - C("__d"))).drop("__k", "__d", "__s", "__t")


def ma_spread(df: DataFrame, fast: int = 120, slow: int = 2880, average=sma) -> DataFrame:
    """Fast less slow average, and in shares of the slow one; any average with a period."""
    if not fast < slow:
        raise ValueError("fast must be shorter than slow")
    df = average(average(df, fast, "price", "fast"), slow, "price", "slow")
    return df.withColumns({"spread": C("fast") - C("slow"), "relative": ratio(C("fast") - C("slow"), C("slow"))})


# ---- volume


def volume_profile(df: DataFrame, window: int = 100, reference: int = 2000) -> DataFrame:
    if reference < window:
        raise ValueError("reference must not be shorter than window")
    df = df.withColumns({"__buy": F.when(C("sign") > 0, C("size")).otherwise(0.0), "__not": C("price") * C("size")})
    for x, out in (("size", "__v"), ("__buy", "__b"), ("__not", "__n")):
        df = moments(df, x, window, out, partial=True)
    df = moments(df, "size", reference, "__r")
    volume, buy, expected = C("__v_mean") * C("__v_n"), C("__b_mean") * C("__b_n"), window * C("__r_mean")
    sd = F.sqrt("__r_var")
    df = df.withColumns({"volume": volume, "buy_volume": buy, "notional": C("__n_mean") * C("__n_n"), "volume_z": positive(sd, (volume - expected) / (sqrt(window) * F.when(sd > 0, sd))), "normalized": ratio(volume, expected)})
    df = df.withColumns({"sell_volume": C("volume") - C("buy_volume"), "delta": 2 * C("buy_volume") - C("volume")})
    return df.withColumn("imbalance", ratio(C("delta"), C("volume"))).drop(*[c for c in df.columns if c.startswith("__")])


def vwap(df: DataFrame, window: int = 0, band: float = 2.0, session: tuple[str, ...] = ()) -> DataFrame:
    """Volume-weighted price since the session's start, or over the last ``window`` trades of positive size, with bands."""
    df = df.withColumn("__v", F.when(C("size") > 0, C("size")).otherwise(0.0))
    keys = (*KEYS, *session)
    if window:
        df = df.withColumn("__i", F.sum(F.when(C("__v") > 0, 1).otherwise(0)).over(running(keys)))
        w = Window.partitionBy(*keys).orderBy("__i").rangeBetween(1 - window, 0)
    else:
        w = running(keys)
    anchor = F.first("price").over(running(keys))
    df = df.withColumn("__a", anchor).withColumn("__d", C("price") - C("__a"))
    # Squares are taken around the partition's first price.
    sums = {"__sv": F.sum("__v").over(w), "__sp": F.sum(C("__d") * C("__v")).over(w), "__sq": F.sum(C("__d") * C("__d") * C("__v")).over(w)}
    if window:
        first = F.min("__a").over(Window.partitionBy(*keys))
        sums = {"__sv": sums["__sv"], "__sp": F.sum((C("price") - C("__f")) * C("__v")).over(w), "__sq": F.sum((C("price") - C("__f")) * (C("price") - C("__f")) * C("__v")).over(w)}
        df = df.withColumn("__f", first)
    else:
        df = df.withColumn("__f", C("__a"))
    df = df.withColumns(sums)
    mean = ratio(C("__sp"), C("__sv"))
    df = df.withColumn("vwap", C("__f") + mean).withColumn("sigma", F.sqrt(F.greatest(ratio(C("__sq"), C("__sv")) - mean * mean, F.lit(0.0))))
    df = df.withColumns({"upper": C("vwap") + band * C("sigma"), "lower": C("vwap") - band * C("sigma"), "deviation": ratio(C("price") - C("vwap"), C("vwap")), "vwap_z": F.when(C("sigma") > 0, (C("price") - C("vwap")) / F.when(C("sigma") > 0, C("sigma")))})
    return df.drop(*[c for c in df.columns if c.startswith("__")])


# ---- volatility

RANGE_SCALE = 2 * sqrt(log(2))


def range_volatility(df: DataFrame, period: int = 120, smoothing: int = 1) -> DataFrame:
    df = rolling_mean(df, "price", smoothing, "__x") if smoothing > 1 else df.withColumn("__x", C("price"))
    w = last(period)
    mean = F.avg("__x").over(w)
    df = df.withColumn("range", full(C("__x"), ratio(F.max("__x").over(w) - F.min("__x").over(w), mean), period, w))
    return df.withColumn("range_sigma", C("range") / RANGE_SCALE).drop("__x")


EFFICIENCY = {"close_to_close": 1.0, "parkinson": 5.2, "garman_klass": 7.4, "rogers_satchell": 8.0, "yang_zhang": 14.0}


def ohlc_volatility(bars: DataFrame, period: int = 20, estimator: str = "yang_zhang", per_year: float | None = None) -> DataFrame:
    """sigma of bars by one of EFFICIENCY's estimators, and per year if the bars per year are given. A price of nil leaves it without bounds: NaN."""
    w, n = last(period, order=BAR_ORDER), period
    known = C("open").isNotNull() & C("high").isNotNull() & C("low").isNotNull() & C("close").isNotNull()
    per = lambda a, b: F.when(known & (C(a) >= 0) & (C(b) >= 0), log_of(C(a), C(b)))
    before = F.lag("close").over(ordered(order=BAR_ORDER))
    wide, gone = per("high", "low"), per("close", "open")
    terms = {"parkinson": wide * wide / (4 * log(2)), "garman_klass": 0.5 * wide * wide - (2 * log(2) - 1) * gone * gone, "rogers_satchell": per("high", "close") * per("high", "open") + per("low", "close") * per("low", "open")}
    if estimator in terms:
        bars = bars.withColumn("__t", terms[estimator])
        var = full(C("__t"), F.avg("__t").over(w), n, w)
    elif estimator == "close_to_close":
        bars = bars.withColumn("__t", F.when((before >= 0) & (C("close") >= 0), log_of(C("close"), before)))
        var = full(C("__t"), F.var_samp("__t").over(w), n, w)
    elif estimator == "yang_zhang":
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        bars = bars.withColumns({"__t": F.when(before.isNull(), 0.0).when((before >= 0) & (C("open") >= 0), log_of(C("open"), before)), "__c": gone, "__r": terms["rogers_satchell"]})
        parts = F.when(C("__t").isNotNull() & C("__c").isNotNull(), C("__r"))
        var = full(parts, F.var_samp("__t").over(w) + k * F.var_samp("__c").over(w) + (1 - k) * F.avg("__r").over(w), n, w)
    else:
        raise ValueError(f"no estimator {estimator}")
    bars = bars.withColumn("sigma", F.sqrt(F.greatest(var, F.lit(0.0)) + 0 * var)).drop("__t", "__c", "__r")
    return bars if per_year is None else bars.withColumn("annualised", C("sigma") * sqrt(per_year))


def realized_volatility(df: DataFrame, window: int = 60) -> DataFrame:
    """Root mean square of log returns. A price of nil has an infinite return."""
    before = F.lag("price").over(ordered())
    r = F.when((C("price") >= 0) & (before >= 0), log_of(C("price"), before))
    df = df.withColumn("log_return", r).withColumn("__s", C("log_return") * C("log_return"))
    w = last(window)
    return df.withColumn("realized", F.sqrt(full(C("__s"), F.avg("__s").over(w), window, w))).drop("__s")


# ---- regime


def flat_market(df: DataFrame, window: int = 60, k: float = 2.0) -> DataFrame:
    w = ordered()
    df = df.withColumn("__c", F.abs(C("price") - F.lag("price").over(w)))
    own = last(window)
    df = df.withColumns({"displacement": F.abs(C("price") - F.lag("price", window).over(w)), "path_length": full(C("__c"), F.sum("__c").over(own), window, own)})
    df = moments(df, "price", window, "__p")
    value = F.when(C("path_length") > 0, C("displacement") / F.when(C("path_length") > 0, C("path_length"))).when(C("path_length").isNotNull(), 0.0)
    return df.withColumns({"efficiency": value, "band_width": ratio(2 * k * F.sqrt("__p_var"), C("__p_mean"))}).drop("__c", "__p_mean", "__p_var", "__p_n")


# ---- microstructure


def order_flow_imbalance(quotes: DataFrame, window: int = 50) -> DataFrame:
    """quotes: bid, bid_size, ask, ask_size; rows without both sides are left out first."""
    w, own = ordered(), last(window)
    pb, qb, pa, qa = (F.lag(c).over(w) for c in ("bid", "bid_size", "ask", "ask_size"))
    quotes = quotes.filter("bid is not null and ask is not null")
    event = F.when(C("bid") >= pb, C("bid_size")).otherwise(0.0) - F.when(C("bid") <= pb, qb).otherwise(0.0) - F.when(C("ask") <= pa, C("ask_size")).otherwise(0.0) + F.when(C("ask") >= pa, qa).otherwise(0.0)
    quotes = quotes.withColumns({"event": F.when(pb.isNotNull(), event), "__d": F.when(pb.isNotNull(), (C("bid_size") + C("ask_size")) / 2)})
    quotes = quotes.withColumn("ofi", full(C("event"), F.sum("event").over(own), window, own))
    return quotes.withColumn("implied_move", F.when(C("ofi").isNotNull(), ratio(C("ofi"), 2 * F.avg("__d").over(own)))).drop("__d")


def price_impact(df: DataFrame, window: int = 500) -> DataFrame:
    """Kyle's lambda through the origin, its inverse, and Amihud's measure over the last prints that moved money."""
    w = ordered()
    df = df.withColumns({"__q": C("size") * C("sign"), "__c": C("price") - F.lag("price").over(w)})
    df = df.withColumns({"__qc": C("__q") * C("__c"), "__qq": F.when(C("__c").isNotNull(), C("__q") * C("__q"))})
    df = df.withColumn("__first", F.row_number().over(w) == 1)
    df = blockwise_sums(df, "__qc", window, "__x")
    rest = df.filter(~C("__first"))
    # Sums of each frame by itself: lambda may be small against its terms, so differences of running sums tell too little of 1 / lambda.
    own = last(window)
    rest = rest.withColumns({"__x": full(C("__qc"), C("__x"), window, own), "__y": F.sum("__qq").over(own)})
    rest = rest.withColumn("lambda", ratio(C("__x"), C("__y")))
    worth = F.abs("__q") * C("price")
    rest = rest.withColumn("__a", F.when((worth > 0) & (C("price") > 0), F.abs(C("__c") / F.when(C("price") > 0, C("price"))) / F.when(worth > 0, worth)))
    rest = rest.withColumn("__i", F.count("__a").over(running()))
    prints = Window.partitionBy(*KEYS).orderBy("__i").rangeBetween(1 - window, 0)
    rest = rest.withColumns({"depth": F.when(C("lambda") > 0, 1 / F.when(C("lambda") > 0, C("lambda"))), "amihud": F.avg("__a").over(prints)})
    out = rest.unionByName(df.filter("__first"), allowMissingColumns=True)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def trade_classifier(df: DataFrame, use_quotes: bool = True, window: int = 100) -> DataFrame:
    """The side of each trade: against the mid if there is one, else the last change of price; unchanged prices inherit."""
    change = C("price") - F.lag("price").over(ordered())
    sign = lambda x: F.when(x > 0, 1.0).when(x < 0, -1.0)
    quote = sign(C("price") - C("mid")) if use_quotes else F.lit(None).cast("double")
    df = df.withColumn("__quote", quote).withColumn("__own", F.coalesce(C("__quote"), sign(change)))
    df = df.withColumn("classified", F.coalesce(F.last("__own", ignorenulls=True).over(running()), F.lit(0.0)))
    w = last(window)
    return df.withColumns({"mean_sign": F.avg("classified").over(w), "quote_share": F.avg(F.when(C("__quote").isNotNull(), 1.0).otherwise(0.0)).over(w)}).drop("__quote", "__own")


def bulk_volume(df: DataFrame, window: int = 50) -> DataFrame:
    """The buy share of a trade's volume by the logistic of its price change in sample deviations."""
    df = df.withColumn("__c", C("price") - F.lag("price").over(ordered()))
    w = last(window)
    sd = F.when(F.count("__c").over(w) > 1, F.stddev_samp("__c").over(w))
    return df.withColumn("buy_share", F.when(sd > 0, 1 / (1 + F.exp(-1.702 * C("__c") / F.when(sd > 0, sd))))).drop("__c")


def effective_spread(df: DataFrame, horizon: int = 1) -> DataFrame:
    """Trades with mid: twice the distance from it, and what is left of it against the mid ``horizon`` trades on."""
    return df.withColumns({"effective": 2 * F.abs(C("price") - C("mid")), "realized_spread": 2 * C("sign") * (C("price") - F.lead("mid", horizon).over(ordered()))})


def roll_spread(df: DataFrame) -> DataFrame:
    """Roll's estimate of each symbol: twice the root of the negative covariance of neighbouring changes; NULL if positive or of fewer than 3 prices."""
    w = ordered()
    steps = df.withColumn("c", C("price") - F.lag("price").over(w)).withColumn("d", F.lag("c").over(w))
    sums = steps.groupBy(*KEYS).agg(F.count("c").alias("m"), F.avg("c").alias("mu"), F.sum(C("c") * C("d")).alias("cd"), F.sum(F.when(C("d").isNotNull(), C("c") + C("d"))).alias("s"), F.count("d").alias("k"))
    covariance = (C("cd") - C("mu") * C("s") + C("k") * C("mu") * C("mu")) / F.when(C("m") > 1, C("m") - 1)
    return sums.select(*KEYS, F.when(covariance < 0, 2 * F.sqrt(F.abs(covariance))).alias("roll"))


def as_of_mid(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """trades with the mid of the last quote of the symbol at or before each trade: one union, one sort."""
    rows = trades.withColumns({"mid": F.lit(None).cast("double"), "__k": F.lit(1)}).unionByName(quotes.select("symbol", "ts_ns", F.lit(None).cast("long").alias("seq"), "mid", F.lit(0).alias("__k")), allowMissingColumns=True)
    w = Window.partitionBy(*KEYS).orderBy("ts_ns", "__k", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mid", F.last("mid", ignorenulls=True).over(w)).filter("__k = 1").drop("__k")


def rolling_beta(df: DataFrame, window: int, y: str, x: str, out: str, keys=KEYS, order=ORDER) -> DataFrame:
    """Slope with intercept of y on x over the last joint readings; NULL until full or without variance."""
    w = last(window, keys, order)
    both: Column = F.when(C(x).isNotNull() & C(y).isNotNull(), C(x))
    return df.withColumn(out, F.when((F.count(both).over(w) == window) & (F.var_pop(both).over(w) > 0), F.regr_slope(y, x).over(w)))
