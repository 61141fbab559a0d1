"""Registered queries of the engine's own operators, and their SQL.

Values are rounded to six places on both sides, after a shift that takes short decimals off the ties."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import book
from tideline.operators import bars as clocks
from tideline.operators import calibration, cross, diagnostics, filters, models, recurrent, rolling, smoothing, trend_filters
from tideline.operators.recurrent import scan
from tideline.operators.side_by_side import ManyModels, UnscentedFilters, filter_long, scan_prices
from tideline.plans import views
from tideline.plans.frames import ln, ratio
from tideline.plans.views import BARS, DAILY, LEVELS, TICKS, TRADES, USERS
from tideline.sources import codecs

C = F.col
BAR_ORDER = ("open_ns",)
TYPES = ["click", "error", "purchase", "signup", "view"]
ROW = ("symbol", "ts_ns", "seq")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


SHIFT = 1.7e-8


def out(df: DataFrame, keys, cols, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(C(c).cast("double") + SHIFT, digits).alias(c) for c in cols])


def sql(with_: str, source: str, keys, cols: dict[str, str], recursive: bool = False, digits: int = 6) -> str:
    told = ", ".join([*keys, *[f"round(({e})::DOUBLE + {SHIFT}::DOUBLE, {digits}) + 0.0 AS {n}" for n, e in cols.items()]])
    return f"WITH {'RECURSIVE ' if recursive else ''}{with_} SELECT {told} FROM {source}"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def over(n: int | None = None, order: str = "ts_ns, seq", by: str = "symbol") -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if n else " ROWS UNBOUNDED PRECEDING"
    return f"OVER (PARTITION BY {by} ORDER BY {order}{frame})"


def mean_sql(x: str, n: int, order: str = "ts_ns, seq") -> str:
    return f"CASE WHEN count({x}) {over(n, order)} = {n} THEN avg({x}) {over(n, order)} END"


def log_sql(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln(CASE WHEN {x} > 0 THEN {x} END) END"


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END"


# ---- price


def _normalized(n: int) -> str:
    s = f"{TICKS}, m AS (SELECT *, {mean_sql('price', n)} AS mu, CASE WHEN count(price) {over(n)} = {n} THEN stddev_pop(price) {over(n)} END AS sd FROM ticks)"
    return sql(s, "m", ROW, {"z": div("price - mu", "sd"), "ratio": div("price", "mu"), "log_ratio": log_sql(f"({div('price', 'mu')})")})


for name, n in (("normalized_z", 20), ("normalized_z_long", 200)):
    add(name, lambda s, d, n=n: out(rolling.normalized_price(views.ticks(s, d), n), ROW, ("z", "ratio", "log_ratio")), _normalized(n))
add(
    "price_delta", lambda s, d: out(rolling.price_delta(views.ticks(s, d), 3), ROW, ("log_return", "simple_return")),
    sql(f"{TICKS}, m AS (SELECT *, lag(price, 3) {over()} AS p0 FROM ticks)", "m", ROW, {"log_return": "CASE WHEN price > 0 AND p0 > 0 THEN ln(price / p0) END", "simple_return": "CASE WHEN price > 0 AND p0 > 0 THEN price / p0 - 1 END"}),
)
add(
    "mean_price_difference", lambda s, d: out(rolling.mean_price_difference(views.ticks(s, d), 10, 5, 40), ROW, ("difference", "overlap")),
    sql(f"{TICKS}, m AS (SELECT *, {mean_sql('price', 10)} AS a, {mean_sql('price', 40)} AS b FROM ticks), k AS (SELECT *, lag(a, 5) {over()} AS a0 FROM m)", "k", ROW, {"difference": div("a - a0", "b"), "overlap": "0.5"}),
)

# ---- momentum

CHANGES = f"{TICKS}, c AS (SELECT *, price - lag(price) {over()} AS ch FROM ticks)"
LAGGED = f"{TICKS}, c AS (SELECT *, price - lag(price, 5) {over()} AS ch FROM ticks)"
add(
    "rsi_lagged", lambda s, d: out(rolling.rsi_sma(views.ticks(s, d), 14, 5), ROW, ("rsi", "avg_gain", "avg_loss")),
    sql(f"{LAGGED}, m AS (SELECT *, {mean_sql('greatest(ch, 0) + 0 * ch', 14)} AS g, {mean_sql('greatest(-ch, 0) + 0 * ch', 14)} AS l FROM c)", "m", ROW, {"rsi": "CASE WHEN g + l > 0 THEN 100 * g / (g + l) WHEN g IS NOT NULL THEN 50 END", "avg_gain": "g", "avg_loss": "l"}),
)
add(
    "rsi_sma", lambda s, d: out(rolling.rsi_sma(views.ticks(s, d), 14), ROW, ("rsi", "avg_gain", "avg_loss")),
    sql(f"{CHANGES}, m AS (SELECT *, {mean_sql('greatest(ch, 0) + 0 * ch', 14)} AS g, {mean_sql('greatest(-ch, 0) + 0 * ch', 14)} AS l FROM c)", "m", ROW, {"rsi": "CASE WHEN g + l > 0 THEN 100 * g / (g + l) WHEN g IS NOT NULL THEN 50 END", "avg_gain": "g", "avg_loss": "l"}),
)
BO = "open_ns"
STOCH = f"{BARS}, m AS (SELECT *, min(low) {over(14, BO)} AS ll, max(high) {over(14, BO)} AS hh, count(*) {over(14, BO)} AS n FROM bars), r AS (SELECT *, CASE WHEN n = 14 THEN CASE WHEN hh > ll THEN 100 * (close - ll) / (hh - ll) ELSE 50 END END AS raw FROM m), k AS (SELECT *, {mean_sql('raw', 3, BO)} AS pk FROM r), f AS (SELECT *, {mean_sql('pk', 3, BO)} AS pd FROM k)"
add("stochastic", lambda s, d: out(rolling.stochastic(views.bars(s, d), 14, 3, 3), ("symbol", "bucket"), ("percent_k", "percent_d")), sql(STOCH, "f", ("symbol", "bucket"), {"percent_k": "pk", "percent_d": "pd"}))
CCI = f"{BARS}, t AS (SELECT *, (high + low + close) / 3 AS tp, row_number() {over(None, BO)} AS rn FROM bars), m AS (SELECT *, avg(tp) {over(20, BO)} AS mu FROM t), d AS (SELECT a.symbol, a.bucket, a.tp, a.mu, count(*) AS n, avg(abs(b.tp - a.mu)) AS md FROM m a JOIN m b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY ALL)"
add("cci", lambda s, d: out(rolling.cci(views.bars(s, d), 20), ("symbol", "bucket"), ("cci", "mad", "typical")), sql(CCI, "d", ("symbol", "bucket"), {"cci": "CASE WHEN n = 20 THEN CASE WHEN md > 0 THEN (tp - mu) / (0.015::DOUBLE * md) ELSE 0 END END", "mad": "CASE WHEN n = 20 THEN md END", "typical": "tp"}))
BLOCK = f"{TICKS}, p AS (SELECT *, {', '.join(f'ln(lag(price, {5 * k}) {over()} / lag(price, {5 * k + 5}) {over()}) AS r{k}' for k in range(6))} FROM ticks), m AS (SELECT *, ({' + '.join(f'r{k}' for k in range(6))}) / 6 AS mu FROM p), v AS (SELECT *, sqrt(({' + '.join(f'(r{k} - mu) * (r{k} - mu)' for k in range(6))}) / 5) AS sd FROM m)"
add("block_momentum", lambda s, d: out(rolling.block_momentum(views.ticks(s, d), 5, 6), ROW, ("napm", "block_mean", "block_sd")), sql(BLOCK, "v", ROW, {"napm": div("mu", "sd"), "block_mean": "mu", "block_sd": "sd"}))

# ---- trend

for name, n in (("sma", 20), ("sma_long", 200)):
    add(name, lambda s, d, n=n: out(rolling.sma(views.ticks(s, d), n), ROW, ("sma",)), sql(f"{TICKS}, m AS (SELECT *, {mean_sql('price', n)} AS a FROM ticks)", "m", ROW, {"sma": "a"}))
WMA = f"{TICKS}, m AS (SELECT *, {', '.join(f'lag(price, {k}) {over()} AS p{k}' for k in range(10))} FROM ticks)"
add("wma", lambda s, d: out(rolling.wma(views.ticks(s, d), 10), ROW, ("wma",)), sql(WMA, "m", ROW, {"wma": f"({' + '.join(f'{10 - k} * p{k}' for k in range(10))}) / 55"}))
add("ma_spread", lambda s, d: out(rolling.ma_spread(views.ticks(s, d), 10, 60), ROW, ("spread", "relative")), sql(f"{TICKS}, m AS (SELECT *, {mean_sql('price', 10)} AS a, {mean_sql('price', 60)} AS b FROM ticks)", "m", ROW, {"spread": "a - b", "relative": div("a - b", "b")}))


def seeded(source: str, x: str, n: int, alpha: float, name: str) -> str:
    """CTEs: the average of x that starts at the mean of its first n readings, as {name}_r (symbol, rn, v). source has symbol and rn."""
    return f"""{name}_b AS (SELECT symbol, rn, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k, avg({x}) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m FROM {source} WHERE {x} IS NOT NULL),
{name}_r AS (SELECT symbol, rn, k, m AS v FROM {name}_b WHERE k = {n} UNION ALL SELECT b.symbol, b.rn, b.k, r.v + {alpha!r}::DOUBLE * (b.x - r.v) FROM {name}_r r JOIN {name}_b b ON b.symbol = r.symbol AND b.k = r.k + 1)"""


def joined(base: str, *names: str) -> str:
    return f"{base} t " + " ".join(f"LEFT JOIN {n}_r {n} ON {n}.symbol = t.symbol AND {n}.rn = t.rn" for n in names)


TROW = ("t.symbol", "t.ts_ns", "t.seq")
for kind, alpha in (("ema", 2 / 11), ("rma", 1 / 10)):
    add(kind, lambda s, d, k=kind: out(scan(views.user_ticks(s, d), lambda: recurrent.MovingAverage(k, 10)), ROW, (k,)), sql(f"{USERS}, {seeded('users', 'price', 10, alpha, 'a')}", joined("users", "a"), TROW, {kind: "a.v"}, True))
TIMED_CTE = """{n}_r AS (SELECT symbol, rn, ts_ns, {x} AS v, 0.0::DOUBLE AS el FROM {src} WHERE rn = {first}
UNION ALL SELECT t.symbol, t.rn, t.ts_ns, CASE WHEN t.ts_ns > r.ts_ns THEN r.v + (1 - exp(-((t.ts_ns - r.ts_ns) / 1e9) / {tau})) * (t.{x} - r.v) ELSE r.v END, r.el + greatest((t.ts_ns - r.ts_ns) / 1e9, 0) FROM {n}_r r JOIN {src} t ON t.symbol = r.symbol AND t.rn = r.rn + 1)"""
DAY = 86_400.0
timed = lambda n, tau: TIMED_CTE.format(n=n, x="price", src="users", first=1, tau=tau)
add("ema_timed", lambda s, d: out(scan(views.user_ticks(s, d), lambda: recurrent.TimedEma(DAY)), ROW, ("ema_timed",)), sql(f"{USERS}, {timed('a', DAY)}", joined("users", "a"), TROW, {"ema_timed": f"CASE WHEN a.el >= {DAY} THEN a.v END"}, True))
MACD = f"{USERS}, {seeded('users', 'price', 5, 2 / 6, 'f')}, {seeded('users', 'price', 10, 2 / 11, 'w')}, line AS (SELECT f.symbol, f.rn, f.v - w.v AS line FROM f_r f JOIN w_r w ON f.symbol = w.symbol AND f.rn = w.rn), {seeded('line', 'line', 4, 2 / 5, 'g')}"
add("macd", lambda s, d: out(scan(views.user_ticks(s, d), lambda: recurrent.Macd(5, 10, 4)), ROW, ("macd", "macd_signal", "macd_histogram")), sql(MACD, joined("users", "f", "w", "g"), TROW, {"macd": "f.v - w.v", "macd_signal": "g.v", "macd_histogram": "f.v - w.v - g.v"}, True))
RSI = f"{USERS}, c AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY rn) AS ch FROM users), cc AS (SELECT symbol, rn, greatest(ch, 0) AS g, greatest(-ch, 0) AS l FROM c WHERE ch IS NOT NULL), {seeded('cc', 'g', 14, 1 / 14, 'g')}, {seeded('cc', 'l', 14, 1 / 14, 'l')}"
add("rsi_wilder", lambda s, d: out(scan(views.user_ticks(s, d), lambda: recurrent.Rsi(14)), ROW, ("rsi", "avg_gain", "avg_loss")), sql(RSI, joined("users", "g", "l"), TROW, {"rsi": "CASE WHEN g.v + l.v > 0 THEN 100 * g.v / (g.v + l.v) WHEN g.v IS NOT NULL THEN 50 END", "avg_gain": "g.v", "avg_loss": "l.v"}, True))
RSI_TIMED = f"""{USERS}, a_r AS (SELECT symbol, rn, ts_ns, price, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, 0.0::DOUBLE AS el FROM users WHERE rn = 1 UNION ALL
SELECT t.symbol, t.rn, t.ts_ns, t.price, r.g + (1 - exp(-greatest((t.ts_ns - r.ts_ns) / 1e9, 0) / {DAY})) * (greatest(t.price - r.price, 0) - r.g), r.l + (1 - exp(-greatest((t.ts_ns - r.ts_ns) / 1e9, 0) / {DAY})) * (greatest(r.price - t.price, 0) - r.l), r.el + greatest((t.ts_ns - r.ts_ns) / 1e9, 0) FROM a_r r JOIN users t ON t.symbol = r.symbol AND t.rn = r.rn + 1)"""
add("rsi_wilder_timed", lambda s, d: out(scan(views.user_ticks(s, d), lambda: recurrent.TimedRsi(DAY)), ROW, ("rsi",)), sql(RSI_TIMED, joined("users", "a"), TROW, {"rsi": f"CASE WHEN a.el >= {DAY} THEN CASE WHEN a.g + a.l > 0 THEN 100 * a.g / (a.g + a.l) ELSE 50 END END"}, True))
MACD_TIMED = f"""{USERS}, {timed('f', DAY / 2)}, {timed('w', DAY)}, line AS (SELECT f.symbol, f.ts_ns, f.rn AS own, f.v - w.v AS line, row_number() OVER (PARTITION BY f.symbol ORDER BY f.rn) AS rn FROM f_r f JOIN w_r w ON w.symbol = f.symbol AND w.rn = f.rn WHERE f.el >= {DAY / 2} AND w.el >= {DAY}),
h_r AS (SELECT symbol, own, rn, ts_ns, line AS v, 0.0::DOUBLE AS el FROM line WHERE rn = 1
UNION ALL SELECT t.symbol, t.own, t.rn, t.ts_ns, CASE WHEN t.ts_ns > r.ts_ns THEN r.v + (1 - exp(-((t.ts_ns - r.ts_ns) / 1e9) / {DAY / 3})) * (t.line - r.v) ELSE r.v END, r.el + greatest((t.ts_ns - r.ts_ns) / 1e9, 0) FROM h_r r JOIN line t ON t.symbol = r.symbol AND t.rn = r.rn + 1),
g_r AS (SELECT symbol, own AS rn, v, el FROM h_r)"""
MACD_LINE, MACD_SIGNAL = f"CASE WHEN f.el >= {DAY / 2} AND w.el >= {DAY} THEN f.v - w.v END", f"CASE WHEN g.el >= {DAY / 3} THEN g.v END"
add("macd_timed", lambda s, d: out(scan(views.user_ticks(s, d), lambda: recurrent.TimedMacd(DAY / 2, DAY, DAY / 3)), ROW, ("macd", "macd_signal", "macd_histogram")), sql(MACD_TIMED, joined("users", "f", "w", "g") , TROW, {"macd": MACD_LINE, "macd_signal": MACD_SIGNAL, "macd_histogram": f"{MACD_LINE} - {MACD_SIGNAL}"}, True))
BARS_RN = f"{BARS}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_ns) AS rn, lag(high) {over(None, BO)} AS h0, lag(low) {over(None, BO)} AS l0, lag(close) {over(None, BO)} AS c0 FROM bars), tr AS (SELECT *, CASE WHEN c0 IS NULL THEN high - low ELSE greatest(high - low, abs(high - c0), abs(low - c0)) END AS tr, CASE WHEN h0 IS NULL THEN NULL WHEN high - h0 > l0 - low AND high - h0 > 0 THEN high - h0 ELSE 0 END AS pdm, CASE WHEN h0 IS NULL THEN NULL WHEN l0 - low > high - h0 AND l0 - low > 0 THEN l0 - low ELSE 0 END AS mdm, CASE WHEN h0 IS NOT NULL THEN greatest(high - low, abs(high - c0), abs(low - c0)) END AS tr1 FROM b)"
BKEY = ("t.symbol", "t.bucket")
bar_scan = lambda s, d, make: scan(views.bars(s, d), make, order=BAR_ORDER)
add("atr", lambda s, d: out(bar_scan(s, d, lambda: recurrent.Atr(14)), ("symbol", "bucket"), ("true_range", "atr")), sql(f"{BARS_RN}, {seeded('tr', 'tr', 14, 1 / 14, 'a')}", joined("tr", "a"), BKEY, {"true_range": "t.tr", "atr": "a.v"}, True))
ADX = f"{BARS_RN}, {seeded('tr', 'tr1', 7, 1 / 7, 'r')}, {seeded('tr', 'pdm', 7, 1 / 7, 'p')}, {seeded('tr', 'mdm', 7, 1 / 7, 'm')}, dx AS (SELECT r.symbol, r.rn, 100 * p.v / r.v AS pdi, 100 * m.v / r.v AS mdi FROM r_r r JOIN p_r p ON p.symbol = r.symbol AND p.rn = r.rn JOIN m_r m ON m.symbol = r.symbol AND m.rn = r.rn WHERE r.v > 0), dy AS (SELECT *, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx FROM dx), {seeded('dy', 'dx', 7, 1 / 7, 'x')}"
add("adx", lambda s, d: out(bar_scan(s, d, lambda: recurrent.Adx(7)), ("symbol", "bucket"), ("plus_di", "minus_di", "dx", "adx")), sql(ADX, joined("tr", "x") + " LEFT JOIN dy ON dy.symbol = t.symbol AND dy.rn = t.rn", BKEY, {"plus_di": "dy.pdi", "minus_di": "dy.mdi", "dx": "dy.dx", "adx": "x.v"}, True))

# ---- volume

VP = f"{TRADES}, m AS (SELECT *, sum(size) {over(20)} AS v, sum(CASE WHEN sign > 0 THEN size ELSE 0 END) {over(20)} AS b, sum(price * size) {over(20)} AS nt, {mean_sql('size', 100)} AS mu, CASE WHEN count(size) {over(100)} = 100 THEN stddev_pop(size) {over(100)} END AS sd FROM trades)"
add(
    "volume_profile", lambda s, d: out(rolling.volume_profile(views.trades(s, d), 20, 100), ROW, ("volume", "volume_z", "normalized", "buy_volume", "sell_volume", "delta", "imbalance", "notional")),
    sql(VP, "m", ROW, {"volume": "v", "volume_z": div("v - 20 * mu", "sqrt(20) * sd"), "normalized": div("v", "20 * mu"), "buy_volume": "b", "sell_volume": "v - b", "delta": "2 * b - v", "imbalance": div("2 * b - v", "v"), "notional": "nt"}),
)
VWAP_COLS = {"vwap": "vw", "sigma": "sd", "upper": "vw + 2 * sd", "lower": "vw - 2 * sd", "deviation": div("price - vw", "vw")}
for name, n in (("vwap_anchored", 0), ("vwap_rolling", 30)):
    VW = f"{TRADES}, m AS (SELECT *, sum(price * size) {over(n)} / sum(size) {over(n)} AS vw, count(*) {over(n)} AS n, first_value(price) {over(0)} AS a FROM trades), q AS (SELECT *, sum((price - 1500) * (price - 1500) * size) {over(n)} / sum(size) {over(n)} - (vw - 1500) * (vw - 1500) AS var FROM m), f AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE sqrt(greatest(var, 0)) END AS sd FROM q)"
    add(name, lambda s, d, n=n: out(rolling.vwap(views.trades(s, d), n), ROW, ("vwap", "deviation")), sql(VW, "f", ROW, {k: VWAP_COLS[k] for k in ("vwap", "deviation")}))

    add(f"vwap_bands_{name[5:]}", lambda s, d, n=n: out(rolling.vwap(views.trades(s, d), n), ROW, ("sigma", "upper", "lower"), 3), sql(VW, "f", ROW, {k: VWAP_COLS[k] for k in ("sigma", "upper", "lower")}, digits=3))

# ---- clocks

BAR_COLS = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume"}
add("time_bars", lambda s, d: out(views.bars(s, d).drop("seq"), ("symbol", "bucket", "open_ns", "close_ns", "trades"), BAR_COLS), sql(BARS, "bars", ("symbol", "bucket", "open_ns", "close_ns", "trades"), BAR_COLS))
TB = f"{TICKS}, n AS (SELECT *, (row_number() {over()} - 1) // 25 AS bucket FROM ticks), g AS (SELECT symbol, bucket, min(ts_ns) AS open_ns, max(ts_ns) AS close_ns, count(*) AS trades, first(price ORDER BY ts_ns, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_ns, seq) AS close, sum(size) AS volume FROM n GROUP BY 1, 2 HAVING count(*) = 25)"
add("tick_bars", lambda s, d: out(clocks.tick_bars(views.sized_ticks(s, d), 25), ("symbol", "bucket", "open_ns", "close_ns", "trades"), BAR_COLS), sql(TB, "g", ("symbol", "bucket", "open_ns", "close_ns", "trades"), BAR_COLS))
BUCKET = 200.0
CLOCK = f"{TRADES}, c AS (SELECT *, sum(size) {over(0)} AS c1, sum(size) {over(0)} - size AS c0 FROM trades), e AS (SELECT *, unnest(range(floor(c0 / {BUCKET})::BIGINT, ceil(c1 / {BUCKET})::BIGINT)) AS bucket FROM c), o AS (SELECT *, least(c1, (bucket + 1) * {BUCKET}) - greatest(c0, bucket * {BUCKET}) AS ov FROM e), vb AS (SELECT symbol, bucket, sum(ov) AS v, sum(ov * CASE WHEN sign > 0 THEN 1 WHEN sign < 0 THEN 0 ELSE 0.5 END) AS buy FROM o GROUP BY 1, 2 HAVING sum(ov) >= {BUCKET} - 1e-9)"
add("volume_clock_buckets", lambda s, d: out(clocks.volume_buckets(views.trades(s, d), BUCKET), ("symbol", "bucket"), ("buy", "sell", "imbalance")), sql(CLOCK, "vb", ("symbol", "bucket"), {"buy": "buy", "sell": "v - buy", "imbalance": "2 * buy - v"}))
VPIN = f"{CLOCK}, vp AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN sum(abs(2 * buy - v)) OVER w / (10 * {BUCKET}) END AS vpin, CASE WHEN count(*) OVER w = 10 THEN sum(abs(2 * buy - v)) OVER w / sum(v) OVER w END AS va FROM vb WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"
add("vpin", lambda s, d: out(clocks.vpin(views.trades(s, d), BUCKET, 10), ("symbol", "bucket"), ("vpin", "vpin_actual")), sql(VPIN, "vp", ("symbol", "bucket"), {"vpin": "vpin", "vpin_actual": "va"}))
add("vpin_of_trades", lambda s, d: out(clocks.vpin_of_trades(views.trades(s, d), BUCKET, 10), ROW, ("vpin",)), sql(VPIN.replace("c AS (SELECT *, sum(size)", f"c AS MATERIALIZED (SELECT *, floor(sum(size) {over(0)} / {BUCKET})::BIGINT - 1 AS reached, sum(size)", 1), "c LEFT JOIN vp ON vp.symbol = c.symbol AND vp.bucket = c.reached", ("c.symbol", "c.ts_ns", "c.seq"), {"vpin": "vp.vpin"}))
VBARS = f"{TRADES}, vn AS (SELECT symbol, seq, size, 0::BIGINT AS bar, size AS v FROM trades WHERE seq = 1 UNION ALL SELECT t.symbol, t.seq, t.size, CASE WHEN r.v >= 300 THEN r.bar + 1 ELSE r.bar END, CASE WHEN r.v >= 300 THEN t.size ELSE r.v + t.size END FROM vn r JOIN trades t ON t.symbol = r.symbol AND t.seq = r.seq + 1), g AS (SELECT t.symbol, n.bar AS bucket, min(t.ts_ns) AS open_ns, max(t.ts_ns) AS close_ns, count(*) AS trades, first(price ORDER BY t.seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY t.seq) AS close, sum(t.size) AS volume FROM vn n JOIN trades t USING (symbol, seq) GROUP BY 1, 2 HAVING sum(t.size) >= 300)"
add("volume_bars", lambda s, d: out(recurrent.volume_bars(views.trades(s, d), 300.0), ("symbol", "bucket", "open_ns", "close_ns", "trades"), BAR_COLS), sql(VBARS, "g", ("symbol", "bucket", "open_ns", "close_ns", "trades"), BAR_COLS, True))

# ---- books

BK = ("symbol", "bucket")


def book_query(columns) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        made = columns(C("bids"), C("asks"))
        return out(views.books(spark, sf).withColumns(made), BK, tuple(made))

    return run


def book_sql(aggregates: dict[str, str], cols: dict[str, str], extra: str = "") -> str:
    told = ", ".join(f"{e} AS {n}" for n, e in aggregates.items())
    return sql(f"{LEVELS}{extra}, ag AS (SELECT m.symbol, m.bucket, any_value(m.mid) AS mid, any_value(m.bid) AS bid, any_value(m.ask) AS ask, any_value(m.bid_size) AS bq, any_value(m.ask_size) AS aq, {told} FROM mids m LEFT JOIN lm USING (symbol, bucket) GROUP BY 1, 2)", "ag", BK, {n: f"CASE WHEN mid IS NOT NULL THEN {e} END" for n, e in cols.items()})


SIDE = {"imbalance": div("b - a", "b + a"), "ratio": div("b", "a"), "log_ratio": "ln(b / a)"}
add("book_imbalance", book_query(lambda b, a: book.imbalance(b, a, 5)), book_sql({"b": "sum(size) FILTER (WHERE is_bid AND lv <= 5)", "a": "sum(size) FILTER (WHERE NOT is_bid AND lv <= 5)"}, SIDE))
add("book_imbalance_decay", book_query(lambda b, a: book.imbalance(b, a, 0, 5000.0)), book_sql({"b": "sum(size * exp(-tau * 10000 / 5000)) FILTER (WHERE is_bid)", "a": "sum(size * exp(-tau * 10000 / 5000)) FILTER (WHERE NOT is_bid)"}, SIDE))
for kernel, weight in (("rectangular", "CASE WHEN tau * 10000 <= 8000 THEN 1 ELSE 0 END"), ("triangular", "CASE WHEN tau * 10000 <= 8000 THEN 1 - tau * 10000 / 8000 ELSE 0 END"), ("exponential", "exp(-tau * 10000 / 8000)")):
    add(f"density_{kernel}", book_query(lambda b, a, k=kernel: book.density(b, a, 8000.0, k)), book_sql({"i": f"sum(size * {weight})", "w": "sum(size)", "n": f"sum(size * price * {weight})"}, {"density": "i", "density_share": "i / w", "density_notional": "n"}))
add(
    "weighted_prices", book_query(lambda b, a: book.weighted_prices(b, a, 5)),
    book_sql({"bp": "sum(price * size) FILTER (WHERE is_bid AND lv <= 5) / sum(size) FILTER (WHERE is_bid AND lv <= 5)", "ap": "sum(price * size) FILTER (WHERE NOT is_bid AND lv <= 5) / sum(size) FILTER (WHERE NOT is_bid AND lv <= 5)"}, {"bid_price": "bp", "ask_price": "ap", "weighted_mid": "(ask * bq + bid * aq) / (aq + bq)", "mid": "mid", "tilt": "((ask * bq + bid * aq) / (aq + bq) - mid) / mid * 10000"}),
)
CUM = ", lc AS (SELECT *, sum(size) OVER (PARTITION BY symbol, bucket, is_bid ORDER BY lv) AS cum FROM lm WHERE lv <= 20)"
add(
    "book_slope", book_query(lambda b, a: book.slope(b, a, 20)),
    sql(f"{LEVELS}{CUM}, ag AS (SELECT symbol, bucket, sum(tau * cum) FILTER (WHERE is_bid) / sum(tau * tau) FILTER (WHERE is_bid) AS b, sum(tau * cum) FILTER (WHERE NOT is_bid) / sum(tau * tau) FILTER (WHERE NOT is_bid) AS a FROM lc GROUP BY 1, 2), fx AS (SELECT m.symbol, m.bucket, b, a FROM mids m LEFT JOIN ag USING (symbol, bucket))", "fx", BK, {"bid_slope": "b", "ask_slope": "a", "slope": "(a + b) / 2", "slope_asymmetry": div("b - a", "b + a")}),
)
SPENT = ", lc AS (SELECT *, coalesce(sum(price * size) OVER (PARTITION BY symbol, bucket, is_bid ORDER BY lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lm), lp AS (SELECT *, greatest(0, least(600.0::DOUBLE - before, price * size)) AS spent FROM lc)"
add(
    "cost_to_trade", book_query(lambda b, a: book.cost_to_trade(b, a, 600.0)),
    sql(f"{LEVELS}{SPENT}, ag AS (SELECT symbol, bucket, any_value(mid) AS mid, sum(spent) FILTER (WHERE NOT is_bid) AS sa, sum(spent / price) FILTER (WHERE NOT is_bid) AS qa, sum(spent) FILTER (WHERE is_bid) AS sb, sum(spent / price) FILTER (WHERE is_bid) AS qb FROM lp GROUP BY 1, 2), fx AS (SELECT *, CASE WHEN mid IS NOT NULL AND sa >= 600 - 1e-9 THEN (600 / qa - mid) / mid * 10000 END AS bb, CASE WHEN mid IS NOT NULL AND sb >= 600 - 1e-9 THEN -(600 / qb - mid) / mid * 10000 END AS ss FROM ag)", "fx", BK, {"buy_bps": "bb", "sell_bps": "ss", "buy_filled": "CASE WHEN mid IS NOT NULL THEN sa / 600 END", "sell_filled": "CASE WHEN mid IS NOT NULL THEN sb / 600 END", "round_trip_bps": "bb + ss"}),
)
TAKEN = ", lc AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY symbol, bucket ORDER BY lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lm WHERE NOT is_bid), lp AS (SELECT *, greatest(0, least(20 - before, size)) AS taken FROM lc)"
add(
    "cost_for_size", book_query(lambda b, a: {k: v for k, v in book.cost_for_size(a, book.mid(b, a), 20.0, 1).items()}),
    sql(f"{LEVELS}{TAKEN}, ag AS (SELECT symbol, bucket, any_value(mid) AS mid, sum(taken) AS t, sum(taken * price) AS paid, count(*) FILTER (WHERE taken > 0) AS lv FROM lp GROUP BY 1, 2), fx AS (SELECT m.symbol, m.bucket, m.mid, coalesce(t, 0) AS t, paid, coalesce(lv, 0) AS lv FROM mids m LEFT JOIN ag USING (symbol, bucket))", "fx", BK, {"avg_price": "CASE WHEN mid > 0 AND t >= 20 THEN paid / 20 END", "slippage_bps": "CASE WHEN mid > 0 AND t >= 20 THEN (paid / 20 - mid) / mid * 10000 END", "filled": "t / 20", "levels": "lv"}),
)
add("book_spread", lambda s, d: out(rolling.rolling_mean(views.quotes(s, d).filter("mid is not null").withColumns({"quoted": C("ask") - C("bid"), "relative_bps": (C("ask") - C("bid")) / C("mid") * 10_000}), "relative_bps", 10, "average_bps", partial=True), BK, ("quoted", "relative_bps", "mid", "average_bps")), sql(f"{LEVELS}, q AS (SELECT *, ask - bid AS qs, (ask - bid) / mid * 10000 AS rb FROM mids WHERE mid IS NOT NULL), f AS (SELECT *, avg(rb) {over(10, 'bucket')} AS av FROM q)", "f", BK, {"quoted": "qs", "relative_bps": "rb", "mid": "mid", "average_bps": "av"}))

# ---- trades against quotes

ASOF = f"{LEVELS}, tm AS (SELECT t.*, m.mid FROM ticks t ASOF LEFT JOIN (SELECT * FROM mids WHERE mid IS NOT NULL) m ON t.symbol = m.symbol AND t.ts_ns >= m.ts_ns)"


def with_mid(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.as_of_mid(views.sized_ticks(spark, sf), views.quotes(spark, sf).filter("mid is not null"))


add("effective_spread", lambda s, d: out(rolling.effective_spread(with_mid(s, d), 3), ROW, ("effective", "realized_spread")), sql(f"{ASOF}, f AS (SELECT *, lead(mid, 3) {over()} AS fm FROM tm)", "f", ROW, {"effective": "2 * abs(price - mid)", "realized_spread": "2 * sign * (price - fm)"}))
ROLL = f"{TICKS}, c AS (SELECT *, price - lag(price) {over()} AS ch FROM ticks), d AS (SELECT *, lag(ch) {over()} AS d0, avg(ch) OVER (PARTITION BY symbol) AS mu, count(ch) OVER (PARTITION BY symbol) AS m FROM c), g AS (SELECT symbol, sum((ch - mu) * (d0 - mu)) / (any_value(m) - 1) AS cov FROM d GROUP BY 1)"
add("roll_spread", lambda s, d: out(rolling.roll_spread(views.ticks(s, d)), ("symbol",), ("roll",)), sql(ROLL, "g", ("symbol",), {"roll": "CASE WHEN cov < 0 THEN 2 * sqrt(-cov) END"}))
CLASSES = f"q AS (SELECT *, sign_q AS own_q, coalesce(sign_q, sign_t) AS own FROM (SELECT *, CASE WHEN price > mid THEN 1.0 WHEN price < mid THEN -1.0 END AS sign_q, CASE WHEN price > lag(price) {over()} THEN 1.0 WHEN price < lag(price) {over()} THEN -1.0 END AS sign_t FROM src)), k AS (SELECT *, coalesce(last_value(own IGNORE NULLS) {over(0)}, 0) AS cl FROM q), f AS (SELECT *, avg(cl) {over(20)} AS ms, avg(CASE WHEN own_q IS NULL THEN 0 ELSE 1 END) {over(20)} AS qs FROM k)"
CLASS_COLS = {"classified": "cl", "mean_sign": "ms", "quote_share": "qs"}
add("lee_ready", lambda s, d: out(rolling.trade_classifier(with_mid(s, d), True, 20), ROW, tuple(CLASS_COLS)), sql(f"{ASOF}, src AS (SELECT * FROM tm), {CLASSES}", "f", ROW, CLASS_COLS))
add("tick_rule", lambda s, d: out(rolling.trade_classifier(views.ticks(s, d), False, 20), ROW, tuple(CLASS_COLS)), sql(f"{TICKS}, src AS (SELECT *, NULL::DOUBLE AS mid FROM ticks), {CLASSES}", "f", ROW, CLASS_COLS))
add("bulk_volume", lambda s, d: out(rolling.bulk_volume(views.ticks(s, d), 20), ROW, ("buy_share",)), sql(f"{CHANGES}, f AS (SELECT *, stddev_samp(ch) {over(20)} AS sd FROM c)", "f", ROW, {"buy_share": "CASE WHEN sd > 0 THEN 1 / (1 + exp(-1.702::DOUBLE * ch / sd)) END"}))
OFI = f"{LEVELS}, q AS (SELECT *, lag(bid) OVER w AS pb, lag(bid_size) OVER w AS qb, lag(ask) OVER w AS pa, lag(ask_size) OVER w AS qa FROM mids WHERE mid IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY bucket)), e AS (SELECT *, CASE WHEN pb IS NOT NULL THEN CASE WHEN bid >= pb THEN bid_size ELSE 0 END - CASE WHEN bid <= pb THEN qb ELSE 0 END - CASE WHEN ask <= pa THEN ask_size ELSE 0 END + CASE WHEN ask >= pa THEN qa ELSE 0 END END AS ev, CASE WHEN pb IS NOT NULL THEN (bid_size + ask_size) / 2 END AS dp FROM q), f AS (SELECT *, CASE WHEN count(ev) {over(10, 'bucket')} = 10 THEN sum(ev) {over(10, 'bucket')} END AS ofi, avg(dp) {over(10, 'bucket')} AS ad FROM e)"
add("order_flow_imbalance", lambda s, d: out(rolling.order_flow_imbalance(views.quotes(s, d), 10), BK, ("event", "ofi", "implied_move")), sql(OFI, "f", BK, {"event": "ev", "ofi": "ofi", "implied_move": "ofi / (2 * ad)"}))
IMPACT = f"{TICKS}, c AS (SELECT *, size * sign AS q, price - lag(price) {over()} AS ch FROM ticks), n AS (SELECT *, CASE WHEN ch IS NOT NULL THEN q * ch END AS qc, CASE WHEN ch IS NOT NULL THEN q * q END AS qq, CASE WHEN ch IS NOT NULL AND abs(q) * price > 0 THEN abs(ch / price) / (abs(q) * price) END AS am FROM c), k AS (SELECT *, count(am) {over(0)} AS i FROM n), f AS (SELECT *, CASE WHEN count(qc) {over(40)} = 40 AND sum(qq) {over(40)} > 0 THEN sum(qc) {over(40)} / sum(qq) {over(40)} END AS lam, CASE WHEN ch IS NOT NULL THEN avg(am) OVER (PARTITION BY symbol, ch IS NOT NULL ORDER BY i RANGE BETWEEN 39 PRECEDING AND CURRENT ROW) END AS amh FROM k)"
add("price_impact", lambda s, d: out(rolling.price_impact(views.sized_ticks(s, d), 40), ROW, ("lambda", "depth", "amihud")), sql(IMPACT, "f", ROW, {"lambda": "lam", "depth": "CASE WHEN lam > 0 THEN 1 / lam END", "amihud": "amh"}))

# ---- volatility and regime

add("range_volatility", lambda s, d: out(rolling.range_volatility(views.ticks(s, d), 20, 3), ROW, ("range", "range_sigma")), sql(f"{TICKS}, x AS (SELECT *, {mean_sql('price', 3)} AS x FROM ticks), m AS (SELECT *, CASE WHEN count(x) {over(20)} = 20 THEN (max(x) {over(20)} - min(x) {over(20)}) / avg(x) {over(20)} END AS rg FROM x)", "m", ROW, {"range": "rg", "range_sigma": "rg / (2 * sqrt(ln(2)))"}))
VOL = f"{BARS}, v AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(close / lag(close) {over(None, BO)}) AS cc, coalesce(ln(open / lag(close) {over(None, BO)}), 0) AS oc FROM bars)"
ESTIMATES = {
    "parkinson": mean_sql("hl * hl / (4 * ln(2))", 10, BO), "garman_klass": mean_sql("0.5 * hl * hl - (2 * ln(2) - 1) * co * co", 10, BO), "rogers_satchell": mean_sql("rs", 10, BO),
    "close_to_close": f"CASE WHEN count(cc) {over(10, BO)} = 10 THEN var_samp(cc) {over(10, BO)} END",
    "yang_zhang": f"CASE WHEN count(*) {over(10, BO)} = 10 THEN var_samp(oc) {over(10, BO)} + (0.34 / (1.34 + 11 / 9.0))::DOUBLE * var_samp(co) {over(10, BO)} + (1 - 0.34 / (1.34 + 11 / 9.0))::DOUBLE * avg(rs) {over(10, BO)} END",
}
for kind, estimate in ESTIMATES.items():
    add(f"volatility_{kind}", lambda s, d, k=kind: out(rolling.ohlc_volatility(views.bars(s, d), 10, k, 1460.0), BK, ("sigma", "annualised")), sql(f"{VOL}, f AS (SELECT *, {estimate} AS var FROM v)", "f", BK, {"sigma": "sqrt(greatest(var, 0) + 0 * var)", "annualised": "sqrt(greatest(var, 0) + 0 * var) * sqrt(1460)"}))
LOGS = f"{TICKS}, l AS (SELECT *, ln(price / lag(price) {over()}) AS r FROM ticks)"
add("realized_volatility", lambda s, d: out(rolling.realized_volatility(views.ticks(s, d), 20), ROW, ("realized",)), sql(f"{LOGS}, f AS (SELECT *, {mean_sql('r * r', 20)} AS v FROM l)", "f", ROW, {"realized": "sqrt(v)"}))
EWMA = f"{USERS}, pos AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k FROM users WHERE price > 0), l AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY k)) AS r FROM pos), e_r AS (SELECT symbol, k, rn, r * r AS v FROM l WHERE k = 2 UNION ALL SELECT l.symbol, l.k, l.rn, 0.94::DOUBLE * a.v + 0.06::DOUBLE * l.r * l.r FROM e_r a JOIN l ON l.symbol = a.symbol AND l.k = a.k + 1), a_r AS (SELECT symbol, rn, v FROM e_r)"
add("ewma_volatility", lambda s, d: out(scan(views.user_ticks(s, d), lambda: recurrent.EwmaVolatility(0.94)), ROW, ("ewma_volatility",)), sql(EWMA, joined("users", "a"), TROW, {"ewma_volatility": "sqrt(a.v)"}, True))
FLAT = f"{TICKS}, c AS (SELECT *, abs(price - lag(price) {over()}) AS ch, abs(price - lag(price, 20) {over()}) AS dp FROM ticks), m AS (SELECT *, CASE WHEN count(ch) {over(20)} = 20 THEN sum(ch) {over(20)} END AS pl, {mean_sql('price', 20)} AS mu, stddev_pop(price) {over(20)} AS sd FROM c)"
add("flat_market", lambda s, d: out(rolling.flat_market(views.ticks(s, d), 20), ROW, ("efficiency", "band_width", "displacement", "path_length")), sql(FLAT, "m", ROW, {"efficiency": "CASE WHEN pl > 0 THEN dp / pl WHEN pl IS NOT NULL THEN 0 END", "band_width": "CASE WHEN mu > 0 THEN 4 * sd / mu END", "displacement": "dp", "path_length": "pl"}))

# ---- several instruments

DO = "ts_ns"
WEIGHTS = {
    "equal": "0.2::DOUBLE", "volume": f"avg(size) {over(20, DO)}",
    "inverse_volatility": f"CASE WHEN count(r) {over(20, DO)} = 20 AND avg(r * r) {over(20, DO)} > 0 THEN 1 / sqrt(avg(r * r) {over(20, DO)}) END",
}


def basket_sql(weighting: str) -> str:
    return f"{DAILY}, whole AS (SELECT ts_ns FROM daily GROUP BY 1 HAVING count(DISTINCT symbol) = 5), al AS (SELECT * FROM daily WHERE ts_ns IN (SELECT ts_ns FROM whole)), l AS (SELECT *, ln(price / lag(price) {over(None, DO)}) AS r FROM al), raw AS (SELECT *, {WEIGHTS[weighting]} AS raw FROM l), wt AS (SELECT *, CASE WHEN count(raw) OVER (PARTITION BY ts_ns) = 5 THEN raw / sum(raw) OVER (PARTITION BY ts_ns) END AS w FROM raw), bk AS (SELECT ts_ns, CASE WHEN count(w * r) = 5 THEN sum(w * r) END AS b FROM wt GROUP BY 1), ds AS (SELECT bk.ts_ns, any_value(b) AS b, CASE WHEN any_value(b) IS NOT NULL THEN sqrt(greatest(sum(w * (r - b) * (r - b)), 0)) END AS dsp FROM bk JOIN wt USING (ts_ns) GROUP BY 1)"


for weighting in WEIGHTS:
    add(f"basket_{weighting}", lambda s, d, w=weighting: out(cross.basket_return(views.daily(s, d), TYPES, w, 20), ("ts_ns",), ("basket", "dispersion")), sql(basket_sql(weighting), "ds", ("ts_ns",), {"basket": "b", "dispersion": "dsp"}))
RS = f"{basket_sql('equal')}, o AS (SELECT ts_ns, ln(price / lag(price) {over(None, DO)}) AS ra FROM daily WHERE symbol = 'click'), j AS (SELECT o.ts_ns, ra, ds.b FROM o JOIN ds USING (ts_ns)), f AS (SELECT *, CASE WHEN count(CASE WHEN ra IS NOT NULL THEN b END) OVER w = 20 THEN regr_slope(ra, b) OVER w END AS beta FROM j WINDOW w AS (ORDER BY ts_ns ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
add("relative_strength", lambda s, d: out(cross.relative_strength(views.daily(s, d), "click", TYPES, 20), ("ts_ns",), ("excess", "beta", "beta_adjusted")), sql(RS, "f", ("ts_ns",), {"excess": "ra - b", "beta": "beta", "beta_adjusted": "ra - beta * b"}))
MS = f"{basket_sql('volume')}, lg AS (SELECT *, ln(price / lag(price, 20) {over(None, DO)}) AS lr, CASE WHEN count(r) {over(20, DO)} = 20 THEN sqrt(avg(r * r) {over(20, DO)}) END AS sg FROM wt), f AS (SELECT ts_ns, CASE WHEN count(lr) = 5 THEN 2 * sum(CASE WHEN lr > 0 THEN 1.0::DOUBLE ELSE 0 END) / 5 - 1 END AS br, CASE WHEN count(w * lr / (sg * sqrt(20))) = 5 THEN sum(w * lr / (sg * sqrt(20))) END AS mo FROM lg GROUP BY 1)"
add("market_strength", lambda s, d: out(cross.market_strength(views.daily(s, d), TYPES, 20), ("ts_ns",), ("breadth", "momentum", "msi")), sql(MS, "f", ("ts_ns",), {"breadth": "br", "momentum": "mo", "msi": "0.5 * br + 0.5 * tanh(mo)"}))

# ---- filters: the local linear trend by every form, against one recursion

SIGMA_A, HALF = 1e-4, 20.0
VSTD = 1e-3


#: Process noise over dt, by places of the covariance: acceleration as white noise, and constant over each step.
CONTINUOUS, STEPWISE = ("dt * dt * dt / 3", "dt * dt / 2", "dt"), ("dt * dt * dt * dt / 4", "dt * dt * dt / 2", "dt * dt")


def kalman_sql(weigh: str = "1.0", r_eff: str = "r", half: float = HALF, noise: tuple = CONTINUOUS, start: str = "price") -> str:
    """One step: predict, then correct with weight w and reading variance re. The first reading corrects a level of ``start``."""
    q, r = repr(SIGMA_A**2), repr(half**2)
    pre = f"SELECT t.symbol, t.rn, t.ts_ns, t.price, (t.ts_ns - k.ts_ns) / 1e9 AS dt, k.x, k.v, k.p00, k.p01, k.p11, k.ll FROM kr k JOIN users t ON t.symbol = k.symbol AND t.rn = k.rn + 1"
    ahead = f"SELECT *, x + dt * v AS x1, p00 + dt * (2 * p01 + dt * p11) + {q}::DOUBLE * {noise[0]} AS a, p01 + dt * p11 + {q}::DOUBLE * {noise[1]} AS b, p11 + {q}::DOUBLE * {noise[2]} AS c FROM ({pre})"
    seen = f"SELECT *, price - x1 AS y, a + {r}::DOUBLE AS s, {r}::DOUBLE AS r FROM ({ahead})"
    gated = f"SELECT *, {weigh} AS w FROM ({seen})"
    told = f"SELECT *, s - r + {r_eff} AS se FROM ({gated})"
    first = f"SELECT symbol, rn, ts_ns, (price + {start}) / 2 AS x, 0.0::DOUBLE AS v, {r}::DOUBLE / 2 AS p00, 0.0::DOUBLE AS p01, {VSTD**2!r}::DOUBLE AS p11, -0.5 * ((price - {start}) * (price - {start}) / (2 * {r}::DOUBLE) + ln(2 * {r}::DOUBLE) + ln(2 * pi())) AS ll, (price - {start})::DOUBLE AS y, 2 * {r}::DOUBLE AS s, 1.0::DOUBLE AS w FROM users WHERE rn = 1"
    step = f"SELECT symbol, rn, ts_ns, CASE WHEN w > 0 THEN x1 + a * y / se ELSE x1 END, CASE WHEN w > 0 THEN v + b * y / se ELSE v END, CASE WHEN w > 0 THEN a - a * a / se ELSE a END, CASE WHEN w > 0 THEN b - a * b / se ELSE b END, CASE WHEN w > 0 THEN c - b * b / se ELSE c END, CASE WHEN w > 0 THEN ll - 0.5 * (y * y / se + ln(se) + ln(2 * pi())) ELSE ll END, y, s, w FROM ({told})"
    return f"{USERS}, kr AS ({first} UNION ALL {step})"


KJ = "users t JOIN kr k ON k.symbol = t.symbol AND k.rn = t.rn"
KCOLS = {"level": "k.x", "level_std": "sqrt(k.p00)", "innovation": "k.y", "innovation_std": "sqrt(k.s)", "weight": "k.w", "ll": "k.ll"}
RATE = {"rate": "k.v * 100"}
HUBER = "CASE WHEN sqrt(y * y / s) > 1.345 THEN 1.345 / sqrt(y * y / s) ELSE 1.0 END"
for name, gate, weigh, r_eff in (
    ("kalman_llt", None, "1.0::DOUBLE", "r"), ("kalman_gated", {"kind": "sigma", "k": 2.0}, "CASE WHEN y * y / s > 4 THEN 0.0 ELSE 1.0 END", "r"),
    ("kalman_huber", {"kind": "huber"}, f"({HUBER})::DOUBLE", "CASE WHEN w < 1 THEN r / w ELSE r END"),
):
    make = lambda g=gate: trend_filters.TrendFilter(SIGMA_A, HALF, velocity_std=VSTD, gate=filters.Gate.of(g) if g else None)
    add(name, lambda s, d, m=make: out(scan(views.user_ticks(s, d), m).withColumns({"rate": C("rate") * 100, "level_std": F.sqrt("level_var"), "innovation_std": F.sqrt("innovation_var")}), ROW, (*KCOLS, "rate")), sql(kalman_sql(weigh, r_eff), KJ, TROW, KCOLS | RATE, True))

LLT = {"type": "local-linear-trend", "sigma_a": SIGMA_A, "half_spread": HALF, "velocity_std": VSTD}


def start_at_first(kalman, values) -> None:
    kalman.x[0] = values.get(0, 0.0)


def llt_steps(spark: SparkSession, sf: str, form: str = "sequential", gate: dict | None = None) -> DataFrame:
    return filters.run_filter(views.kalman_ticks(spark, sf), LLT, {"form": form, "gate": gate}, start=start_at_first)


def llt_columns(steps: DataFrame) -> DataFrame:
    o = F.get("outcomes", 0)
    return out(steps.withColumns({"level": F.get("x", 0), "rate": F.get("x", 1) * 100, "level_std": F.sqrt(F.get("p", 0)), "innovation": o["y"], "innovation_std": F.sqrt(o["s"]), "weight": o["w"]}), ROW, (*KCOLS, "rate"))


for form in ("sequential", "joseph", "ud", "square-root"):
    add(f"kalman_form_{form.replace('-', '_')}", lambda s, d, f=form: llt_columns(llt_steps(s, d, f)), ORACLES["kalman_llt"])
add("kalman_gated_general", lambda s, d: llt_columns(llt_steps(s, d, "ud", {"kind": "sigma", "k": 2.0})), ORACLES["kalman_gated"])


#: One price by other motions, in the general filter.
ONE_STATE = {"rows": [{"0": 1.0}], "variances": [400.0], "p0_diag": [900.0], "x0": [50.0]}
MOTION_CONFIGS = {
    "random_walk": ONE_STATE | {"motion": {"type": "random-walk", "sigma": 0.05}}, "ornstein_uhlenbeck": ONE_STATE | {"motion": {"type": "ornstein-uhlenbeck", "theta": 1e-4, "mu": 60.0, "sigma": 0.2}},
    "white_acceleration": {"motion": {"type": "white-acceleration", "sigma_a": SIGMA_A}, "rows": [{"0": 1.0}], "variances": [HALF**2], "p0_diag": [HALF**2, VSTD**2]},
    "constant_acceleration": {"motion": {"type": "constant-acceleration", "sigma_j": 1e-8}, "rows": [{"0": 1.0}], "variances": [400.0], "p0_diag": [400.0, 1e-6, 1e-14], "x0": [50.0, 0.0, 0.0]},
    "singer": {"motion": {"type": "singer", "sigma": 1e-4, "tau": 7200.0}, "rows": [{"0": 1.0}], "variances": [400.0], "p0_diag": [400.0, 1e-6], "x0": [50.0, 0.0]},
}


def scalar_sql(source: str, x0: str, p0: str, decay: str, noise: str, mean: str, r: str) -> str:
    """kr: a filter of one state, x' = mean + decay (x - mean) with the noise added, over source (symbol, rn, ts_ns, price)."""
    ahead = f"SELECT t.symbol, t.rn, t.price, t.ts_ns, {mean} + {decay} * (k.x - {mean}) AS x1, {decay} * {decay} * k.p + {noise} AS a, k.ll FROM kr k JOIN (SELECT *, (ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY rn)) / 1e9 AS dt FROM {source}) t ON t.symbol = k.symbol AND t.rn = k.rn + 1"
    seen = "SELECT symbol, rn, x1 + a / s * y, a - a * a / s, ll - 0.5 * (y * y / s + ln(s) + ln(2 * pi()))"
    return f"""kr AS (SELECT symbol, rn, {x0}::DOUBLE + {p0}::DOUBLE / ({p0} + {r}) * (price - {x0}) AS x, {p0}::DOUBLE - {p0} * {p0} / ({p0} + {r}) AS p, -0.5 * ((price - {x0}) * (price - {x0}) / ({p0} + {r}) + ln({p0} + {r}) + ln(2 * pi())) AS ll FROM {source} WHERE rn = 1
UNION ALL {seen} FROM (SELECT *, price - x1 AS y, a + {r} AS s FROM ({ahead})))"""


def motion_query(name: str) -> Callable:
    start = start_at_first if name == "white_acceleration" else None
    return lambda s, d: out(filters.run_filter(views.kalman_ticks(s, d), MOTION_CONFIGS[name], start=start).withColumns({"level": F.get("x", 0), "level_std": F.sqrt(F.get("p", 0))}), ROW, ("level", "level_std", "ll"), 3)


SCALAR = {"level": "k.x", "level_std": "sqrt(k.p)", "ll": "k.ll"}
add("motion_random_walk", motion_query("random_walk"), sql(f"{USERS}, {scalar_sql('users', '50', '900', '1.0::DOUBLE', '0.0025::DOUBLE * t.dt', '0', '400')}", KJ, TROW, SCALAR, True, 3))
add("motion_ornstein_uhlenbeck", motion_query("ornstein_uhlenbeck"), sql(f"{USERS}, {scalar_sql('users', '50', '900', 'exp(-1e-4::DOUBLE * t.dt)', '0.04::DOUBLE * (1 - exp(-2e-4::DOUBLE * t.dt)) / 2e-4', '60', '400')}", KJ, TROW, SCALAR, True, 3))
add("motion_white_acceleration", motion_query("white_acceleration"), sql(kalman_sql("1.0::DOUBLE", noise=STEPWISE), KJ, TROW, {"level": "k.x", "level_std": "sqrt(k.p00)", "ll": "k.ll"}, True, 3))
add("motion_constant_acceleration", motion_query("constant_acceleration"))
add("motion_singer", motion_query("singer"))


def by_key(spark: SparkSession, sf: str, make: Callable, names: tuple[str, ...]) -> DataFrame:
    """Another filter over the users' ticks as a kernel: make() gives step(ts_ns, price) -> values."""

    class Own(recurrent.Kernel):
        inputs, outputs = ("ts_ns", "price"), names

        def __init__(self):
            self.step = make()

    return out(scan(views.user_ticks(spark, sf), Own), ROW, names, 5)


def _information():
    model = models.build(LLT)
    held: list = []

    def step(ts, price):
        if not held:
            held.append(filters.InformationFilter(model.motion, model.observation, np.array([price, 0.0]), model.p0))
        f = held[0]
        f.step(ts, {0: price})
        x, p = f.mean(), f.covariance()
        return float(x[0]), float(x[1]) * 100, float(p[0, 0]) ** 0.5

    return step


def _nonlinear(kind):
    def make():
        model = models.as_nonlinear(models.build(LLT))
        held: list = []

        def step(ts, price):
            if not held:
                model.x0 = np.array([price, 0.0])
                held.append(kind(model))
            f = held[0]
            f.step(ts, {0: price})
            return float(f.x[0]), float(f.x[1]) * 100, float(f.p[0, 0]) ** 0.5

        return step

    return make


STATE = ("level", "rate", "level_std")
STATE_SQL = sql(kalman_sql("1.0::DOUBLE"), KJ, TROW, {"level": "k.x", "rate": "k.v * 100", "level_std": "sqrt(k.p00)"}, True, 5)
add("information_filter", lambda s, d: by_key(s, d, _information, STATE), STATE_SQL)
add("extended_kalman", lambda s, d: by_key(s, d, _nonlinear(filters.ExtendedKalmanFilter), STATE), STATE_SQL)
add("unscented_kalman", lambda s, d: out(scan_prices(views.user_ticks(s, d), lambda z: UnscentedFilters(models.build(LLT), z, alpha=1.0, kappa=1.0), STATE), ROW, STATE, 5), STATE_SQL)


def _imm(first: np.ndarray) -> ManyModels:
    return ManyModels([models.build(LLT | {"half_spread": HALF * factor}) for factor in (0.5, 3.0)], [[0.95, 0.05], [0.05, 0.95]], first)


REGIMES = ("level", "chance", "regime")
add("interacting_models", lambda s, d: out(scan_prices(views.user_ticks(s, d), _imm, REGIMES), ROW, REGIMES, 5))
index = 1e-2 * 3600.0**2 / HALF
r_ = (4 + index - (8 * index + index * index) ** 0.5) / 4
ALPHA = 1 - r_ * r_
BETA = 2 * (2 - ALPHA) - 4 * (1 - ALPHA) ** 0.5
AB = f"{USERS}, kr AS (SELECT symbol, rn, price AS x, 0.0::DOUBLE AS v FROM users WHERE rn = 1 UNION ALL SELECT t.symbol, t.rn, k.x + 3600 * k.v + {ALPHA!r}::DOUBLE * (t.price - k.x - 3600 * k.v), k.v + {BETA!r}::DOUBLE / 3600 * (t.price - k.x - 3600 * k.v) FROM kr k JOIN users t ON t.symbol = k.symbol AND t.rn = k.rn + 1)"
add("alpha_beta", lambda s, d: out(scan(views.user_ticks(s, d), lambda: trend_filters.AlphaBeta(1e-2, HALF, 3600.0)), ROW, ("position", "velocity")), sql(AB, KJ, TROW, {"position": "k.x", "velocity": "k.v"}, True))


def gain_at_rest(sigma_a: float, r: float, dt: float) -> tuple[float, float]:
    """The trend filter's gain where its variances no longer change, by running them."""
    q, (a, b, c) = sigma_a**2, (r, 0.0, 1.0)
    for _ in range(100_000):
        a, b, c = a + 2 * dt * b + dt * dt * c + q * dt**3 / 3, b + dt * c + q * dt**2 / 2, c + q * dt
        k, g = a / (a + r), b / (a + r)
        a, b, c = a - k * a, b - k * b, c - g * b
    return k, g


GAIN = gain_at_rest(1e-4, HALF**2, 3600.0)
STEADY = f"{USERS}, kr AS (SELECT symbol, rn, price AS x, 0.0::DOUBLE AS v FROM users WHERE rn = 1 UNION ALL SELECT t.symbol, t.rn, k.x + 3600 * k.v + {GAIN[0]!r}::DOUBLE * (t.price - k.x - 3600 * k.v), k.v + {GAIN[1]!r}::DOUBLE * (t.price - k.x - 3600 * k.v) FROM kr k JOIN users t ON t.symbol = k.symbol AND t.rn = k.rn + 1)"
add("steady_state", lambda s, d: out(scan(views.user_ticks(s, d), lambda: trend_filters.SteadyTrend(1e-4, HALF, 3600.0)), ROW, ("level", "rate")), sql(STEADY, KJ, TROW, {"level": "k.x", "rate": "k.v"}, True))
#: The first 50 differences give the noise and the interval; the trend filter starts at the price after them.
DERIVATIVE = f"""{TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, seq) AS rn FROM ticks), ch AS (SELECT *, price - lag(price) OVER w AS ch, (ts_ns - lag(ts_ns) OVER w) / 1e9 AS dt FROM n WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
st AS (SELECT symbol, stddev_samp(ch) / sqrt(2) AS noise, avg(dt) FILTER (WHERE dt > 0) AS gap FROM ch WHERE rn BETWEEN 2 AND 51 GROUP BY 1),
kr AS (SELECT n.symbol, rn, price AS x, 0.0::DOUBLE AS v, noise * noise AS p00, 0.0::DOUBLE AS p01, noise * noise / (gap * gap) AS p11, noise * noise AS r, pow(0.01 * noise * sqrt(3) / pow(gap, 1.5), 2) AS q FROM n JOIN st USING (symbol) WHERE rn = 51
UNION ALL SELECT symbol, rn, x1 + a / s * y, v + b / s * y, a - a * a / s, b - a * b / s, c - b * b / s, r, q FROM (SELECT *, price - x1 AS y, a + r AS s FROM
(SELECT t.symbol, t.rn, t.price, k.v, k.r, k.q, k.x + t.dt * k.v AS x1, k.p00 + t.dt * (2 * k.p01 + t.dt * k.p11) + k.q * t.dt * t.dt * t.dt / 3 AS a, k.p01 + t.dt * k.p11 + k.q * t.dt * t.dt / 2 AS b, k.p11 + k.q * t.dt AS c FROM kr k JOIN ch t ON t.symbol = k.symbol AND t.rn = k.rn + 1)))"""
add(
    "filtered_derivative", lambda s, d: out(scan(views.ticks(s, d), lambda: trend_filters.FilteredDerivative(0.01, None, 50)), ROW, ("rate", "level", "level_std", "t_stat"), 5),
    sql(DERIVATIVE, "n t LEFT JOIN kr k ON k.symbol = t.symbol AND k.rn = t.rn AND k.rn > 51", TROW, {"rate": "k.v", "level": "k.x", "level_std": "sqrt(k.p00)", "t_stat": "k.v / sqrt(k.p11)"}, True, 5),
)


# ---- finance models over the driver's tables


def pair_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """click against view at the quarter days, with the regressor in the row."""
    rows = views.daily(spark, sf).filter(C("symbol").isin("click", "view")).groupBy("ts_ns").pivot("symbol", ["click", "view"]).agg(F.first("price")).dropna()
    return rows.select(F.lit("click/view").alias("symbol"), "ts_ns", F.lit(0).cast("long").alias("seq"), F.create_map(F.lit(0), C("click")).alias("values"), C("view").alias("x"))


def pairs_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = pair_ticks(spark, sf).withColumn("rows", F.create_map(F.lit(0), F.array(F.lit(1.0), C("x"))))
    steps = filters.run_filter(rows, {"type": "pairs-hedge", "q_alpha": 1e-6, "q_beta": 1e-8, "r": 100.0})
    return out(steps.withColumns({"alpha": F.get("x", 0), "beta": F.get("x", 1)}), ROW, ("alpha", "beta", "ll"))


PV = "pv AS (SELECT ts_ns, max(price) FILTER (WHERE symbol = 'click') AS y, max(price) FILTER (WHERE symbol = 'view') AS x FROM daily GROUP BY 1 HAVING count(*) FILTER (WHERE symbol IN ('click', 'view')) = 2)"
PAIRS = f"""{DAILY}, {PV}, users AS (SELECT *, row_number() OVER (ORDER BY ts_ns) AS rn FROM pv),
kr AS (SELECT rn, ts_ns, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS paa, 0.0::DOUBLE AS pab, 0.25::DOUBLE AS pbb, 0.0::DOUBLE AS ll, true AS fresh FROM users WHERE rn = 1
UNION ALL SELECT rn, ts_ns, a + fa * e / s, b + fb * e / s, paa - fa * fa / s, pab - fa * fb / s, pbb - fb * fb / s, ll - 0.5 * (e * e / s + ln(s) + ln(2 * pi())), false FROM (SELECT *, paa + pab * x AS fa, pab + pbb * x AS fb, paa + 2 * x * pab + x * x * pbb + 100 AS s, y - a - b * x AS e FROM
(SELECT t.rn, t.ts_ns, t.x, t.y, k.a, k.b, k.paa + CASE WHEN k.fresh THEN 0 ELSE 1e-6 * (t.ts_ns - k.ts_ns) / 1e9 END AS paa, k.pab, k.pbb + CASE WHEN k.fresh THEN 0 ELSE 1e-8 * (t.ts_ns - k.ts_ns) / 1e9 END AS pbb, k.ll FROM kr k JOIN users t ON t.rn = k.rn + CASE WHEN k.fresh THEN 0 ELSE 1 END)))"""
add("pairs_hedge", pairs_query, sql(PAIRS, "kr WHERE NOT fresh", ("'click/view' AS symbol", "ts_ns", "0::BIGINT AS seq"), {"alpha": "a", "beta": "b", "ll": "ll"}, True))


def beta_query(spark: SparkSession, sf: str) -> DataFrame:
    returns = views.daily(spark, sf).withColumn("r", ln(ratio(C("price"), F.lag("price").over(cross._own()))))
    basket = returns.groupBy("ts_ns").agg(F.avg("r").alias("m"), F.max(F.when(C("symbol") == "click", C("r"))).alias("ra")).dropna()
    rows = basket.select(F.lit("click").alias("symbol"), "ts_ns", F.lit(0).cast("long").alias("seq"), F.create_map(F.lit(0), C("ra")).alias("values"), F.create_map(F.lit(0), F.array(F.lit(1.0), C("m"))).alias("rows"))
    steps = filters.run_filter(rows, {"type": "time-varying-beta", "q_alpha": 1e-9, "q_beta": 1e-7, "r": 1.0})
    return out(steps.withColumns({"alpha": F.get("x", 0), "beta": F.get("x", 1)}), ROW, ("alpha", "beta", "ll"))


BETA_ROWS = "rt AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY ts_ns)) AS r FROM daily WHERE price > 0), pv AS (SELECT ts_ns, max(r) FILTER (WHERE symbol = 'click') AS y, avg(r) AS x FROM rt GROUP BY 1 HAVING max(r) FILTER (WHERE symbol = 'click') IS NOT NULL)"
BETA_SQL = PAIRS.replace(PV, BETA_ROWS).replace("1.0::DOUBLE AS paa", "0.0001::DOUBLE AS paa").replace("+ 100 AS s", "+ 1 AS s").replace("1e-6 *", "1e-9 *").replace("1e-8 *", "1e-7 *")
add("time_varying_beta", beta_query, sql(BETA_SQL, "kr WHERE NOT fresh", ("'click' AS symbol", "ts_ns", "0::BIGINT AS seq"), {"alpha": "a", "beta": "b", "ll": "ll"}, True))


def volatility_query(spark: SparkSession, sf: str) -> DataFrame:
    r = ln(ratio(C("price"), F.lag("price").over(views.ordered())))
    rows = views.user_ticks(spark, sf).withColumn("r", r).dropna().withColumn("values", F.create_map(F.lit(0), F.log(C("r") * C("r") + 1e-12) + models.LOG_CHI_SHIFT))
    steps = filters.run_filter(rows, {"type": "stochastic-volatility", "mu": 0.5, "phi": 0.98, "sigma": 0.15, "interval": 3600.0})
    return out(steps.withColumn("volatility", F.exp(F.get("x", 0) / 2)), ROW, ("volatility", "ll"))


REST = 0.15**2 / (1 - 0.98**2)
LOG_SQUARES = f"{USERS}, sq AS (SELECT symbol, ts_ns, seq, rn AS own, ln(power(CASE WHEN price > 0 AND before > 0 THEN ln(CASE WHEN price > 0 THEN price END / CASE WHEN before > 0 THEN before END) END, 2) + 1e-12) + {models.LOG_CHI_SHIFT} AS price FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY rn) AS before FROM users)), obs AS (SELECT symbol, ts_ns, seq, price, row_number() OVER (PARTITION BY symbol ORDER BY own) AS rn FROM sq WHERE price IS NOT NULL)"
VOLATILITY_SQL = scalar_sql("obs", "0.5", repr(REST), "pow(0.98::DOUBLE, t.dt / 3600)", f"{REST!r}::DOUBLE * (1 - pow(0.98::DOUBLE, t.dt / 1800))", "0.5::DOUBLE", repr(models.LOG_CHI_VARIANCE))
add("stochastic_volatility", volatility_query, sql(f"{LOG_SQUARES}, {VOLATILITY_SQL}", "obs t JOIN kr k ON k.symbol = t.symbol AND k.rn = t.rn", TROW, {"volatility": "exp(k.x / 2)", "ll": "k.ll"}, True))


def venues_query(spark: SparkSession, sf: str) -> DataFrame:
    channel = F.array_position(F.array(*map(F.lit, TYPES)), C("symbol")).cast("int") - 1
    rows = views.ticks(spark, sf).select(F.lit("all").alias("symbol"), "ts_ns", "seq", F.create_map(channel, C("price")).alias("values"))
    model = models.build({"type": "multi-venue", "sigma_a": 1e-5, "tau": 3600.0, "sigma": 5.0, "variances": [400.0] * 5, "first": 50.0, "velocity_std": 1e-3})
    steps = filter_long(rows, model)
    return out(steps.withColumn("price", F.get("x", 0)), ROW, ("price", "ll"))


add("multi_venue", venues_query)


def etf_query(spark: SparkSession, sf: str) -> DataFrame:
    names = ["click", "error", "view"]
    rows = views.daily(spark, sf).filter(C("symbol").isin(*names)).groupBy("ts_ns").pivot("symbol", names).agg(F.first("price")).dropna()
    fund = C("click") * 0.5 + C("error") * 0.3 + C("view") * 0.2
    ticks = rows.select(F.lit("etf").alias("symbol"), "ts_ns", F.lit(0).cast("long").alias("seq"), F.create_map(F.lit(0), C("click"), F.lit(1), C("error"), F.lit(2), C("view"), F.lit(3), fund + 1).alias("values"))
    config = {"type": "etf-basket", "weights": [0.5, 0.3, 0.2], "covariance": [[1e-3, 0, 0], [0, 1e-3, 0], [0, 0, 1e-3]], "sigma_v": [1e-6] * 3, "theta": 1e-5, "sigma_premium": 1e-3, "quote_variances": [100.0] * 3, "etf_variance": 25.0, "first": [50.0] * 3}
    steps = filters.run_filter(ticks, config)
    return out(steps.withColumns({"nav": F.get("x", 0) * 0.5 + F.get("x", 1) * 0.3 + F.get("x", 2) * 0.2, "premium": F.get("x", 6)}), ROW, ("nav", "premium", "ll"))


add("etf_basket", etf_query)


def microprice_query(spark: SparkSession, sf: str) -> DataFrame:
    q = views.quotes(spark, sf).filter("mid is not null")
    micro = (C("bid") * C("ask_size") + C("ask") * C("bid_size")) / (C("bid_size") + C("ask_size"))
    rows = q.withColumns({"values": F.create_map(F.lit(0), C("mid"), F.lit(1), micro), "variances": F.create_map(F.lit(1), 500.0 / (C("bid_size") + C("ask_size")))})
    steps = filters.run_filter(rows, {"type": "microprice", "sigma_a": 1e-5, "half_spread": 5.0, "tick": 0.01, "depth_scale": 500.0, "velocity_std": 1e-3, "first": 40.0})
    return out(steps.withColumn("price", F.get("x", 0)), ROW, ("price", "ll"))


add("microprice", microprice_query)
add("bid_ask_bounce", lambda s, d: out(filters.run_filter(views.kalman_ticks(s, d), {"type": "bid-ask-bounce", "sigma_a": 1e-5, "sigma_nu": 20.0, "rho": -0.4, "interval": 3600.0, "tick": 1.0}, start=start_at_first).withColumn("level", F.get("x", 0)), ROW, ("level", "ll")))


def curve_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.daily(spark, sf).groupBy("ts_ns").pivot("symbol", TYPES).agg(F.first("price")).dropna()
    values = F.create_map(*[x for k, t in enumerate(TYPES) for x in (F.lit(k), C(t) / 100)])
    ticks = rows.select(F.lit("curve").alias("symbol"), "ts_ns", F.lit(0).cast("long").alias("seq"), values.alias("values"))
    config = {"type": "nelson-siegel", "lam": 0.06, "maturities": [3, 12, 24, 60, 120], "theta": [1e-6, 2e-6, 4e-6], "mu": [0.5, 0.0, 0.0], "sigma": [1e-3, 1e-3, 2e-3], "variances": [0.04] * 5}
    return out(filters.run_filter(ticks, config).withColumns({"level": F.get("x", 0), "slope": F.get("x", 1), "curvature": F.get("x", 2)}), ROW, ("level", "slope", "curvature"))


add("nelson_siegel", curve_query)

# ---- smoothing, diagnostics, calibration

RTS = kalman_sql("1.0::DOUBLE") + f""", nx AS (SELECT *, (lead(ts_ns) OVER (PARTITION BY symbol ORDER BY rn) - ts_ns) / 1e9 AS dt, max(rn) OVER (PARTITION BY symbol) AS n FROM kr),
pr AS (SELECT *, x + dt * v AS x1, p00 + dt * (2 * p01 + dt * p11) + {SIGMA_A**2!r}::DOUBLE * dt * dt * dt / 3 AS a, p01 + dt * p11 + {SIGMA_A**2!r}::DOUBLE * dt * dt / 2 AS b, p11 + {SIGMA_A**2!r}::DOUBLE * dt AS c FROM nx),
gn AS (SELECT *, ((p00 + dt * p01) * c - p01 * b) / (a * c - b * b) AS g00, (p01 * a - (p00 + dt * p01) * b) / (a * c - b * b) AS g01, ((p01 + dt * p11) * c - p11 * b) / (a * c - b * b) AS g10, (p11 * a - (p01 + dt * p11) * b) / (a * c - b * b) AS g11 FROM pr),
sm AS (SELECT symbol, rn, x AS xs, v AS vs, p00 AS s00, p01 AS s01, p11 AS s11 FROM kr WHERE (symbol, rn) IN (SELECT symbol, max(rn) FROM kr GROUP BY 1)
UNION ALL SELECT g.symbol, g.rn, g.x + g00 * (xs - x1) + g01 * (vs - v), g.v + g10 * (xs - x1) + g11 * (vs - v), p00 + g00 * g00 * (s00 - a) + 2 * g00 * g01 * (s01 - b) + g01 * g01 * (s11 - c),
p01 + g00 * g10 * (s00 - a) + (g00 * g11 + g01 * g10) * (s01 - b) + g01 * g11 * (s11 - c), p11 + g10 * g10 * (s00 - a) + 2 * g10 * g11 * (s01 - b) + g11 * g11 * (s11 - c) FROM sm JOIN gn g ON g.symbol = sm.symbol AND g.rn = sm.rn - 1)"""
add("rts_smoother", lambda s, d: out(smoothing.smooth(llt_steps(s, d), LLT).withColumns({"level": F.get("xs", 0), "level_std": F.sqrt(F.get("ps", 0))}), ROW, ("level", "level_std"), 4), sql(RTS, "users t JOIN sm k ON k.symbol = t.symbol AND k.rn = t.rn", TROW, {"level": "k.xs", "level_std": "sqrt(k.s00)"}, True, 4))
BACKTEST = kalman_sql("CASE WHEN y * y / s > 4 THEN 0.0 ELSE 1.0 END") + ", f AS (SELECT symbol, count(*) AS steps, sum((w = 0)::INT) AS rejected, avg(y * y / s) FILTER (WHERE w > 0) AS nis, max_by(ll, rn) AS ll FROM kr GROUP BY 1)"
add(
    "backtest_report", lambda s, d: out(calibration.backtest_report(llt_steps(s, d, gate={"kind": "sigma", "k": 2.0})), ("symbol",), ("steps", "readings", "rejected", "mean_nis", "ll")),
    sql(BACKTEST, "f", ("symbol",), {"steps": "steps", "readings": "steps", "rejected": "rejected", "mean_nis": "nis", "ll": "ll"}, True),
)
LAGGED_RTS = RTS[: RTS.index("sm AS (")] + """sm AS (SELECT symbol, rn AS e, rn, x AS xs, v AS vs FROM kr UNION ALL SELECT g.symbol, sm.e, g.rn, g.x + g00 * (xs - x1) + g01 * (vs - v), g.v + g10 * (xs - x1) + g11 * (vs - v) FROM sm JOIN gn g ON g.symbol = sm.symbol AND g.rn = sm.rn - 1 AND sm.e - g.rn <= 5)"""
add("fixed_lag_smoother", lambda s, d: out(smoothing.smooth_lagged(llt_steps(s, d).drop("ll", "outcomes"), LLT, 5).withColumn("level", F.get("xs", 0)), ROW, ("level",), 4), sql(LAGGED_RTS, "users t LEFT JOIN sm k ON k.symbol = t.symbol AND k.rn = t.rn AND k.e = t.rn + 5", TROW, {"level": "k.xs"}, True, 4))
HEALTH = ("readings", "accepted", "rejected", "down_weighted", "mean_nis", "autocorrelation_1", "autocorrelation_2", "longest_rejection")
HEALTH_SQL = kalman_sql("CASE WHEN y * y / s > 4 THEN 0.0 ELSE 1.0 END") + ", iv AS (SELECT *, y * y / s AS nis, y / sqrt(s) AS z, avg(y / sqrt(s)) OVER (PARTITION BY symbol) AS mz FROM kr), lg AS (SELECT *, lag(z, 1) OVER (PARTITION BY symbol ORDER BY rn) - mz AS z1, lag(z, 2) OVER (PARTITION BY symbol ORDER BY rn) - mz AS z2, sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn) AS grp FROM iv), runs AS (SELECT symbol, max(n) AS n FROM (SELECT symbol, grp, count(*) AS n FROM lg WHERE w = 0 GROUP BY 1, 2) GROUP BY 1), f AS (SELECT symbol, count(*) AS readings, sum((w > 0)::INT) AS accepted, sum((w = 0)::INT) AS rejected, sum((w > 0 AND w < 1)::INT) AS down_weighted, avg(nis) AS mean_nis, sum((z - mz) * z1) / sum((z - mz) * (z - mz)) AS a1, sum((z - mz) * z2) / sum((z - mz) * (z - mz)) AS a2 FROM lg GROUP BY 1)"
add(
    "channel_health", lambda s, d: out(diagnostics.channel_health(diagnostics.innovations(llt_steps(s, d, gate={"kind": "sigma", "k": 2.0})), lags=2), ("symbol",), HEALTH),
    sql(HEALTH_SQL, "f LEFT JOIN runs USING (symbol)", ("symbol",), {"readings": "readings", "accepted": "accepted", "rejected": "rejected", "down_weighted": "down_weighted", "mean_nis": "mean_nis", "autocorrelation_1": "a1", "autocorrelation_2": "a2", "longest_rejection": "coalesce(runs.n, 0)"}, True),
)
CONSISTENT = kalman_sql("1.0::DOUBLE") + ", iv AS (SELECT *, y * y / s AS nis, y * y / s > 3.841458820694124 AS above FROM kr), g AS (SELECT *, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY rn) AS calm FROM iv), f AS (SELECT *, avg(nis) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rolling, sum(CASE WHEN above THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, calm ORDER BY rn) AS streak FROM g)"
add(
    "consistency_monitor", lambda s, d: out(diagnostics.consistency(llt_steps(s, d), 20, break_streak=2).withColumn("breaks", C("model_break").cast("int")), ROW, ("nis", "rolling_nis", "streak", "breaks")),
    sql(CONSISTENT, "users t JOIN f k ON k.symbol = t.symbol AND k.rn = t.rn", TROW, {"nis": "k.nis", "rolling_nis": "k.rolling", "streak": "k.streak", "breaks": "(k.above AND k.streak = 2)::INT"}, True),
)
SUGGEST = kalman_sql("1.0::DOUBLE") + f", f AS (SELECT *, avg(y * y) OVER w AS sq, avg(s) OVER w AS ms FROM kr WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
add("adaptive_noise", lambda s, d: out(diagnostics.suggested_noise(diagnostics.innovations(llt_steps(s, d)), HALF**2, 20), ROW, ("suggested_r", "q_scale")), sql(SUGGEST, "users t JOIN f k ON k.symbol = t.symbol AND k.rn = t.rn", TROW, {"suggested_r": f"greatest(k.sq - (k.ms - {HALF**2}), 1e-12)", "q_scale": "k.sq / k.ms"}, True))


def likelihood_query(spark: SparkSession, sf: str) -> DataFrame:
    found = calibration.log_likelihoods(views.kalman_ticks(spark, sf), LLT, calibration.Parameters({"half_spread": "log"}), [np.log([h]) for h in (10.0, 20.0, 40.0)])
    return spark.createDataFrame([(h, round(v, 3)) for h, v in zip((10.0, 20.0, 40.0), found, strict=True)], "half_spread double, ll double")


LIKELIHOODS = " UNION ALL ".join(f"(WITH RECURSIVE {kalman_sql('1.0::DOUBLE', half=h).replace(repr(HALF**2), repr(h**2))} SELECT {h}::DOUBLE AS half_spread, round(sum(ll), 3) AS ll FROM (SELECT max_by(ll, rn) AS ll FROM kr GROUP BY symbol))" for h in (10.0, 20.0, 40.0))
add("innovation_likelihood", likelihood_query, LIKELIHOODS)


def calibration_query(spark: SparkSession, sf: str) -> DataFrame:
    best, ll = calibration.calibrate(views.kalman_ticks(spark, sf), LLT, calibration.Parameters({"half_spread": "log"}))
    return spark.createDataFrame([(round(best["half_spread"], 3), round(ll, 2))], "half_spread double, ll double")


add("maximum_likelihood", calibration_query)
WALK = {"motion": {"type": "random-walk", "sigma": 0.05}, "rows": [{"0": 1.0}], "variances": [400.0], "p0_diag": [400.0]}
add("expectation_maximisation", lambda s, d: calibration.em_by_key(views.user_ticks(s, d), WALK).select("symbol", F.round(F.get("q", 0), 6).alias("q"), F.round(F.get("r", 0), 6).alias("r"), F.round("ll", 6).alias("ll")))


def codec_query(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks through JSON, then CSV, then binary frames, and back."""
    ticks = views.kalman_ticks(spark, sf).select("ts_ns", "values")
    lines = ticks.select(codecs.encode_json(ticks).alias("line"))
    back = codecs.decode_json(lines)
    back = codecs.decode_csv(back.select(codecs.encode_csv(1).alias("line")))
    back = codecs.decode_frames(codecs.encode_frames(back.select("ts_ns", "values")))
    return back.select("ts_ns", F.round(F.element_at("values", 0), 6).alias("price"))


add("codec_round_trip", codec_query, "SELECT epoch_us(ts) * 1000 AS ts_ns, round(value, 6) + 0.0 AS price FROM events")
add("latest_state", lambda s, d: out(codecs.latest_state(scan(views.user_ticks(s, d), lambda: trend_filters.TrendFilter(SIGMA_A, HALF, velocity_std=VSTD))), ("symbol", "ts_ns"), ("level", "ll")), sql(kalman_sql("1.0::DOUBLE") + ", lst AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) AS back FROM kr)", "lst WHERE back = 1", ("symbol", "ts_ns"), {"level": "x", "ll": "ll"}, True))


def stream_query(spark: SparkSession, sf: str) -> DataFrame:
    from tideline.streaming.run import final_states

    return final_states(spark, sf, LLT)


STREAMED = kalman_sql("1.0::DOUBLE", start="0") + ", f AS (SELECT symbol, max(ts_ns) AS ts_ns, round(max_by(x, rn), 6) AS level, round(max_by(ll, rn), 6) AS ll, count(*) AS steps FROM kr GROUP BY 1)"
add("stream_session", stream_query, f"WITH RECURSIVE {STREAMED} SELECT * FROM f")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
