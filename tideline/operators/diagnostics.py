"""Health of a filter from its innovations, as windows and aggregates; and noise that adapts to them."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.filters import KalmanFilter
from tideline.operators.linalg import chi2_quantile
from tideline.plans.frames import KEYS, ORDER

C = F.col


def innovations(steps: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """One row per reading: keys, order, channel, y, s, w, nis, standardised."""
    names = dict.fromkeys([*keys, *order])
    rows = steps.select(*names, F.explode("outcomes").alias("o")).select(*names, "o.*")
    return rows.withColumns({"nis": C("y") * C("y") / C("s"), "standardised": C("y") / F.sqrt("s")})


def channel_health(rows: DataFrame, window: int = 200, lags: int = 10, keys=KEYS, order=ORDER) -> DataFrame:
    """Per key and channel: readings, accepted, rejected, down-weighted, mean nis, longest run of rejections, and the autocorrelation of
    standardised innovations at each lag with its band."""
    by = [*keys, "channel"]
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumns({f"__l{k}": F.lag("standardised", k).over(w) for k in range(1, lags + 1)})
    rows = rows.withColumn("__run", F.sum(F.when(C("w") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.filter("w = 0").groupBy(*by, "__run").count().groupBy(*by).agg(F.max("count").alias("longest_rejection"))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("readings"), F.sum((C("w") > 0).cast("long")).alias("accepted"), F.sum((C("w") == 0).cast("long")).alias("rejected"),
        F.sum(((C("w") > 0) & (C("w") < 1)).cast("long")).alias("down_weighted"), F.avg("nis").alias("mean_nis"), F.avg("standardised").alias("__m"),
        F.sum(C("standardised") * C("standardised")).alias("__q"), F.sum("standardised").alias("__s"),
        *[F.sum(C("standardised") * C(f"__l{k}")).alias(f"__c{k}") for k in range(1, lags + 1)],
        *[F.sum(F.when(C(f"__l{k}").isNotNull(), C("standardised") + C(f"__l{k}"))).alias(f"__b{k}") for k in range(1, lags + 1)],
    )
    spread = C("__q") - C("readings") * C("__m") * C("__m")
    for k in range(1, lags + 1):
        covariance = C(f"__c{k}") - C("__m") * C(f"__b{k}") + (C("readings") - k) * C("__m") * C("__m")
        sums = sums.withColumn(f"autocorrelation_{k}", F.when((spread > 0) & (C("readings") > k), covariance / F.when(spread > 0, spread)))
    sums = sums.withColumn("band", 1.96 / F.sqrt("readings"))
    return sums.join(runs, by, "left").withColumn("longest_rejection", F.coalesce("longest_rejection", F.lit(0))).drop(*[c for c in sums.columns if c.startswith("__")])


def consistency(steps: DataFrame, window: int = 200, confidence: float = 0.95, break_streak: int = 5, keys=KEYS, order=ORDER) -> DataFrame:
    """Per step: nis and readings, rolling nis per reading, whether it is above what chance allows, and whether the model breaks here,
    the moment that ``break_streak`` steps in a row are each above their bound."""
    names = list(dict.fromkeys([*keys, *order]))
    accepted = F.filter("outcomes", lambda o: o["w"] > 0)
    rows = steps.select(*names, F.aggregate(accepted, F.lit(0.0), lambda a, o: a + o["y"] * o["y"] / o["s"]).alias("nis"), F.size(accepted).alias("dof"), F.aggregate("outcomes", F.lit(0.0), lambda a, o: a + o["y"] * o["y"] / o["s"]).alias("__all"), F.size("outcomes").alias("__n"))
    w = Window.partitionBy(*keys).orderBy(*order)
    own = w.rowsBetween(1 - window, 0)
    total = F.sum("dof").over(own)
    rows = rows.withColumn("rolling_nis", F.when(total > 0, F.sum("nis").over(own) / F.when(total > 0, total)))
    # The upper bound of a mean over n readings, by the normal limit for large n.
    rows = rows.withColumn("over_confident", (total >= window) & (C("rolling_nis") > 1 + 1.96 * sqrt(2 / window)))
    bounds = F.array(*[F.lit(chi2_quantile(confidence, d)) for d in range(1, 33)])
    rows = rows.withColumn("__above", F.when(C("__n") > 0, C("__all") > F.get(bounds, F.least(C("__n"), F.lit(32)) - 1)))
    rows = rows.withColumn("__calm", F.sum(F.when(C("__above"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.when(C("__above"), 1).otherwise(0)).over(Window.partitionBy(*keys, "__calm").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("streak", streak)
    return rows.withColumn("model_break", C("__above") & (C("streak") == break_streak)).drop("__above", "__calm", "__all", "__n")


def suggested_noise(rows: DataFrame, variance: float, window: int = 200, floor: float = 1e-12, keys=KEYS, order=ORDER) -> DataFrame:
    """Innovations with the reading variance and the factor for Q that the last accepted ones ask for."""
    w = Window.partitionBy(*keys, "channel").orderBy(*order).rowsBetween(1 - window, 0)
    rows = rows.filter("w > 0")
    square, predicted = F.avg(C("y") * C("y")).over(w), F.avg("s").over(w)
    return rows.withColumns({"suggested_r": F.greatest(square - (predicted - variance), F.lit(floor)), "q_scale": F.when(predicted > 0, square / F.when(predicted > 0, predicted))})


class SageHusa:
    """Recursive estimates of reading variances and of Q's factor, with forgetting b."""

    def __init__(self, variances: list[float], b: float = 0.98, floor: float = 1e-12):
        self.r, self.b, self.floor, self.k, self.n, self.q_scale = list(variances), b, floor, [0] * len(variances), 0, 1.0

    def record(self, outcomes: list[tuple[int, float, float, float]], variances: list[float]) -> None:
        for c, y, s, w in outcomes:
            if w <= 0:
                continue
            self.k[c] += 1
            d = (1 - self.b) / (1 - self.b ** self.k[c])
            self.r[c] = max(self.floor, (1 - d) * self.r[c] + d * (y * y - (s - variances[c])))
            self.n += 1
            d = (1 - self.b) / (1 - self.b**self.n)
            self.q_scale = (1 - d) * self.q_scale + d * y * y / s


class AdaptiveNoise:
    """Writes estimates back into a filter, damped, after a warm-up, Q's factor within limits."""

    def __init__(self, kalman: KalmanFilter, estimator: SageHusa, damping: float = 0.1, warm_up: int = 20, limits: tuple[float, float] = (0.1, 10.0)):
        self.kalman, self.estimator, self.damping, self.warm_up, self.limits, self.factor = kalman, estimator, damping, warm_up, limits, 1.0

    def step(self, ts_ns: int, values: dict[int, float]) -> list[tuple[int, float, float, float]]:
        out = self.kalman.step(ts_ns, values)
        held = self.kalman.observation.variances
        self.estimator.record(out, held)
        for c, _, _, w in out:
            if w > 0 and self.estimator.k[c] > self.warm_up:
                held[c] += self.damping * (self.estimator.r[c] - held[c])
        if self.estimator.n > self.warm_up and hasattr(self.kalman.motion, "factor"):
            aim = min(max(self.kalman.motion.factor * self.estimator.q_scale, self.limits[0]), self.limits[1])
            self.kalman.motion.factor += self.damping * (aim - self.kalman.motion.factor)
            self.kalman.known.clear()
        return out
