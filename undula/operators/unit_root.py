"""Unit-root tests and their correction for many signals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.sources.signals import dealt


#: Parts of the p-values' range in which ranks are counted.
PARTS = 256


def _fit(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    inverse = np.linalg.pinv(x.T @ x)
    beta = np.linalg.pinv(x) @ y
    return beta, float(((y - x @ beta) ** 2).sum()), inverse


def adf_pvalue(y: np.ndarray) -> float:
    """Augmented Dickey-Fuller p-value with a constant; lags by AIC; 1 for signals it can't judge."""
    y = np.asarray(y, float)
    n = len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0 or np.ptp(y) == 0:
        return 1.0
    d = np.diff(y)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(d))
        return d[rows], np.column_stack([y[rows], *[d[rows - k] for k in range(1, lags + 1)], np.ones(len(rows))])

    # lags are nested: one orthogonal basis has the residuals of all of them
    target, x = design(most, most)
    size = len(target)
    ordered = np.column_stack([x[:, -1], x[:, :-1]])  # the constant, the level, then lag by lag
    basis, upper = np.linalg.qr(ordered)
    if np.abs(np.diag(upper)).min() > 1e-9 * np.abs(np.diag(upper)).max():
        left = target @ target - np.cumsum((basis.T @ target) ** 2)[1:]
    else:  # columns that depend on one another, as of a line
        left = np.array([_fit(target, np.column_stack([x[:, : lags + 1], x[:, -1]]))[1] for lags in range(most + 1)])
    left = np.maximum(left, 1e-300)
    aic = size * (np.log(left / size) + math.log(2 * math.pi) + 1) + 2 * (np.arange(most + 1) + 2)
    best = (float(aic.min()), int(aic.argmin()))
    target, x = design(best[1], best[1])
    beta, left, inverse = _fit(target, x)
    room = len(target) - x.shape[1]
    if room <= 0:
        return 1.0
    t = beta[0] / max(math.sqrt(max(left / room * inverse[0, 0], 0.0)), 1e-300)
    # MacKinnon's (1994) response surface for one series with a constant.
    if t > 2.74:
        return 1.0
    if t < -18.83:
        return 0.0
    z = 2.1659 + 1.4412 * t + 0.038269 * t * t if t <= -1.61 else 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t**3
    return 0.5 * math.erfc(-z / math.sqrt(2))


def pvalues(signals: DataFrame) -> DataFrame:
    """(signal_id, pvalue) of the augmented Dickey-Fuller test, a signal in one task each."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values(["timestamp", "value"], kind="stable")
        return pd.DataFrame({"signal_id": ordered["signal_id"].iloc[:1], "pvalue": [adf_pvalue(ordered["value"].to_numpy())]})

    kind = signals.schema["signal_id"].dataType.simpleString()
    return dealt(signals.select("signal_id", "timestamp", "value"), "signal_id").groupBy("signal_id").applyInPandas(one, f"signal_id {kind}, pvalue double")


def holm_sidak(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(signal_id, pvalue, reject): the Holm-Sidak step-down over all signals.

    Levels rise with the rank, so equal p-values fail together if the first of them does: all below the
    least p-value that fails are rejected.  Ranks are counted within parts of the p-values' range, to which
    the counts of the parts below are added; only these, PARTS of them, come to the driver.  A NaN or null
    p-value fails.  `tests` is read several times: it should be a kept table.
    """
    p = F.coalesce("pvalue", F.lit(float("nan")))
    counts = tests.groupBy(p.alias("p")).agg(F.count("*").alias("n"))
    steps = counts.where(~F.isnan("p")).agg(F.percentile_approx("p", [(i + 1) / PARTS for i in range(PARTS - 1)], 10_000)).first()[0] or []
    bounds = sorted(set(steps))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col("p")))
    counts = counts.withColumn("part", part)
    sizes = {r.part: r.n for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    n = sum(sizes.values())
    if not n:
        return tests.select("signal_id", "pvalue", F.lit(False).alias("reject"))
    below, total = [], 0
    for k in range(len(bounds) + 1):
        below.append(total)
        total += sizes.get(k, 0)
    before = Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    rank = 1 + F.get(F.array(*map(F.lit, below)), F.col("part")) + F.coalesce(F.sum("n").over(before), F.lit(0))
    level = 1 - F.pow(F.lit(1 - alpha), 1 / (F.lit(n) - rank + 1).cast("double"))
    failed = counts.withColumn("level", level).where(F.col("p") > F.col("level")).agg(F.min("p").alias("p")).first().p
    reject = F.lit(True) if failed is None else p < F.lit(failed)
    return tests.select("signal_id", "pvalue", reject.alias("reject"))


def dickey_fuller(signals: DataFrame) -> DataFrame:
    """(signal_id, tstat) of the test without lags, from sums over each signal."""
    by_time = Window.partitionBy("signal_id").orderBy("timestamp", "value")
    pairs = signals.withColumn("x", F.lag("value").over(by_time)).withColumn("d", F.col("value") - F.col("x")).where("x IS NOT NULL")
    sums = pairs.groupBy("signal_id").agg(F.count("*").alias("n"), F.regr_slope("d", "x").alias("b"), F.regr_sxx("d", "x").alias("sxx"), F.regr_syy("d", "x").alias("syy"))
    return sums.select("signal_id", F.expr("CASE WHEN n > 2 AND sxx > 0 AND syy - b * b * sxx > 0 THEN b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) END").alias("tstat"))
