"""Gaussian-process detrending: kernels as joins, and the solver as a grouped kernel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.sources.signals import dealt

#: Points of a signal that a task can hold the kernel of, at most (128 MB).
MOST_POINTS = 4096
_SQUARED = "aggregate(zip_with(a.vector, b.vector, (x, y) -> (x - y) * (x - y)), 0D, (s, d) -> s + d)"
#: By name, what a scale is chosen by: of truth and prediction, the less the better.
ERRORS: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {
    "neg_mean_squared_error": lambda y, f: float(np.mean((y - f) ** 2)),
    "neg_root_mean_squared_error": lambda y, f: float(np.sqrt(np.mean((y - f) ** 2))),
    "neg_mean_absolute_error": lambda y, f: float(np.mean(np.abs(y - f))),
    "neg_median_absolute_error": lambda y, f: float(np.median(np.abs(y - f))),
    "neg_max_error": lambda y, f: float(np.max(np.abs(y - f))),
    "r2": lambda y, f: float(np.sum((y - f) ** 2) / max(np.sum((y - y.mean()) ** 2), 1e-300)),
}


def squared_distances(left: DataFrame, right: DataFrame, by: str = "group") -> DataFrame:
    """(by, i, j, d2) for tables (by, id, vector): each vector on the left with each of its group on the right.

    A group is what one kernel matrix is made of, such as one signal's points: the join is on its key.
    """
    a, b = left.alias("a"), right.alias("b")
    met = a.join(b, F.col(f"a.{by}") == F.col(f"b.{by}"))
    return met.select(F.col(f"a.{by}").alias(by), F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.expr(_SQUARED).alias("d2"))


def rbf(distances: DataFrame, scale: float) -> DataFrame:
    """Adds k = exp(-d2 / (2 scale^2))."""
    return distances.withColumn("k", F.exp(F.col("d2") / F.lit(-2.0 * scale * scale)))


def jitter(kernel: DataFrame, eps: float) -> DataFrame:
    """Adds eps to k on the diagonal."""
    return kernel.withColumn("k", F.col("k") + F.when(F.col("i") == F.col("j"), F.lit(eps)).otherwise(F.lit(0.0)))


def folds(signals: DataFrame, n_splits: int) -> DataFrame:
    """(signal_id, fold, train_end, test_end): expanding time-series folds; ValueError if a signal is too short."""
    sizes = signals.groupBy("signal_id").agg(F.count("*").alias("n"))
    if not sizes.where(F.col("n") < n_splits + 1).isEmpty():
        raise ValueError("a signal has fewer points than folds need")
    step = F.floor(F.col("n") / (n_splits + 1))
    rows = sizes.withColumn("step", step).select("signal_id", "n", "step", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    start = F.col("n") - (n_splits - F.col("fold")) * F.col("step")
    return rows.select("signal_id", "fold", start.cast("bigint").alias("train_end"), (start + F.col("step")).cast("bigint").alias("test_end"))


def kernel(x: np.ndarray, z: np.ndarray, scale: float) -> np.ndarray:
    """exp(-d2 / (2 scale^2)) of the rows of x and z."""
    x, z = (np.asarray(v, float).reshape(len(v), -1) for v in (x, z))
    return np.exp(-((x[:, None, :] - z[None, :, :]) ** 2).sum(2) / (2 * scale * scale))


def solve(lower: np.ndarray, y: np.ndarray, at_once: int = 64) -> np.ndarray:
    """(L L')^-1 y for a lower triangle L, by substitution there and back, some rows at once."""
    n, out = len(y), np.array(y, float)
    for i in range(0, n, at_once):
        some = slice(i, i + at_once)
        out[some] = np.linalg.solve(lower[some, some], out[some] - lower[some, :i] @ out[:i])
    for i in reversed(range(0, n, at_once)):
        some, rest = slice(i, i + at_once), slice(i + at_once, n)
        out[some] = np.linalg.solve(lower[some, some].T, out[some] - lower[rest, some].T @ out[rest])
    return out


def fit(x: np.ndarray, y: np.ndarray, scale: float, eps: float = 1e-6) -> np.ndarray:
    """The process's weights (K + eps I)^-1 y."""
    return solve(np.linalg.cholesky(kernel(x, x, scale) + eps * np.eye(len(y))), y)


def predict(x: np.ndarray, at: np.ndarray, scale: float, weights: np.ndarray) -> np.ndarray:
    """The process's mean at other places."""
    return kernel(at, x, scale) @ weights


class Process:
    """A signal's process at one length scale, over point numbers.

    The triangle of the first points' kernel is the head of that of all points: one factorisation serves
    all folds and the final fit.
    """

    def __init__(self, y: np.ndarray, scale: float, eps: float, centre: bool) -> None:
        t = np.arange(len(y), dtype=float)
        self.y, self.centre, self.kernel = y, centre, kernel(t, t, scale)
        self.lower = np.linalg.cholesky(self.kernel + eps * np.eye(len(y)))

    def predict(self, upto: int, rows: slice) -> np.ndarray:
        """The mean at `rows`, learned from the first `upto` points."""
        part = self.y[:upto]
        mean, spread = (part.mean(), part.std() or 1.0) if self.centre else (0.0, 1.0)
        return self.kernel[rows, :upto] @ solve(self.lower[:upto, :upto], (part - mean) / spread) * spread + mean

    def error(self, n_splits: int, scoring: str) -> float:
        """The mean error over expanding folds."""
        n = len(self.y)
        step = n // (n_splits + 1)
        return float(np.mean([ERRORS[scoring](self.y[s : s + step], self.predict(s, slice(s, s + step))) for s in range(n - n_splits * step, n, step)]))


def detrend_array(y: np.ndarray, scales: np.ndarray, n_splits: int, eps: float, centre: bool = False, scoring: str = "neg_mean_squared_error") -> tuple[np.ndarray, float]:
    """Residuals from the process with the best length scale by mean fold error, and that scale; the first of equals."""
    if len(y) < n_splits + 1:
        raise ValueError("a signal has fewer points than folds need")
    if len(y) > MOST_POINTS:
        raise ValueError(f"a signal has {len(y)} points; its process can be had for {MOST_POINTS} at most")
    best = None
    for scale in scales:
        process = Process(y, float(scale), eps, centre)
        error = process.error(n_splits, scoring)
        if best is None or error < best[0]:
            best = error, float(scale), process
    return y - best[2].predict(len(y), slice(0, len(y))), best[1]


def detrend_gp(signals: DataFrame, ls_range: tuple[float, float] = (10.0, 100.0), n_searches: int = 10, n_splits: int = 5, eps: float = 1e-6, seed: int | None = 0, shared: bool = True, scoring: str = "neg_mean_squared_error") -> DataFrame:
    """Residuals of each signal from a Gaussian process in its point number; times become 0, 1, 2, ...

    `n_searches` length scales are drawn evenly from `ls_range`: once for all signals, or, with shared=False,
    for each signal, whose values are then centred and scaled as well; the best by `scoring` over folds is
    taken.  One signal is one task's work; one of more than MOST_POINTS points is refused.
    """
    low, high = ls_range

    def one(part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values(["timestamp", "value"], kind="stable")
        key = [] if shared else [*str(ordered["signal_id"].iloc[0]).encode()]
        scales = np.random.default_rng([seed or 0, *key]).uniform(low, high, n_searches)
        left, _ = detrend_array(ordered["value"].to_numpy(float), scales, n_splits, eps, not shared, scoring)
        return pd.DataFrame({"signal_id": ordered["signal_id"].to_numpy(), "timestamp": np.arange(len(left), dtype=float), "value": left})

    kind = signals.schema["signal_id"].dataType.simpleString()
    return dealt(signals.select("signal_id", "timestamp", "value"), "signal_id").groupBy("signal_id").applyInPandas(one, f"signal_id {kind}, timestamp double, value double")
