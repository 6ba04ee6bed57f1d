"""The efficiency criterion for the tolerance r: relative error of the conditional probability.

After Lake, Richman, Griffin and Moorman, "Sample entropy analysis of neonatal heart rate variability"
(2002).  Three habits of the published counting are kept, as results depend on them: cells of lags past the
signal's end hold the run that was last there, a point's pairs with earlier ones leave out one more place
near the signal's start, and the last point's row stays empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators.entropy import tally
from undula.sources.signals import alike, packed

#: Points of signals that are worked off together.
CELLS = 1 << 15


def cp_and_sd(x: np.ndarray, m: int, r: float) -> tuple[float, float]:
    """Conditional probability of a match of length m + 1, and its deviation from overlapping pairs.

    NaN for both if the signal has fewer than 2 (m + 1) points, or no match of length m.
    """
    cp, sd = cp_and_sd_columns(np.asarray(x, float)[:, None], m, [r])
    return float(cp[0, 0]), float(sd[0, 0])


def cp_and_sd_columns(x: np.ndarray, m: int, rs: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """cp_and_sd of each column for each tolerance, as (tolerances, columns), lag by lag.

    Counts are of runs of near points of m and of m + 1; they are (tolerances, 2, points, columns).
    """
    n, columns = x.shape
    shape = (len(rs), 2, n, columns)
    if n < 2 * (m + 1):
        return np.full((2, len(rs), columns), np.nan)
    ahead, behind = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    more_ahead, more_behind = np.zeros(shape, np.uint8), np.zeros(shape, np.uint8)
    cells = np.zeros((2 * m, *shape), bool)  # the runs of short lags, by the earlier point
    for lag in range(1, n):
        size = n - lag
        with np.errstate(invalid="ignore"):
            gap = np.abs(x[lag:] - x[:-lag])
        runs = np.empty((len(rs), 2, size, columns), bool)
        for each, r in zip(runs, rs, strict=True):
            near = gap < r
            run = near.copy()
            for q in range(1, m + 1):
                if q == m:
                    each[0] = run
                run[q:] &= near[:-q]
                run[:q] = False
            each[1] = run
        more_ahead[:, :, :size] += runs.view(np.uint8)
        more_behind[:, :, lag:] += runs.view(np.uint8)
        if lag <= 2 * m:
            cells[lag - 1][:, :, :size] = runs
            cells[lag - 1][:, :, size:-1] = runs[:, :, -1:]
        if lag % 255 == 0 or lag == n - 1:
            tally(ahead, more_ahead)
            tally(behind, more_behind)
    either = ahead + behind
    a, b = ahead[:, 1].sum(1), behind[:, 0, :-1].sum(1)
    pairs = (either * (either - 1)).sum(2)
    inside, outside = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for d in range(m):
        for lag in (2 * d + 1, 2 * d + 2):
            inside[:, :, lag + 1 :] += cells[lag - 1][:, :, 1 : n - lag]
        outside += cells[2 * d]
        pairs += 2 * ((either - inside)[:, :, d + 1 :] * (either - outside)[:, :, : n - d - 1]).sum(2)
        outside += cells[2 * d + 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = a / b
        first, second = pairs[:, 0].astype(float), pairs[:, 1].astype(float)
        sd = np.sqrt(p * (1 - p) / b + np.maximum(0, (second - first * p * p) / (b.astype(float) * b)))
    return np.where(b > 0, p, np.nan), np.where(b > 0, sd, np.nan)


def cp_grid(signals: DataFrame, grid: dict[int, list[float]]) -> DataFrame:
    """(signal_id, m, r, cp, sd) for each signal, each m and its tolerances, from one pass over the signals.

    Signals of one length are worked off together, CELLS points at a time, or one by one.
    """

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("signal_id")
            for m, rs in grid.items():
                for rows, x in alike(part.column("values"), CELLS):
                    cp, sd = cp_and_sd_columns(x, m, rs)
                    places, r = np.tile(rows, len(rs)), np.repeat(np.array(rs, float), len(rows))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(places)), pa.array(np.full(len(r), m, np.int32)), pa.array(r), pa.array(cp.ravel()), pa.array(sd.ravel())], ["signal_id", "m", "r", "cp", "sd"])

    kind = signals.schema["signal_id"].dataType.simpleString()
    return packed(signals).mapInArrow(batches, f"signal_id {kind}, m int, r double, cp double, sd double")


def cp_table(signals: DataFrame, m: int, rs: list[float]) -> DataFrame:
    """(signal_id, r, cp, sd) for each signal and tolerance."""
    return cp_grid(signals, {m: rs}).drop("m")


def criterion(table: DataFrame) -> DataFrame:
    """Adds objective: the larger of sd / cp and its share of -ln cp; NaN where cp is 0 or NaN."""
    relative = F.try_divide("sd", "cp")
    share = F.when(F.col("cp") == 1, F.lit(0.0)).otherwise(F.try_divide(relative, -F.ln("cp")))
    usable = (F.col("cp") > 0) & ~F.isnan("cp") & ~F.isnan("sd")
    return table.withColumn("objective", F.when(usable, F.greatest(relative, share)).otherwise(F.lit(float("nan"))))


def nan_median(column: str) -> "Column":
    """The median; NaN if one of the values is."""
    return F.when(F.count_if(F.isnan(column) | F.col(column).isNull()) > 0, F.lit(float("nan"))).otherwise(F.percentile(column, 0.5))
