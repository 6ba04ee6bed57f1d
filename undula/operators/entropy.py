"""Sample entropy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Templates of one block: a signal's blocks are joined pair by pair, so a task never meets all of a long signal.
BLOCK = 2048


def grid_counts(signals: DataFrame, grid: list[tuple[int, float]], by: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """(by, m, r, n_a, n_b) for each point (m, r) of the grid, from one join for all of them.

    n_a counts pairs of templates of length m + 1 that are nearer than r in each point, n_b those of length
    m; both are over templates that have an (m+1)th point.  Templates of one signal meet in a join on its
    key and a pair of its blocks, with the widest band of the grid as condition; pairs are streamed, never
    kept.  Signals without such a pair have counts of 0.
    """
    least, most, widest = min(m for m, _ in grid), max(m for m, _ in grid), max(r for _, r in grid)
    order = Window.partitionBy(*by).orderBy("timestamp", "value")
    points = signals.select(*by, "timestamp", "value").withColumn("i", F.row_number().over(order))
    for k in range(most + 1):
        points = points.withColumn(f"x{k}", F.lead("value", k).over(order) if k else F.col("value"))
    points = points.withColumn("block", F.floor((F.col("i") - 1) / BLOCK).cast("int")).where(F.col(f"x{least}").isNotNull())
    points = points.withColumn("top", F.max("block").over(Window.partitionBy(*by)))
    kept = [*by, "i", *[f"x{k}" for k in range(most + 1)]]
    a = points.select(*kept, F.col("block").alias("low"), F.explode(F.sequence("block", "top")).alias("high")).alias("a")
    b = points.select(*kept, F.explode(F.sequence(F.lit(0), "block")).alias("low"), F.col("block").alias("high")).alias("b")
    near = lambda k, r: F.abs(F.col(f"a.x{k}") - F.col(f"b.x{k}")) < F.lit(float(r))
    on = F.col("a.i") < F.col("b.i")
    for c in (*by, "low", "high"):
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    for k in range(least):
        on = on & near(k, widest)
    met, counted = a.join(b, on), []
    for n, (m, r) in enumerate(grid):
        like = F.col(f"b.x{m}").isNotNull()  # the later template ends in the signal, hence the earlier does
        for k in range(m):
            like = like & near(k, r)
        counted += [F.count_if(like & near(m, r)).alias(f"a{n}"), F.count_if(like).alias(f"b{n}")]
    counts = met.groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(*counted)
    every = signals.select(*by).distinct().join(counts, list(by), "left").fillna(0, [c for n in range(len(grid)) for c in (f"a{n}", f"b{n}")])
    rows = [F.struct(F.lit(m).alias("m"), F.lit(float(r)).alias("r"), F.col(f"a{n}").alias("n_a"), F.col(f"b{n}").alias("n_b")) for n, (m, r) in enumerate(grid)]
    return every.select(*by, F.inline(F.array(*rows)))


def grid_entropy(signals: DataFrame, grid: list[tuple[int, float]], by: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """(by, m, r, sampen): -ln(n_a / n_b), NaN without a match of length m + 1."""
    value = F.when(F.col("n_a") > 0, -F.ln(F.col("n_a") / F.col("n_b")) + F.lit(0.0)).otherwise(F.lit(float("nan")))
    return grid_counts(signals, grid, by).select(*by, "m", "r", value.alias("sampen"))


def match_counts(signals: DataFrame, m: int, r: float, by: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """(by, n_a, n_b) at one m and r."""
    return grid_counts(signals, [(m, r)], by).drop("m", "r")


def sample_entropy(signals: DataFrame, m: int, r: float, by: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """(by, sampen) at one m and r."""
    return grid_entropy(signals, [(m, r)], by).drop("m", "r")


def sampen_rows(x: np.ndarray, m: int, r: float) -> np.ndarray:
    """Sample entropy of each row of a table, lag by lag; for resampled signals."""
    n_a, n_b = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    n = x.shape[1] - m
    for lag in range(1, max(n, 1)):
        near = np.abs(x[:, lag:] - x[:, :-lag]) < r
        run = near[:, : n - lag].copy()
        for k in range(1, m):
            run &= near[:, k : n - lag + k]
        n_b += np.count_nonzero(run, axis=1)
        n_a += np.count_nonzero(run & near[:, m : n - lag + m], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n_a > 0, -np.log(n_a / n_b) + 0.0, np.nan)


def tally(total: np.ndarray, small: np.ndarray) -> None:
    """Add the bytes of `small` to `total`, and set them to 0; call it before a byte passes 255."""
    total += small
    small[:] = 0


class Ranked:
    """Signals of one length, as columns, by ranks: a tolerance is a range of ranks around each point.

    A point's neighbours are consecutive in order of value, as rounded differences ascend with the values, so
    comparing ranks, which are of one or two bytes mostly, is exact and takes no floats.
    """

    def __init__(self, x: np.ndarray) -> None:
        n = len(x)
        self.kind = np.uint8 if n < 256 else np.uint16 if n < 65536 else np.uint32
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted, self.place = np.take_along_axis(x, order, 0), np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(n)[:, None], 0)
        self.rank = self.place.astype(self.kind)

    def _before(self, holds) -> np.ndarray:
        """For each value in order, how many of its signal's `holds`, which are the first ones, by bisection."""
        low, high = np.zeros(self.sorted.shape, np.int64), np.full(self.sorted.shape, len(self.sorted))
        for _ in range(len(self.sorted).bit_length()):
            mid = (low + high) >> 1
            yes = holds(np.take_along_axis(self.sorted, np.minimum(mid, len(self.sorted) - 1), 0) - self.sorted) & (low < high)
            low, high = np.where(yes, mid + 1, low), np.where(yes, high, mid)
        return low

    def near(self, r: float) -> tuple[np.ndarray, np.ndarray]:
        """For each point the first rank that is nearer than r, and how many are."""
        with np.errstate(invalid="ignore"):
            low, high = self._before(lambda d: d <= -r), self._before(lambda d: d < r)
        return tuple(np.take_along_axis(v, self.place, 0).astype(self.kind) for v in (low, high - low))


def ranked_sampen(rank: np.ndarray, low: np.ndarray, wide: np.ndarray, m: int) -> np.ndarray:
    """Sample entropy of each column of ranks; points' neighbours are the `wide` ranks from `low`."""
    size = len(rank) - m
    short, full = np.zeros((2, max(size, 0), rank.shape[1]), np.uint8)
    n_b, n_a = np.zeros((2, *short.shape), np.int64) if size > 255 else (None, None)
    for lag in range(1, size):
        near = (rank[lag:] - low[:-lag]) < wide[:-lag]  # a rank below `low` wraps past `wide`
        run = near[: size - lag]
        for k in range(1, m):
            run = run & near[k : size - lag + k]
        short[: size - lag] += run.view(np.uint8)
        full[: size - lag] += (run & near[m : size - lag + m]).view(np.uint8)
        if n_b is not None and lag % 255 == 0:
            tally(n_b, short)
            tally(n_a, full)
    b, a = (small.sum(0, dtype=np.int64) + (0 if wider is None else wider.sum(0)) for small, wider in ((short, n_b), (full, n_a)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(a > 0, -np.log(a / b) + 0.0, np.nan)


def sampen_array(x: np.ndarray, m: int, r: float) -> float:
    """Sample entropy of one array."""
    return float(sampen_rows(np.asarray(x, float)[None], m, r)[0])
