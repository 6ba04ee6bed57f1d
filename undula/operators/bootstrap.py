"""The stationary bootstrap, step by step, and what it says of sample entropy.

Draws are keyed by seed, signal, replicate and step alone.  The built-in form resamples once for all points
of a grid; the grouped form works off many trials, each with its own block length, in one pass over the
signals.  Both make the same replicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.draws import many, uniform
from undula.operators.entropy import Ranked, grid_entropy, ranked_sampen
from undula.operators.transforms import by_time
from undula.sources.signals import alike, packed

#: Points of replicates that the grouped form makes at once, and replicates of a signal that are best made so.
CELLS, LEAST = 1 << 18, 64


def indices(signals: DataFrame, p: float, reps: int, seed: int) -> DataFrame:
    """(signal_id, rep, k, idx): step k of replicate rep takes the signal's point idx.

    A step starts a new block with probability p, at a uniform place; else it follows on, around the end.
    """
    sizes = signals.groupBy("signal_id").agg(F.count("*").alias("n"))
    steps = sizes.select("signal_id", "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select("signal_id", "n", "rep", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
    key = (F.lit(str(seed)), F.col("signal_id").cast("string"), F.col("rep").cast("string"), F.col("k").cast("string"))
    steps = steps.withColumn("new", ((F.col("k") == 0) | (uniform(*key, 1) < p)).cast("int")).withColumn("u", uniform(*key, 2))
    row = Window.partitionBy("signal_id", "rep").orderBy("k")
    steps = steps.withColumn("start", F.when(F.col("new") == 1, F.floor(F.col("u") * F.col("n")) - F.col("k")))
    # the last block start so far, less its step, is what a step's index lies behind its number
    return steps.withColumn("offset", F.last("start", True).over(row)).select("signal_id", "rep", "k", F.pmod(F.col("offset") + F.col("k"), "n").cast("bigint").alias("idx"))


def resample(signals: DataFrame, p: float, reps: int, seed: int) -> DataFrame:
    """(signal_id, rep, timestamp, value): the replicates, in order of timestamp 0, 1, 2, ..."""
    points = signals.select("signal_id", (F.row_number().over(by_time()) - 1).cast("bigint").alias("idx"), "value")
    return indices(signals, p, reps, seed).join(points, ["signal_id", "idx"]).select("signal_id", "rep", F.col("k").cast("double").alias("timestamp"), "value")


def grid_replicates(signals: DataFrame, grid: list[tuple[int, float]], p: float, reps: int, seed: int) -> DataFrame:
    """(signal_id, rep, m, r, sampen): one resampling and one join for the whole grid."""
    return grid_entropy(resample(signals, p, reps, seed), grid, ("signal_id", "rep"))


def standard_error(signals: DataFrame, m: int, r: float, p: float, reps: int, seed: int) -> DataFrame:
    """(signal_id, se_sampen): the population deviation over replicates; NaN if one of them is NaN."""
    return grid_replicates(signals, [(m, r)], p, reps, seed).groupBy("signal_id").agg(F.stddev_pop("sampen").alias("se_sampen"))


def mean_squared_error(signals: DataFrame, m: int, r: float, p: float, reps: int, seed: int) -> DataFrame:
    """(signal_id, mse): the mean squared distance of replicates from the signal's own entropy."""
    own = grid_entropy(signals, [(m, r)])
    return spread(grid_replicates(signals, [(m, r)], p, reps, seed), own, ("m", "r")).select("signal_id", "mse")


def spread(replicates: DataFrame, own: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(signal_id, by, sampen, se_sampen, mse): what replicates' entropies say of the signals' own; NaN if one is NaN."""
    own = own.select("signal_id", *by, F.col("sampen").alias("own"))
    met = replicates.join(own, ["signal_id", *by])
    return met.groupBy("signal_id", *by).agg(F.first("own").alias("sampen"), F.stddev_pop("sampen").alias("se_sampen"), F.avg(F.pow(F.col("sampen") - F.col("own"), 2)).alias("mse"))


def _draws(name: str, reps: Iterable[int], n: int, seed: int) -> np.ndarray:
    """The uniform numbers of `indices`: (reps, n, 2)."""
    text = (f"{seed}:{name}:{rep}:{k}:{which}".encode() for rep in reps for k in range(n) for which in (1, 2))
    return np.array([int(hashlib.md5(t).hexdigest()[:8], 16) for t in text], float).reshape(-1, n, 2) / 4294967296.0


def index_rows(draws: np.ndarray, p: float) -> np.ndarray:
    """`indices` as an array (reps, n), from the uniform numbers."""
    return index_columns(*np.moveaxis(draws, (2, 1), (0, 1)), p).T


def index_columns(new: np.ndarray, at: np.ndarray, p: float) -> np.ndarray:
    """`indices` step by step: from uniform numbers (n, ...) those of the same shape."""
    n, k = len(new), np.arange(len(new)).reshape(-1, *[1] * (new.ndim - 1))
    begun = np.where((new < p) | (k == 0), (k << 32) | np.floor(at * n).astype(np.int64), 0)
    begun = np.maximum.accumulate(begun, 0)  # by step first: the last block's, and where it starts
    idx = (begun & 0xFFFFFFFF) + k - (begun >> 32)
    return np.where(idx >= n, idx - n, idx)


def _entropies(names: list[bytes], x: np.ndarray, trials: list[tuple[int, int, float, float]], reps: int) -> np.ndarray:
    """(trials, signals, 1 + reps): the own entropies and the replicates' of signals of one length, the columns of x.

    Names are of one length, and have the seed before them.  Replicates are made CELLS points at a time, or one by one.
    """
    n, signals = x.shape
    found = np.full((len(trials), signals, 1 + reps), np.nan)
    if n == 0:
        return found
    ranked = Ranked(x)
    near = {r: ranked.near(r) for r in {r for _, _, r, _ in trials}}
    for i, (_, m, r, _) in enumerate(trials):
        found[i, :, 0] = ranked_sampen(ranked.rank, *near[r], m)
    some = max(1, CELLS // (n * signals))
    for first in range(0, reps, some):
        mine = range(first, min(reps, first + some))
        new, at = many(names, mine, n)
        for p in dict.fromkeys(p for _, _, _, p in trials):
            cells = (index_columns(new, at, p) * signals + np.arange(signals)[:, None]).reshape(n, -1)
            rank, those = ranked.rank.ravel()[cells], [i for i, t in enumerate(trials) if t[3] == p]
            for r in dict.fromkeys(trials[i][2] for i in those):
                low, wide = (v.ravel()[cells] for v in near[r])
                for i in those:
                    if trials[i][2] == r:
                        found[i, :, 1 + first : 1 + mine.stop] = ranked_sampen(rank, low, wide, trials[i][1]).reshape(signals, -1)
    return found


def _over_signals(rows: DataFrame, trials: list[tuple[int, int, float, float]], reps: int, seed: int, shown: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """For packed signals (signal_id, values): signal_id, trial and what `shown` makes of entropies (trials, signals, 1 + reps)."""
    kind = rows.schema["signal_id"].dataType.simpleString()
    numbers = np.array([t[0] for t in trials], np.int32)

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, values, names = part.column("signal_id"), part.column("values"), part.column("name").to_pylist()
            keys = [f"{seed}:{name}".encode() if name is not None else str(seed).encode() for name in names]
            size = np.array([len(k) for k in keys])
            for mine, x in alike(values, max(1, CELLS // (1 + min(reps, LEAST)))):
                for long in np.unique(size[mine]):
                    those = np.flatnonzero(size[mine] == long)
                    found = _entropies([keys[i] for i in mine[those]], x[:, those], trials, reps)
                    columns = shown(found)
                    each = next(iter(columns.values())).size // (len(trials) * len(those))
                    places = np.tile(np.repeat(mine[those], each), len(trials))
                    trial = np.repeat(numbers, each * len(those))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(places)), pa.array(trial), *[pa.array(v.ravel()) for v in columns.values()]], ["signal_id", "trial", *columns])

    named = rows.select("signal_id", F.col("signal_id").cast("string").alias("name"), "values")
    return named.mapInArrow(batches, f"signal_id {kind}, trial int, {schema}")


def trial_replicates(signals: DataFrame, trials: list[tuple[int, int, float, float]], reps: int, seed: int) -> DataFrame:
    """(signal_id, trial, rep, sampen) for trials (number, m, r, p); rep is -1 for the signal's own entropy."""

    def shown(found: np.ndarray) -> dict[str, np.ndarray]:
        return {"rep": np.broadcast_to(np.arange(-1, reps, dtype=np.int32), found.shape).copy(), "sampen": found}

    return _over_signals(packed(signals), trials, reps, seed, shown, "rep int, sampen double")


def trial_spread(rows: DataFrame, trials: list[tuple[int, int, float, float]], reps: int, seed: int) -> DataFrame:
    """(signal_id, trial, sampen, se_sampen, mse) as `spread` has them, for packed signals and trials (number, m, r, p).

    A signal's replicates for all trials are one task's work, with the same draws, so only what they say of the
    signal leaves the task.
    """

    def shown(found: np.ndarray) -> dict[str, np.ndarray]:
        own, made = found[..., 0], found[..., 1:]
        return {"sampen": own, "se_sampen": (made - made[..., :1]).std(-1), "mse": ((made - own[..., None]) ** 2).mean(-1)}

    return _over_signals(rows, trials, reps, seed, shown, "sampen double, se_sampen double, mse double")
