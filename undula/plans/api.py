"""The three analyses as classes: stationary signals, sample entropy with its parameter search, and r by efficiency."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.operators import bootstrap, efficiency, entropy, gaussian, objectives, transforms, unit_root
from undula.sources import signals as source


class SampEnSettingWarning(UserWarning):
    """A setting that makes results unreliable."""


class OptimizationFailureWarning(UserWarning):
    """No trial of a search had a usable value."""


def _whole(value: object, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def _require(good: bool, message: str) -> None:
    if not good:
        raise ValueError(message)


def _names(*names: object) -> None:
    _require(all(isinstance(n, str) for n in names), "names of columns are strings")


class StationarySignals:
    """Differences or detrends signals and keeps those that reject a unit root.

    gp_implementation "numba" (or "shared") draws length scales once for all signals; "sklearn" (or
    "per_signal") draws ten for each, centres and scales values, and uses five folds and a jitter of 1e-10.
    sklearn_scoring is what the latter chooses a scale by, one of gaussian.ERRORS.
    """

    def __init__(
        self,
        df: DataFrame,
        signal_id: str = "signal_id",
        timestamp: str = "timestamp",
        value_col: str = "value",
        method: str = "difference",
        detrend_type: str = "gp",
        alpha: float = 0.05,
        random_seed: int | None = None,
        ls_range: tuple[float, float] = (10.0, 100.0),
        n_searches: int = 10,
        n_splits: int = 5,
        eps: float = 1e-6,
        gp_implementation: str = "numba",
        sklearn_scoring: str = "neg_mean_squared_error",
        normalize_signals: bool = True,
    ):
        _names(signal_id, timestamp, value_col)
        _require(method in ("difference", "detrend"), "method must be difference or detrend")
        _require(detrend_type in ("lr", "gp"), "detrend_type must be lr or gp")
        _require(gp_implementation in ("numba", "sklearn", "shared", "per_signal"), "unknown gp_implementation")
        _require(sklearn_scoring in gaussian.ERRORS, f"sklearn_scoring must be one of {sorted(gaussian.ERRORS)}")
        _require(0 < alpha < 1, "alpha must lie in (0, 1)")
        _require(len(ls_range) == 2 and 0 < ls_range[0] < ls_range[1], "ls_range must ascend from above 0")
        _require(_whole(n_searches, 1) and _whole(n_splits, 1), "n_searches and n_splits must be positive integers")
        _require(random_seed is None or _whole(random_seed, -math.inf), "random_seed must be an integer or None")
        _require(eps >= 0, "eps must be 0 or more")
        self.signals = source.validate(df, signal_id, timestamp, value_col)
        self.signal_id, self.timestamp, self.value_col = signal_id, timestamp, value_col
        self.method, self.detrend_type, self.alpha, self.random_seed = method, detrend_type, alpha, random_seed
        self.ls_range, self.n_searches, self.n_splits, self.eps = ls_range, n_searches, n_splits, eps
        self.gp_implementation, self.sklearn_scoring, self.normalize_signals = gp_implementation, sklearn_scoring, normalize_signals
        self.stationary_frac_: float | None = None
        self.stationary_signals_: DataFrame | None = None
        self.tests_: DataFrame | None = None
        self._held: DataFrame | None = None

    def _detrended(self) -> DataFrame:
        if self.method == "difference":
            return transforms.difference(self.signals)
        if self.detrend_type == "lr":
            return transforms.detrend_linear(self.signals)
        seed = abs(self.random_seed or 0)
        if self.gp_implementation in ("numba", "shared"):
            return gaussian.detrend_gp(self.signals, self.ls_range, self.n_searches, self.n_splits, self.eps, seed)
        return gaussian.detrend_gp(self.signals, self.ls_range, 10, 5, 1e-10, seed, shared=False, scoring=self.sklearn_scoring)

    def make_stationary_signals(self) -> DataFrame:
        """The kept signals; stationary_frac_, stationary_signals_ (their ids) and tests_ (signal_id, pvalue, reject) tell of all.

        One p-value for each signal is held in the cluster's memory or disks until release().
        """
        self.release()
        out = self._detrended()
        self._held = unit_root.pvalues(out).persist()
        self.tests_ = unit_root.holm_sidak(self._held, self.alpha)
        self.stationary_frac_ = self.tests_.agg(F.avg(F.col("reject").cast("double"))).first()[0]
        kept = self.tests_.where("reject").select("signal_id")
        self.stationary_signals_ = kept.withColumnRenamed("signal_id", self.signal_id)
        out = out.join(kept, "signal_id", "left_semi")
        out = transforms.normalise(out) if self.normalize_signals else out
        return out.select(F.col("signal_id").alias(self.signal_id), F.col("timestamp").alias(self.timestamp), F.col("value").alias(self.value_col))

    def release(self) -> None:
        """Give up the p-values that are held; results that are yet to be computed find them anew."""
        if self._held is not None:
            self._held.unpersist()
            self._held = None


@dataclass
class Trial:
    """One trial of a search."""

    number: int
    m: int
    r: float
    p: float
    value: float

    @property
    def state(self) -> str:
        return "FAIL" if math.isnan(self.value) else "COMPLETE"


class SampleEntropy:
    """Sample entropy of each signal, at given parameters or at those that a search finds.

    Trials are proposed `batch` at a time, and a batch is one job over all signals; 1 proposes each trial
    from all before it.
    """

    def __init__(
        self,
        df: DataFrame,
        signal_id: str = "signal_id",
        timestamp: str = "timestamp",
        value_col: str = "value",
        objective: str = "mse",
        n_boot: int = 100,
        n_trials: int = 100,
        random_seed: int | None = None,
        r_range: tuple[float, float] = (0.10, 0.50),
        m_range: tuple[int, int] = (1, 3),
        p_range: tuple[float, float] = (0.01, 0.99),
        lam: float = 0.33,
        r: float | None = None,
        m: int | None = None,
        p: float | None = None,
        batch: int = 10,
    ):
        _names(signal_id, timestamp, value_col)
        _require(objective in ("mse", "sampen_eff"), "objective must be mse or sampen_eff")
        for pair in (m_range, r_range, p_range):
            _require(len(pair) == 2 and pair[1] > pair[0], "ranges ascend")
        _require(all(_whole(x, -math.inf) for x in m_range), "m_range is of whole numbers")
        _require(r_range[0] > 0 and 0 < p_range[0] and p_range[1] < 1, "r_range lies above 0, p_range in (0, 1)")
        _require(m is None or _whole(m, 1), "m must be a positive integer")
        _require(r is None or r > 0, "r must be above 0")
        _require(p is None or isinstance(p, float) and 0 < p < 1, "p must be a float in (0, 1)")
        _require(lam >= 0, "lam must be 0 or more")
        _require(_whole(n_boot, 1) and _whole(n_trials, 1) and _whole(batch, 1), "n_boot, n_trials and batch must be positive integers")
        _require(random_seed is None or _whole(random_seed, 0), "random_seed must be an integer of 0 or more")
        outside = any(v is not None and not a < v < b for v, (a, b) in ((r, r_range), (p, p_range)))
        if n_boot < 50 or n_trials < 10 or outside:
            warnings.warn("few replicates or trials, or a fixed parameter outside its range", SampEnSettingWarning, stacklevel=2)
        self.signals = source.validate(df, signal_id, timestamp, value_col)
        _require(m_range[1] <= source.shortest(self.signals), "m_range passes the shortest signal")
        self.signal_id, self.timestamp, self.value_col, self.objective = signal_id, timestamp, value_col, objective
        self.n_boot, self.n_trials, self.random_seed, self.batch = n_boot, n_trials, random_seed, batch
        self.r_range, self.m_range, self.p_range, self.lam = r_range, m_range, p_range, lam
        self.r, self.m, self.p = r, m, p
        self.m_star_, self.r_star_, self.p_star_ = m, r, p
        self.trials_: list[Trial] = []

    @property
    def _seed(self) -> int:
        return self.random_seed or 0

    def evaluate(self, points: list[tuple[int, float, float]], rows: DataFrame | None = None) -> DataFrame:
        """(trial, value): the objective at points (m, r, p), numbered from 0; one job for all.

        rows: the signals as source.packed has them, if they are at hand.
        """
        rows = source.packed(self.signals) if rows is None else rows
        spread = bootstrap.trial_spread(rows, [(i, *point) for i, point in enumerate(points)], self.n_boot, self._seed)
        if self.objective == "sampen_eff":
            return objectives.efficiency_objective(spread, ("trial",))
        rs = F.get(F.array(*[F.lit(float(r)) for _, r, _ in points]), F.col("trial"))
        return objectives.mse_objective(spread.withColumn("r", rs), ("trial", "r"), self.lam).drop("r")

    def evaluate_grid(self, grid: list[tuple[int, float]], p: float) -> DataFrame:
        """(m, r, value): the objective at points that share p, all of it in built-in expressions."""
        own = entropy.grid_entropy(self.signals, grid)
        spread = bootstrap.spread(bootstrap.grid_replicates(self.signals, grid, p, self.n_boot, self._seed), own, ("m", "r"))
        return objectives.efficiency_objective(spread, ("m", "r")) if self.objective == "sampen_eff" else objectives.mse_objective(spread, ("m", "r"), self.lam)

    def _propose(self, rng: np.random.Generator, number: int) -> tuple[int, float, float]:
        """Ten random points, then the candidate that good trials' densities favour most over bad ones'."""
        (m0, m1), (r0, r1), (p0, p1) = self.m_range, self.r_range, self.p_range
        draw = lambda: (int(rng.integers(m0, m1 + 1)), float(rng.uniform(r0, r1)), float(rng.uniform(p0, p1)))
        done = sorted((t for t in self.trials_ if t.state == "COMPLETE"), key=lambda t: t.value)
        if number < 10 or len(done) < 4:
            point = draw()
        else:
            cut = max(1, math.ceil(0.1 * len(done)))
            width = np.array([1.0, (r1 - r0) / 5, (p1 - p0) / 5])
            near = lambda c, some: np.mean([np.exp(-0.5 * (((np.array(c) - (t.m, t.r, t.p)) / width) ** 2).sum()) for t in some]) + 1e-12
            point = max((draw() for _ in range(24)), key=lambda c: near(c, done[:cut]) / near(c, done[cut:]))
        return tuple(f if f is not None else v for f, v in zip((self.m, self.r, self.p), point, strict=True))

    def find_optimal_sampen_params(self) -> tuple[float, float, float]:
        """Minimise the objective over n_trials seeded trials; NaN for all three, with a warning, if all fail."""
        rng = np.random.default_rng(self._seed)
        self.trials_ = []
        rows = source.packed(self.signals).persist()
        try:
            while (first := len(self.trials_)) < self.n_trials:
                points = [self._propose(rng, first + i) for i in range(min(self.batch, self.n_trials - first))]
                values = {r.trial: r.value for r in self.evaluate(points, rows).collect()}
                self.trials_ += [Trial(first + i, *point, float(values[i])) for i, point in enumerate(points)]
        finally:
            rows.unpersist()
        good = [t for t in self.trials_ if t.state == "COMPLETE"]
        if not good:
            warnings.warn("all trials failed", OptimizationFailureWarning, stacklevel=2)
            self.m_star_ = self.r_star_ = self.p_star_ = float("nan")
        else:
            best = min(good, key=lambda t: t.value)
            self.m_star_, self.r_star_, self.p_star_ = best.m, best.r, best.p
        return self.m_star_, self.r_star_, self.p_star_

    def compute_all_sampen(self, optimize: bool = False, estimate_uncertainty: bool = False) -> DataFrame:
        """(signal_id, sampen[, se_sampen])."""
        if optimize:
            self.find_optimal_sampen_params()
        wrong = lambda v: v is None or math.isnan(v)
        if wrong(self.m_star_) or wrong(self.r_star_) or estimate_uncertainty and wrong(self.p_star_):
            raise ValueError("m, r and, for the uncertainty, p must be set or found")
        out = entropy.sample_entropy(self.signals, self.m_star_, self.r_star_)
        if estimate_uncertainty:
            errors = bootstrap.trial_spread(source.packed(self.signals), [(0, self.m_star_, self.r_star_, self.p_star_)], self.n_boot, self._seed).select("signal_id", "se_sampen")
            out = out.join(errors, "signal_id", "left")
        return out.withColumnRenamed("signal_id", self.signal_id)

    def get_optimization_results(self, attrs: tuple[str, ...] = ("number", "value", "params")) -> DataFrame:
        """One row for each trial; ValueError before a search.

        attrs are of number, value, params (a column params_m, params_p or params_r for each that was
        searched for) and state.
        """
        _require(bool(self.trials_), "there was no search yet")
        _require(set(attrs) <= {"number", "value", "params", "state"}, "attrs are number, value, params and state")
        rows = [(t.number, t.value, int(t.m), float(t.p), float(t.r), t.state) for t in self.trials_]
        every = self.signals.sparkSession.createDataFrame(rows, "number int, value double, params_m int, params_p double, params_r double, state string")
        searched = [f"params_{n}" for n in ("m", "p", "r") if getattr(self, n) is None]
        return every.select(*[c for a in attrs for c in (searched if a == "params" else [a])])


class SampEnEfficiency:
    """Finds the tolerance r at which sample entropy is estimated best, and entropy there."""

    def __init__(
        self,
        df: DataFrame,
        m: int,
        r_range: tuple[float, float],
        signal_id: str = "signal_id",
        value_col: str = "value",
        r_step_size: float = 0.05,
        interpolation_step_size: float = 0.01,
        p: float = 0.5,
        n_boot: int = 100,
        objective: str = "counting",
        random_seed: int | None = None,
        timestamp: str = "timestamp",
    ):
        _names(signal_id, timestamp, value_col)
        _require(objective in ("counting", "bootstrap"), "objective must be counting or bootstrap")
        _require(_whole(m, 1), "m must be a positive integer")
        self.signals, self.m, self.objective = source.validate(df, signal_id, timestamp, value_col), m, objective
        self.rs = [float(x) for x in np.arange(r_range[0], r_range[1] + interpolation_step_size, r_step_size)]
        self.points = np.arange(r_range[0], r_range[1] + interpolation_step_size, interpolation_step_size)
        self.signal_id, self.timestamp, self.value_col = signal_id, timestamp, value_col
        self.p, self.n_boot, self.random_seed = p, n_boot, random_seed
        self.r_star_: float | None = None
        self.obj_: float | None = None

    def table(self) -> DataFrame:
        """(signal_id, r, objective)."""
        if self.objective == "counting":
            return efficiency.criterion(efficiency.cp_table(self.signals, self.m, self.rs)).select("signal_id", "r", "objective")
        trials = [(i, self.m, r, self.p) for i, r in enumerate(self.rs)]
        spread = bootstrap.trial_spread(source.packed(self.signals), trials, self.n_boot, self.random_seed or 0)
        rs = F.get(F.array(*map(F.lit, self.rs)), F.col("trial"))
        return spread.select("signal_id", rs.alias("r"), objectives.relative_error().alias("objective"))

    def find_r(self) -> float:
        """The first point of the interpolated median criterion's minimum; ValueError if it is NaN everywhere."""
        by_r = {x.r: x.objective for x in self.table().groupBy("r").agg(efficiency.nan_median("objective").alias("objective")).collect()}
        curve = np.interp(self.points, self.rs, [by_r[r] for r in self.rs])
        if np.isnan(curve).all():
            raise ValueError("the criterion is NaN everywhere")
        self.r_star_, self.obj_ = float(self.points[np.nanargmin(curve)]), float(np.nanmin(curve))
        return self.r_star_

    def compute_all_sampen(self) -> DataFrame:
        """(signal_id, sampen, se_sampen) at the best r."""
        rows = efficiency.cp_table(self.signals, self.m, [self.find_r()])
        usable = F.col("cp") > 0
        nan = F.lit(float("nan"))
        return rows.select(F.col("signal_id").alias(self.signal_id), F.when(usable, -F.ln("cp") + F.lit(0.0)).otherwise(nan).alias("sampen"), F.when(usable, F.try_divide("sd", "cp")).otherwise(nan).alias("se_sampen"))
