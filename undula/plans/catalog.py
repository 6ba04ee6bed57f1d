"""The registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions.draws import geometric, uniform
from undula.operators import bootstrap, efficiency, entropy, gaussian, transforms, unit_root
from undula.plans import api, numeric_sql
from undula.session import ship_package
from undula.sources import signals as source

#: Off the values' lattice of 0.01, so that no distance ties with it.
M, R, P, REPS, SEED = 2, 9.9951, 0.3, 4, 17
GRID = [(1, 9.9951), (2, 9.9951), (2, 25.0051)]
TOLERANCES = [9.9951, 25.0051]
#: Large enough that the last bits of a kernel's cells don't reach the digits which are compared.
JITTER = 1e-3
#: Range, step and interpolation step of the best tolerance's search.
SEARCH = ((10.0051, 40.0051), 10.0, 2.0)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return source.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _shown(df: DataFrame, *names: str) -> DataFrame:
    """Rounds doubles to six places, with null for NaN."""
    for n in names:
        df = df.withColumn(n, F.when(~F.isnan(n), F.round(n, 6) + F.lit(0.0)))
    return df


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal's points as vectors (scaled value, point number)."""
    rows = transforms.reindex(_signals(spark, sf_dir))
    return rows.select(F.col("signal_id").alias("group"), F.col("timestamp").cast("bigint").alias("id"), F.array(F.col("value") * F.lit(0.010317), F.col("timestamp")).alias("vector"))


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaussian.squared_distances(_points(spark, sf_dir), _points(spark, sf_dir))


def _row_sums(matrix: DataFrame, name: str) -> DataFrame:
    """Sums of the rows of each signal's matrix, plain and weighted by the place in the row."""
    weighted = F.sum(F.col(name) * (F.col("j") + 1)).alias("placed")
    return _shown(matrix.groupBy(F.col("group").alias("signal_id"), "i").agg(F.sum(name).alias("total"), weighted), "total", "placed")


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distances of all embeddings from the mean of their label."""
    ship_package(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    places = rows.select("group", F.posexplode("vector").alias("k", "x")).groupBy("group", "k").agg(F.avg("x").alias("x"))
    means = places.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("xs")).select("group", F.lit(0).alias("id"), F.col("xs.x").alias("vector"))
    return _shown(gaussian.squared_distances(rows, means).select("i", "d2"), "d2")


def _objective(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The objective of that name over GRID, as the search class has it."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        search = api.SampleEntropy(_signals(spark, sf_dir), objective=name, n_boot=REPS, random_seed=SEED)
    return _shown(search.evaluate_grid(GRID, P), "value")


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objective over GRID by the grouped form of the search."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        search = api.SampleEntropy(_signals(spark, sf_dir), n_boot=REPS, random_seed=SEED)
    grid = F.get(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(r).alias("r")) for m, r in GRID]), F.col("trial"))
    return _shown(search.evaluate([(m, r, P) for m, r in GRID]).select("value", grid.m.alias("m"), grid.r.alias("r")), "value")


def _uniforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return rows.withColumn("u", uniform(F.lit("u"), F.col("event_id").cast("string")))


def _stationary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(api.StationarySignals(_signals(spark, sf_dir)).make_stationary_signals(), "timestamp", "value")


def _with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropies with their errors, as the class has them at fixed parameters."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fixed = api.SampleEntropy(_signals(spark, sf_dir), m=M, r=R, p=P, n_boot=REPS, random_seed=SEED)
    return _shown(fixed.compute_all_sampen(estimate_uncertainty=True), "sampen", "se_sampen")


def _efficiency(spark: SparkSession, sf_dir: str, objective: str, m: int) -> api.SampEnEfficiency:
    limits, step, fine = SEARCH
    return api.SampEnEfficiency(_signals(spark, sf_dir), m, limits, r_step_size=step, interpolation_step_size=fine, objective=objective, p=P, n_boot=REPS, random_seed=SEED)


def _optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.SampleEntropy(_signals(spark, sf_dir), m_range=(1, 2), r_range=(5.0, 30.0), n_boot=50, n_trials=20, batch=5, random_seed=SEED)
    found.find_optimal_sampen_params()
    return found.get_optimization_results(("number", "value", "params", "state"))


def _cp_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional probabilities by the efficiency criterion's kernel."""
    found = efficiency.cp_grid(_signals(spark, sf_dir), {m: [r for k, r in GRID if k == m] for m in sorted({m for m, _ in GRID})})
    return found.select("signal_id", "cp", "m", "r")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sampen": lambda s, d: _shown(entropy.sample_entropy(_signals(s, d), M, R), "sampen"),
    "sampen_counts": lambda s, d: entropy.match_counts(_signals(s, d), M, R),
    "validate_profile": lambda s, d: source.profile(_signals(s, d)),
    "signal_lengths": lambda s, d: source.lengths(_signals(s, d)),
    "difference": lambda s, d: _shown(transforms.difference(_signals(s, d)), "timestamp", "value"),
    "detrend_linear": lambda s, d: _shown(transforms.detrend_linear(_signals(s, d)), "timestamp", "value"),
    "normalize": lambda s, d: _shown(transforms.normalise(_signals(s, d)), "timestamp", "value"),
    "time_reindex": lambda s, d: _shown(transforms.reindex(_signals(s, d)), "value"),
    "df_tstat_lag0": lambda s, d: _shown(unit_root.dickey_fuller(_signals(s, d)), "tstat"),
    "holm_sidak": lambda s, d: unit_root.holm_sidak(source.lengths(_signals(s, d)).select("signal_id", F.pow(uniform(F.lit("p"), F.col("signal_id").cast("string")), 8.0).alias("pvalue"))).select("signal_id", "reject"),
    "adf_pvalue": lambda s, d: _shown(unit_root.pvalues(_signals(s, d)), "pvalue"),
    "stationary_signals": _stationary,
    "geom_from_uniform": lambda s, d: _uniforms(s, d).select("event_id", geometric(F.col("u"), P).alias("steps")),
    "bootstrap_index": lambda s, d: bootstrap.indices(_signals(s, d), P, REPS, SEED),
    "bootstrap_series": lambda s, d: bootstrap.resample(_signals(s, d), P, REPS, SEED),
    "sampen_se": lambda s, d: _shown(bootstrap.standard_error(_signals(s, d), M, R, P, REPS, SEED), "se_sampen"),
    "bootstrap_mse": lambda s, d: _shown(bootstrap.mean_squared_error(_signals(s, d), M, R, P, REPS, SEED), "mse"),
    "mse_objective_grid": lambda s, d: _objective(s, d, "mse"),
    "eff_objective_grid": lambda s, d: _objective(s, d, "sampen_eff"),
    "mse_objective_trials": _trials,
    "best_params_grid": lambda s, d: _shown(_objective(s, d, "mse").where("value IS NOT NULL").agg(F.min_by(F.struct("m", "r"), F.struct("value", "m", "r")).alias("best"), F.min("value").alias("value")).select("best.m", "best.r", "value"), "value"),
    "sqdist_xx": lambda s, d: _distances(s, d).groupBy(F.col("group").alias("signal_id"), "i").agg((F.round(F.sum("d2"), 3) + F.lit(0.0)).alias("total"), (F.round(F.sum(F.col("d2") * (F.col("j") + 1)), 3) + F.lit(0.0)).alias("placed")),
    "sqdist_xy": _centres,
    "rbf_kernel": lambda s, d: _row_sums(gaussian.rbf(_distances(s, d), 2.0), "k"),
    "jitter_kernel": lambda s, d: _row_sums(gaussian.jitter(gaussian.rbf(_distances(s, d), 2.0), 0.1), "k"),
    "time_series_split": lambda s, d: gaussian.folds(_signals(s, d), 5),
    "gp_detrend": lambda s, d: gaussian.detrend_gp(_signals(s, d)),
    "gp_detrend_jitter": lambda s, d: gaussian.detrend_gp(_signals(s, d), eps=JITTER, seed=SEED).withColumn("value", F.round("value", 4) + F.lit(0.0)),
    "gp_detrend_per_signal": lambda s, d: gaussian.detrend_gp(_signals(s, d), eps=1e-10, shared=False),
    "cp_grid": lambda s, d: _shown(_cp_grid(s, d), "cp"),
    "cp_sd": lambda s, d: _shown(efficiency.criterion(efficiency.cp_table(_signals(s, d), M, TOLERANCES)), "cp", "sd", "objective"),
    "r_star": lambda s, d: _shown(_efficiency(s, d, "counting", 1).compute_all_sampen(), "sampen", "se_sampen"),
    "eff_bootstrap": lambda s, d: _shown(_efficiency(s, d, "bootstrap", M).table(), "objective"),
    "sampen_with_errors": _with_errors,
    "find_optimal": _optimal,
}

_SIGNALS = "signals AS (SELECT user_id AS signal_id, epoch_us(ts) / 1e6 AS timestamp, CAST(value AS DOUBLE) AS value FROM events)"


def _counts_sql(points: str, m: int, r: float, by: tuple[str, ...] = ("signal_id",)) -> str:
    """SQL of match_counts over the relation `points`, as a parenthesised query."""
    keys = ", ".join(by)
    leads = ", ".join(f"lead(value, {k}) OVER w AS x{k}" for k in range(1, m + 1))
    near = [f"abs(a.x{k} - b.x{k}) < {r}" for k in range(m + 1)]
    same = " AND ".join(f"a.{c} = b.{c}" for c in by)
    mine = ", ".join(f"a.{c} AS {c}" for c in by)
    group = ", ".join(f"a.{c}" for c in by)
    x = f"(SELECT * FROM (SELECT {keys}, row_number() OVER w AS i, value AS x0, {leads} FROM {points} WINDOW w AS (PARTITION BY {keys} ORDER BY timestamp, value)) q WHERE x{m} IS NOT NULL)"
    pairs = f"SELECT {mine}, sum(CASE WHEN {near[m]} THEN 1 ELSE 0 END) AS n_a, count(*) AS n_b FROM {x} a JOIN {x} b ON {same} AND a.i < b.i AND {' AND '.join(near[:m])} GROUP BY {group}"
    on = " AND ".join(f"s.{c} = c.{c}" for c in by)
    return f"(SELECT {', '.join(f's.{c}' for c in by)}, CAST(coalesce(c.n_a, 0) AS BIGINT) AS n_a, CAST(coalesce(c.n_b, 0) AS BIGINT) AS n_b FROM (SELECT DISTINCT {keys} FROM {points}) s LEFT JOIN ({pairs}) c ON {on})"


_ENTROPY = "CASE WHEN n_a > 0 THEN -ln(CAST(n_a AS DOUBLE) / n_b) + 0.0 END"


def _draw(key: str) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0"


_KEY = f"'{SEED}:' || signal_id || ':' || rep || ':' || k || ':"
_BOOT = f"""{_SIGNALS},
 sizes AS (SELECT signal_id, count(*) AS n FROM signals GROUP BY signal_id),
 reps AS (SELECT signal_id, n, unnest(range(0, {REPS})) AS rep FROM sizes),
 steps AS (SELECT signal_id, n, rep, unnest(range(0, n)) AS k FROM reps),
 drawn AS (SELECT signal_id, n, rep, k, CASE WHEN k = 0 OR {_draw(_KEY + "1'")} < {P} THEN 1 ELSE 0 END AS fresh, {_draw(_KEY + "2'")} AS u FROM steps),
 blocks AS (SELECT *, sum(fresh) OVER (PARTITION BY signal_id, rep ORDER BY k) AS blk FROM drawn),
 begun AS (SELECT signal_id, rep, blk, floor(u * n) AS at, k AS k0 FROM blocks WHERE fresh = 1),
 idx AS (SELECT b.signal_id, CAST(b.rep AS INTEGER) AS rep, CAST(b.k AS INTEGER) AS k, CAST((CAST(g.at AS BIGINT) + b.k - g.k0) % b.n AS BIGINT) AS idx FROM blocks b JOIN begun g ON b.signal_id = g.signal_id AND b.rep = g.rep AND b.blk = g.blk),
 points AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY timestamp, value) - 1 AS idx, value FROM signals),
 series AS (SELECT i.signal_id, i.rep, CAST(i.k AS DOUBLE) AS timestamp, p.value FROM idx i JOIN points p ON i.signal_id = p.signal_id AND i.idx = p.idx)"""


def _boot_sql(m: int, r: float) -> str:
    """SQL clauses of replicate and own entropies, after _BOOT."""
    return f"{_BOOT}, boot AS (SELECT signal_id, rep, {_ENTROPY} AS s FROM {_counts_sql('series', m, r, ('signal_id', 'rep'))} c), own AS (SELECT signal_id, {_ENTROPY} AS s FROM {_counts_sql('signals', m, r)} c)"


def _mse_sql(m: int, r: float) -> str:
    return f"(WITH {_boot_sql(m, r)}, each AS (SELECT b.signal_id, CASE WHEN count(*) = count(b.s - o.s) THEN avg((b.s - o.s) * (b.s - o.s)) END AS mse FROM boot b JOIN own o ON b.signal_id = o.signal_id GROUP BY b.signal_id) SELECT CASE WHEN count(*) = count(mse) THEN avg(mse) + {0.33 * r**0.5!r} END AS value, {m} AS m, CAST({r} AS DOUBLE) AS r FROM each)"


def _eff_sql(m: int, r: float) -> str:
    each = "SELECT b.signal_id, max(o.s) AS s, CASE WHEN count(*) = count(b.s) THEN stddev_pop(b.s) END AS se FROM boot b JOIN own o ON b.signal_id = o.signal_id GROUP BY b.signal_id"
    worse = "CASE WHEN s IS NULL OR s = 0 THEN se WHEN se IS NULL THEN NULL ELSE greatest(se, se / s) END"
    return f"(WITH {_boot_sql(m, r)}, each AS ({each}) SELECT CASE WHEN count(*) = count({worse}) THEN median({worse}) END AS value, {m} AS m, CAST({r} AS DOUBLE) AS r FROM each)"


def _relative_sql(r: float) -> str:
    """SQL of each signal's relative error by replicates, parenthesised."""
    each = "SELECT b.signal_id, max(o.s) AS s, CASE WHEN count(*) = count(b.s) THEN stddev_pop(b.s) END AS se FROM boot b JOIN own o ON b.signal_id = o.signal_id GROUP BY b.signal_id"
    return f"(WITH {_boot_sql(M, r)} SELECT signal_id, CASE WHEN s IS NULL OR s = 0 THEN se WHEN se IS NOT NULL THEN greatest(se, se / s) END AS objective, CAST({r!r} AS DOUBLE) AS r FROM ({each}) q)"


_MSE = " UNION ALL ".join(f"SELECT * FROM {_mse_sql(m, r)} g{i}" for i, (m, r) in enumerate(GRID))
_D2 = f"{_SIGNALS}, pts AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY timestamp, value) - 1 AS i, value * CAST(0.010317 AS DOUBLE) AS v FROM signals), d AS (SELECT a.signal_id, a.i, b.i AS j, (a.v - b.v) * (a.v - b.v) + CAST((a.i - b.i) * (a.i - b.i) AS DOUBLE) AS d2 FROM pts a JOIN pts b ON a.signal_id = b.signal_id)"
_SUMS = "SELECT signal_id, CAST(i AS BIGINT) AS i, round(sum({0}), 6) + 0.0 AS total, round(sum(({0}) * (j + 1)), 6) + 0.0 AS placed FROM d GROUP BY signal_id, i"

_RS = [float(x) for x in np.arange(SEARCH[0][0], SEARCH[0][1] + SEARCH[2], SEARCH[1])]
_BETWEEN = [float(x) for x in np.arange(SEARCH[0][0], SEARCH[0][1] + SEARCH[2], SEARCH[2])]

ORACLE_SQL: dict[str, str] = {
    "sampen": f"WITH {_SIGNALS} SELECT signal_id, round({_ENTROPY}, 6) AS sampen FROM {_counts_sql('signals', M, R)} c",
    "sampen_counts": f"WITH {_SIGNALS} SELECT signal_id, n_a, n_b FROM {_counts_sql('signals', M, R)} c",
    "validate_profile": f"WITH {_SIGNALS} SELECT count(*) AS n_rows, count(DISTINCT signal_id) AS n_signals, CAST(count(*) - count(signal_id) AS BIGINT) AS null_ids, CAST(count(*) - count(timestamp) AS BIGINT) AS bad_times, CAST(count(*) - count(value) AS BIGINT) AS bad_values FROM signals",
    "signal_lengths": f"WITH {_SIGNALS} SELECT signal_id, count(*) AS n FROM signals GROUP BY signal_id",
    "difference": f"WITH {_SIGNALS}, d AS (SELECT signal_id, timestamp, value - lag(value) OVER (PARTITION BY signal_id ORDER BY timestamp, value) AS value FROM signals) SELECT signal_id, round(timestamp, 6) AS timestamp, round(value, 6) + 0.0 AS value FROM d WHERE value IS NOT NULL",
    "detrend_linear": f"WITH {_SIGNALS}, c AS (SELECT *, timestamp - avg(timestamp) OVER (PARTITION BY signal_id) AS t, avg(value) OVER (PARTITION BY signal_id) AS mean FROM signals), f AS (SELECT signal_id, sum(t * (value - mean)) / sum(t * t) AS b FROM c GROUP BY signal_id) SELECT c.signal_id, round(c.timestamp, 6) AS timestamp, round(c.value - c.mean - f.b * c.t, 6) + 0.0 AS value FROM c JOIN f ON c.signal_id = f.signal_id",
    "normalize": f"WITH {_SIGNALS}, g AS (SELECT signal_id, avg(value) AS mean, stddev_samp(value) AS sd FROM signals GROUP BY signal_id) SELECT s.signal_id, round(s.timestamp, 6) AS timestamp, round((s.value - g.mean) / g.sd, 6) + 0.0 AS value FROM signals s JOIN g ON s.signal_id = g.signal_id",
    "time_reindex": f"WITH {_SIGNALS} SELECT signal_id, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY timestamp, value) - 1 AS DOUBLE) AS timestamp, round(value, 6) + 0.0 AS value FROM signals",
    "df_tstat_lag0": f"WITH {_SIGNALS}, l AS (SELECT signal_id, value, lag(value) OVER (PARTITION BY signal_id ORDER BY timestamp, value) AS x FROM signals), g AS (SELECT signal_id, count(*) AS n, regr_slope(value - x, x) AS b, regr_sxx(value - x, x) AS sxx, regr_syy(value - x, x) AS syy FROM l WHERE x IS NOT NULL GROUP BY signal_id) SELECT signal_id, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 6) AS tstat FROM g",
    "holm_sidak": f"WITH {_SIGNALS}, t AS (SELECT DISTINCT signal_id FROM signals), p AS (SELECT signal_id, pow({_draw(chr(39) + 'p:' + chr(39) + ' || signal_id')}, 8.0) AS p FROM t), k AS (SELECT signal_id, p, row_number() OVER (ORDER BY p, signal_id) AS k, count(*) OVER () AS n FROM p), f AS (SELECT signal_id, p, CASE WHEN p > 1 - pow(0.95, 1.0 / CAST(n - k + 1 AS DOUBLE)) THEN 1 ELSE 0 END AS bad FROM k) SELECT signal_id, max(bad) OVER (ORDER BY p, signal_id) = 0 AS reject FROM f",
    "geom_from_uniform": f"SELECT event_id, CAST(ceil(ln(1 - {_draw(chr(39) + 'u:' + chr(39) + ' || event_id')}) / ln(0.7)) AS INTEGER) AS steps FROM events",
    "bootstrap_index": f"WITH {_BOOT} SELECT signal_id, rep, k, idx FROM idx",
    "bootstrap_series": f"WITH {_BOOT} SELECT signal_id, rep, timestamp, value FROM series",
    "sampen_se": f"WITH {_boot_sql(M, R)} SELECT signal_id, CASE WHEN count(*) = count(s) THEN round(stddev_pop(s), 6) + 0.0 END AS se_sampen FROM boot GROUP BY signal_id",
    "bootstrap_mse": f"WITH {_boot_sql(M, R)} SELECT b.signal_id, CASE WHEN count(*) = count(b.s - o.s) THEN round(avg((b.s - o.s) * (b.s - o.s)), 6) + 0.0 END AS mse FROM boot b JOIN own o ON b.signal_id = o.signal_id GROUP BY b.signal_id",
    "mse_objective_grid": f"SELECT round(value, 6) + 0.0 AS value, m, r FROM ({_MSE}) q",
    "eff_objective_grid": "SELECT round(value, 6) + 0.0 AS value, m, r FROM (" + " UNION ALL ".join(f"SELECT * FROM {_eff_sql(m, r)} g{i}" for i, (m, r) in enumerate(GRID)) + ") q",
    "best_params_grid": f"SELECT m, r, round(value, 6) + 0.0 AS value FROM ({_MSE}) q WHERE value IS NOT NULL ORDER BY value, m, r LIMIT 1",
    "sqdist_xx": f"WITH {_D2} " + _SUMS.format("d2").replace(", 6)", ", 3)"),
    "sqdist_xy": "WITH e AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k FROM embeddings), m AS (SELECT label, k, avg(CAST(x AS DOUBLE)) AS mean FROM e GROUP BY label, k) SELECT e.vec_id AS i, round(sum((CAST(e.x AS DOUBLE) - m.mean) * (CAST(e.x AS DOUBLE) - m.mean)), 6) + 0.0 AS d2 FROM e JOIN m ON e.label = m.label AND e.k = m.k GROUP BY e.vec_id",
    "rbf_kernel": f"WITH {_D2} " + _SUMS.format("exp(-d2 / 8.0)"),
    "jitter_kernel": f"WITH {_D2} " + _SUMS.format("exp(-d2 / 8.0) + CASE WHEN i = j THEN 0.1 ELSE 0 END"),
    "time_series_split": f"WITH {_SIGNALS}, g AS (SELECT signal_id, count(*) AS n, CAST(floor(count(*) / 6.0) AS BIGINT) AS step FROM signals GROUP BY signal_id), f AS (SELECT signal_id, n, step, unnest(range(0, 5)) AS fold FROM g) SELECT signal_id, CAST(fold AS INTEGER) AS fold, CAST(n - (5 - fold) * step AS BIGINT) AS train_end, CAST(n - (4 - fold) * step AS BIGINT) AS test_end FROM f",
    "mse_objective_trials": f"SELECT round(value, 6) + 0.0 AS value, m, r FROM ({_MSE}) q",
    "cp_grid": " UNION ALL ".join(f"SELECT signal_id, CASE WHEN n_b > 0 THEN round(CAST(n_a AS DOUBLE) / n_b, 6) END AS cp, {m} AS m, CAST({r} AS DOUBLE) AS r FROM (WITH {_SIGNALS} SELECT * FROM {_counts_sql('signals', m, r)} c) q{i}" for i, (m, r) in enumerate(GRID)),
    "adf_pvalue": f"WITH RECURSIVE {_SIGNALS}, {numeric_sql.adf('signals')} SELECT signal_id, round(pvalue, 6) + 0.0 AS pvalue FROM adf",
    "stationary_signals": f"WITH RECURSIVE {_SIGNALS}, {numeric_sql.stationary()} SELECT signal_id, round(timestamp, 6) AS timestamp, round(value, 6) + 0.0 AS value FROM stationary",
    "gp_detrend_jitter": f"WITH RECURSIVE {_SIGNALS}, {numeric_sql.detrended(numeric_sql.shared_scales(SEED, 10.0, 100.0, 10), 5, JITTER)} SELECT signal_id, timestamp, round(value, 4) + 0.0 AS value FROM detrended",
    "cp_sd": f"WITH {_SIGNALS}, {numeric_sql.criterion(M, numeric_sql.values(TOLERANCES))} SELECT signal_id, r, round(cp, 6) + 0.0 AS cp, round(sd, 6) + 0.0 AS sd, round(objective, 6) + 0.0 AS objective FROM cp",
    "r_star": f"WITH {_SIGNALS}, {numeric_sql.best_tolerance(_RS, _BETWEEN, 1)} SELECT signal_id, CASE WHEN cp > 0 THEN round(-ln(cp) + 0.0, 6) END AS sampen, CASE WHEN cp > 0 THEN round(sd / cp, 6) + 0.0 END AS se_sampen FROM star",
    "eff_bootstrap": " UNION ALL ".join(f"SELECT signal_id, r, round(objective, 6) + 0.0 AS objective FROM {_relative_sql(r)} g{i}" for i, r in enumerate(_RS)),
    "sampen_with_errors": f"WITH {_boot_sql(M, R)} SELECT b.signal_id, round(max(o.s), 6) + 0.0 AS sampen, CASE WHEN count(*) = count(b.s) THEN round(stddev_pop(b.s), 6) + 0.0 END AS se_sampen FROM boot b JOIN own o ON b.signal_id = o.signal_id GROUP BY b.signal_id",
}
