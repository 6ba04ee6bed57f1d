import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from undula.functions import draws
from undula.operators import bootstrap, efficiency, entropy, gaussian, transforms, unit_root
from undula.plans import api, catalog, numeric_sql
from undula.sources import signals as source


def frame(spark, rows):
    return spark.createDataFrame(rows, "signal_id string, timestamp double, value double")


def brute(x, m, r):
    n, a, b = len(x) - m, 0, 0
    for s in range(n):
        for t in range(s + 1, n):
            if all(abs(x[s + k] - x[t + k]) < r for k in range(m)):
                b += 1
                a += abs(x[s + m] - x[t + m]) < r
    return -math.log(a / b) + 0.0 if a else float("nan")


def test_sample_entropy_equals_brute_force(spark):
    rng = np.random.default_rng(17)
    xs = {"a": rng.normal(size=60), "b": np.full(30, 5.0), "c": np.linspace(0, 1, 40), "d": [1.0, 2.0]}
    df = frame(spark, [(k, float(i), float(v)) for k, x in xs.items() for i, v in enumerate(x)])
    got = {r.signal_id: r.sampen for r in entropy.sample_entropy(df, 2, 0.4).collect()}
    for k, x in xs.items():
        assert got[k] == pytest.approx(brute(x, 2, 0.4), nan_ok=True)
        assert entropy.sampen_array(np.array(x, float), 2, 0.4) == pytest.approx(got[k], nan_ok=True)


def test_difference_and_detrend(spark):
    df = frame(spark, [("abc", 1.0, 2.0), ("abc", 2.0, 3.0), ("def", 1.0, 5.0), ("def", 2.0, 7.0)])
    assert sorted(map(tuple, transforms.difference(df).collect())) == [("abc", 2.0, 1.0), ("def", 2.0, 2.0)]
    assert all(abs(r.value) < 1e-9 for r in transforms.detrend_linear(df).collect())
    with pytest.raises(ValueError):
        transforms.difference(frame(spark, [("a", 1.0, 1.0)]))


@pytest.mark.parametrize("rows,schema", [([], "signal_id string, timestamp double, value double"), ([("a", "x", 1.0)], "signal_id string, timestamp string, value double"), ([("a", 1.0, float("nan"))], "signal_id string, timestamp double, value double"), ([("a", 1.0, True)], "signal_id string, timestamp double, value boolean"), ([("a", 1.0)], "signal_id string, timestamp double")])
def test_invalid_tables_raise(spark, rows, schema):
    with pytest.raises(ValueError):
        source.validate(spark.createDataFrame(rows, schema))


def test_line_fails_and_sine_passes_the_unit_root_test(spark):
    line, sine = np.linspace(0, 100, 100), np.sin(np.linspace(0, 2 * np.pi, 100))
    df = frame(spark, [("abc", float(i), float(v)) for i, v in enumerate(line)] + [("def", float(i), float(v)) for i, v in enumerate(sine)])
    tests = {r.signal_id: r.reject for r in unit_root.holm_sidak(unit_root.pvalues(df)).collect()}
    assert tests == {"abc": False, "def": True}


def test_gaussian_process_goldens():
    y = np.random.default_rng(17).normal(size=10)
    left, best = gaussian.detrend_array(y, np.array([0.5, 1.0]), 3, 1e-6)
    assert best == 0.5 and np.abs(left).max() < 2e-6


def test_conditional_probability_matches_counts(spark):
    x = np.random.default_rng(3).normal(size=80)
    cp, sd = efficiency.cp_and_sd(x, 2, 0.5)
    assert -math.log(cp) == pytest.approx(brute(x, 2, 0.5)) and sd > 0
    assert math.isnan(efficiency.cp_and_sd(x[:5], 2, 0.5)[0])


def test_search_is_repeatable_and_fails_with_a_warning(spark):
    x = np.random.default_rng(17).normal(size=(2, 60))
    df = frame(spark, [(str(k), float(i), float(v)) for k in range(2) for i, v in enumerate(x[k])])
    with pytest.warns(api.SampEnSettingWarning):
        one = api.SampleEntropy(df, m_range=(1, 2), n_boot=3, n_trials=2, random_seed=1)
        two = api.SampleEntropy(df, m_range=(1, 2), n_boot=3, n_trials=2, random_seed=1)
        tight = api.SampleEntropy(df, m_range=(2, 3), r_range=(1e-6, 2e-6), n_boot=2, n_trials=1)
    first, second = one.find_optimal_sampen_params(), two.find_optimal_sampen_params()
    assert [t.value for t in one.trials_] == pytest.approx([t.value for t in two.trials_], nan_ok=True) and str(first) == str(second)
    with pytest.warns(api.OptimizationFailureWarning):
        tight.find_optimal_sampen_params()
    with pytest.raises(ValueError):
        tight.compute_all_sampen()


def test_normalise(spark):
    df = frame(spark, [("a", float(i), float(i)) for i in range(5)] + [("b", 0.0, 1.0), ("b", 1.0, 1.0)])
    out = {r.signal_id: (r.m, r.s) for r in transforms.normalise(df).groupBy("signal_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).collect()}
    assert out["a"] == pytest.approx((0.0, 1.0)) and math.isnan(out["b"][0])


def plain_cp(x, mm, r):
    """Conditional probability and its deviation by the counting recipe, cell by cell."""
    n, top = len(x), mm + 1
    width = 2 * top
    run, r1, r2 = [0] * n, [[0] * width for _ in range(n)], [[0] * width for _ in range(n)]
    f1, f = [[0] * top for _ in range(n)], [[0] * top for _ in range(n)]
    a, b = [0] * top, [0] * top
    for i in range(n - 1):
        for lag in range(1, n - i):
            j = i + lag
            run[lag - 1] = run[lag - 1] + 1 if abs(x[j] - x[i]) < r else 0
            for q in range(min(top, run[lag - 1])):
                a[q] += 1
                b[q] += j < n - 1
                f1[i][q] += 1
                f[i][q] += 1
                f[j][q] += 1
        r1[i] = run[:width]
    for i in range(1, n):
        for j in range(width if i >= width else max(0, i - 1)):
            if i - j - 1 >= 0:
                r2[i][j] = r1[i - j - 1][j]
    f2 = [[f[i][q] - f1[i][q] for q in range(top)] for i in range(n)]
    pairs = [[0] * (top + 1) for _ in range(top)]
    for q in range(top):
        pairs[q][0] = sum(f[i][q] * (f[i][q] - 1) for i in range(n))
        for d in range(min(q + 1, top - 1) + 1):
            for i in range(d + 1, n):
                k = i - d - 1
                n2 = f2[i][q] - sum(r2[i][j] >= q + 1 for j in range(min(width, 2 * (d + 1))))
                n3 = f1[k][q] - sum(r1[k][j] >= q + 1 for j in range(min(width, 2 * d + 1)))
                pairs[q][d + 1] += 2 * (f1[i][q] + n2) * (n3 + f2[k][q])
    b = [n * (n - 1) / 2, *b[:-1]]
    q = top - 1
    p = a[q] / b[q]
    first = sum(pairs[q - 1][: q + 1]) if q else n * (n - 1) * (n - 2)
    return p, math.sqrt(p * (1 - p) / b[q] + max(0, (sum(pairs[q][: q + 1]) - first * p * p) / b[q] ** 2))


@pytest.mark.parametrize("m", [1, 2])
def test_conditional_probability_and_deviation_equal_plain_counting(m):
    for seed in range(4):
        x = np.random.default_rng(seed).normal(size=40)
        assert efficiency.cp_and_sd(x, m, 0.6) == pytest.approx(plain_cp(x, m, 0.6))


def test_long_signals_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(entropy, "BLOCK", 7)
    x = np.random.default_rng(5).normal(size=50)
    df = frame(spark, [("a", float(i), float(v)) for i, v in enumerate(x)] + [("b", 0.0, 1.0)])
    got = {(r.signal_id, r.m, r.r): r.sampen for r in entropy.grid_entropy(df, [(1, 0.3), (2, 0.5), (3, 0.9)]).collect()}
    for (k, m, r), value in got.items():
        assert value == pytest.approx(brute(x, m, r) if k == "a" else float("nan"), nan_ok=True)


def test_grouped_replicates_equal_built_in_ones(spark):
    x = np.random.default_rng(6).normal(size=(2, 30))
    df = frame(spark, [(str(k), float(i), float(v)) for k in range(2) for i, v in enumerate(x[k])])
    for p in (0.1, 0.6):
        rows = bootstrap.grid_replicates(df, [(1, 0.4), (2, 0.7)], p, 40, 3).collect()
        want = {(r.signal_id, r.m, r.rep): r.sampen for r in rows}
        made = bootstrap.trial_replicates(df, [(1, 1, 0.4, p), (2, 2, 0.7, p)], 40, 3).collect()
        got = {(r.signal_id, r.trial, r.rep): r.sampen for r in made if r.rep >= 0}
        assert got == {k: pytest.approx(v, nan_ok=True) for k, v in want.items()}
        own = {(r.signal_id, r.trial): r.sampen for r in made if r.rep < 0}
        assert own["0", 1] == pytest.approx(brute(x[0], 1, 0.4)) and len(own) == 4


def test_resampled_blocks_have_geometric_lengths():
    draws = bootstrap._draws("a", range(200), 100, 1)
    rows = bootstrap.index_rows(draws, 0.2)
    assert rows.shape == (200, 100) and rows.min() >= 0 and rows.max() < 100
    new = np.diff(rows, axis=1) % 100 != 1
    lengths = [len(part) for row in new for part in np.split(row, np.flatnonzero(row))[1:-1]]
    assert np.mean(lengths) == pytest.approx(5, rel=0.1) and np.std(lengths) == pytest.approx(math.sqrt(20), rel=0.15)


def test_gaussian_process_values():
    k, y = np.array([[1, 1 / 2, 0], [1 / 2, 1, 1 / 3], [0, 1 / 3, 1]]), np.array([1.0, 2, 3])
    assert gaussian.solve(np.linalg.cholesky(k), y) == pytest.approx(np.linalg.solve(k, y))
    rng = np.random.default_rng(1)
    big = rng.normal(size=(150, 150))
    big = big @ big.T + np.eye(150)
    assert gaussian.solve(np.linalg.cholesky(big), big[0]) == pytest.approx(np.linalg.solve(big, big[0]), abs=1e-8)
    x = np.array([[1.0, 2.0], [3.0, 4.0]])
    assert gaussian.fit(x, np.array([5.0, 6.0]), 0.5) == pytest.approx([5, 6], abs=2e-5)
    at = np.array([[1.0, 1.0], [2.0, 2.0]])
    direct = [sum(w * math.exp(-2 * sum((p - q) ** 2 for p, q in zip(a, b))) for b, w in zip(x, (5.0, 6.0))) for a in at]
    assert gaussian.predict(x, at, 0.5, np.array([5.0, 6.0])) == pytest.approx(direct)
    y = np.random.default_rng(17).normal(size=10)
    assert gaussian.Process(y, 0.5, 1e-6, False).error(3, "neg_mean_squared_error") == pytest.approx(0.7484052691169865, abs=1e-7)
    with pytest.raises(ValueError):
        gaussian.detrend_array(np.zeros(gaussian.MOST_POINTS + 1), np.array([1.0]), 3, 1e-6)


def test_folds(spark):
    got = sorted(map(tuple, gaussian.folds(frame(spark, [("a", float(i), 0.0) for i in range(6)]), 3).collect()))
    assert got == [("a", 0, 3, 4), ("a", 1, 4, 5), ("a", 2, 5, 6)]


def test_unit_root_lags_equal_separate_fits():
    for seed in range(3):
        y = np.cumsum(np.random.default_rng(seed).normal(size=90)) if seed else np.random.default_rng(9).normal(size=90)
        d, n = np.diff(y), 90
        most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
        scores = []
        for lags in range(most + 1):
            rows = np.arange(most, len(d))
            x = np.column_stack([np.ones(len(rows)), y[rows], *[d[rows - k] for k in range(1, lags + 1)]])
            left = float(np.sum((d[rows] - x @ np.linalg.lstsq(x, d[rows], rcond=None)[0]) ** 2))
            scores.append(len(rows) * math.log(left / len(rows)) + 2 * x.shape[1])
        lags = int(np.argmin(scores))
        rows = np.arange(lags, len(d))
        x = np.column_stack([np.ones(len(rows)), y[rows], *[d[rows - k] for k in range(1, lags + 1)]])
        beta = np.linalg.lstsq(x, d[rows], rcond=None)[0]
        t = beta[1] / math.sqrt(np.sum((d[rows] - x @ beta) ** 2) / (len(rows) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        z = 2.1659 + 1.4412 * t + 0.038269 * t * t if t <= -1.61 else 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t**3
        assert unit_root.adf_pvalue(y) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)) if -18.83 <= t <= 2.74 else float(t > 0), rel=1e-6)


def test_step_down_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(unit_root, "PARTS", 5)
    rng = np.random.default_rng(3)
    for ps in ([0.001, 0.001, 0.02, 0.3, 1.0, float("nan")], [0.9], list(rng.random(60) ** 6), [0.0] * 7 + [1.0]):
        got = {r.signal_id: r.reject for r in unit_root.holm_sidak(spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "signal_id int, pvalue double")).collect()}
        stop, want = False, {}
        for k, i in enumerate(sorted(range(len(ps)), key=lambda i: (math.isnan(ps[i]), ps[i], i))):
            stop = stop or not ps[i] <= 1 - 0.95 ** (1 / (len(ps) - k))
            want[i] = not stop
        assert got == want
    assert unit_root.holm_sidak(spark.createDataFrame([], "signal_id int, pvalue double")).count() == 0


WRONG_ENTROPY = [{"r_range": (0.5, 0.1)}, {"r_range": (-0.1, 0.5)}, {"m_range": (3, 1)}, {"m_range": (1.5, 3)}, {"m_range": (1, 3.5)}, {"p_range": (0.99, 0.01)}, {"p_range": (-0.01, 0.99)}, {"p_range": (0.01, 1.1)}, {"m": -1}, {"m": 0}, {"m": 1.5}, {"r": -0.1}, {"r": 0}, {"p": -0.1}, {"p": 1.1}, {"p": 1}, {"p": 0}, {"lam": -0.1}, {"n_boot": -1}, {"n_boot": 0}, {"n_boot": 1.5}, {"n_trials": -1}, {"n_trials": 0}, {"n_trials": 1.5}, {"random_seed": -1}, {"random_seed": 1.5}, {"signal_id": 123}, {"timestamp": 123}, {"value_col": 123}, {"objective": "other"}, {"m_range": (1, 999)}]
WRONG_STATIONARY = [{"method": "other"}, {"detrend_type": "other"}, {"alpha": 0}, {"alpha": 1.5}, {"ls_range": (10.0, 1.0)}, {"ls_range": (-1.0, 1.0)}, {"n_searches": 0}, {"n_splits": 1.5}, {"random_seed": "x"}, {"eps": -1.0}, {"gp_implementation": "other"}, {"sklearn_scoring": "other"}]


def test_wrong_arguments_raise(spark):
    df = frame(spark, [("a", float(i), float(i % 3)) for i in range(9)])
    for kind, cases in ((api.SampleEntropy, WRONG_ENTROPY), (api.StationarySignals, WRONG_STATIONARY)):
        for case in cases:
            with pytest.raises(ValueError):
                kind(df, **case)
    made = api.SampleEntropy(df)
    assert (made.n_boot, made.n_trials, made.random_seed, made.r_range, made.m_range, made.p_range, made.lam) == (100, 100, None, (0.1, 0.5), (1, 3), (0.01, 0.99), 0.33)


def test_stationary_ids_and_trial_tables(spark):
    line, sine = np.linspace(0, 100, 100), np.sin(np.linspace(0, 2 * np.pi, 100))
    df = frame(spark, [("abc", float(i), float(v)) for i, v in enumerate(line)] + [("def", float(i), float(v)) for i, v in enumerate(sine)])
    noise = np.random.default_rng(17).uniform(-5, 5, (2, 100))
    kept = api.StationarySignals(frame(spark, [("xy"[k], float(i), float(v)) for k in range(2) for i, v in enumerate(noise[k])]), normalize_signals=False)
    out = kept.make_stationary_signals()
    assert out.count() == 198 and kept.stationary_frac_ == 1 and {r.signal_id for r in kept.stationary_signals_.collect()} == {"x", "y"}
    kept.release()
    for how in ("numba", "sklearn"):
        gp = api.StationarySignals(df, method="detrend", gp_implementation=how, random_seed=1, n_searches=3)
        assert gp.make_stationary_signals().columns == ["signal_id", "timestamp", "value"] and 0 <= gp.stationary_frac_ <= 1
    search = api.SampleEntropy(df, n_boot=50, n_trials=12, batch=4, m=1, random_seed=2, r_range=(0.1, 3.0))
    with pytest.raises(ValueError):
        search.get_optimization_results()
    m, r, p = search.find_optimal_sampen_params()
    assert m == 1 and 0.1 <= r <= 3 and 0.01 <= p <= 0.99
    table = search.get_optimization_results()
    assert table.columns == ["number", "value", "params_p", "params_r"] and table.count() == 12
    found = search.compute_all_sampen(estimate_uncertainty=True).collect()
    assert len(found) == 2 and all(x.se_sampen >= 0 for x in found)


def test_efficiency_by_bootstrap(spark):
    x = np.random.default_rng(4).normal(size=(3, 40))
    df = frame(spark, [(str(k), float(i), float(v)) for k in range(3) for i, v in enumerate(x[k])])
    best = api.SampEnEfficiency(df, 1, (0.4, 0.8), r_step_size=0.2, interpolation_step_size=0.1, objective="bootstrap", n_boot=20)
    table = {(r.signal_id, r.r): r.objective for r in best.table().collect()}
    one = bootstrap.standard_error(df, 1, best.rs[0], 0.5, 20, 0).where("signal_id = '1'").first().se_sampen
    assert table["1", best.rs[0]] == pytest.approx(max(one, one / brute(x[1], 1, best.rs[0])))
    assert len(best.compute_all_sampen().collect()) == 3 and best.r_star_ in best.points


def test_an_undefined_replicate_makes_the_error_undefined(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, [(k, float(i), float(v)) for k, n in (("a", 12), ("b", 60)) for i, v in enumerate(rng.normal(size=n))])
    plain = {r.signal_id: r.se_sampen for r in bootstrap.standard_error(df, 2, 0.3, 0.5, 30, 1).collect()}
    with pytest.warns(api.SampEnSettingWarning):
        fixed = api.SampleEntropy(df, m=2, r=0.3, p=0.5, n_boot=30, random_seed=1, m_range=(1, 3))
    got = {r.signal_id: r.se_sampen for r in fixed.compute_all_sampen(estimate_uncertainty=True).collect()}
    assert math.isnan(plain["a"]) and math.isnan(got["a"])
    assert got == pytest.approx(plain, nan_ok=True)
    assert math.isnan(fixed.evaluate([(2, 0.3, 0.5)]).first().value)
    flat = efficiency.cp_table(frame(spark, [("c", float(i), 3.0 * i * i) for i in range(20)]), 1, [0.5]).first()
    assert math.isnan(flat.cp) and math.isnan(flat.sd)


def test_gaussian_process_equals_sql_at_its_defaults(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(i), float(v)) for k, n in (("a", 20), ("b", 45), ("c", 13)) for i, v in enumerate(0.1 * np.arange(n) + rng.normal(size=n))]
    signals = pd.DataFrame(rows, columns=["signal_id", "timestamp", "value"])
    scales = numeric_sql.shared_scales(0, 10.0, 100.0, 10)
    sql = f"WITH RECURSIVE {numeric_sql.detrended(scales, 5, 1e-6)} SELECT signal_id, timestamp, value FROM detrended"
    with duckdb.connect() as connection:
        connection.register("signals", signals)
        want = {(k, t): v for k, t, v in connection.execute(sql).fetchall()}
    got = {(r.signal_id, r.timestamp): r.value for r in gaussian.detrend_gp(frame(spark, rows)).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def steps(df):
    """What runs: passes through Python, and joins."""
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len([x for x in text.splitlines() if "InArrow" in x or "InPandas" in x]), text.count("Join")


def varied(spark):
    """Signals of several lengths, some equal, some with ties, one constant and one too short, with ids of several lengths."""
    rng = np.random.default_rng(11)
    xs = {"a": rng.normal(size=40), "bb": rng.normal(size=40).round(1), "ccc": rng.normal(size=33), "d": np.full(30, 2.0), "e": [1.0, 2.0, 1.0], "x" * 60: rng.normal(size=33)}
    return frame(spark, [(k, float(i), float(v)) for k, x in xs.items() for i, v in enumerate(x)])


def test_a_search_makes_each_replicate_once(spark):
    df = varied(spark).where("signal_id != 'e'")
    search = api.SampleEntropy(df, n_boot=50, n_trials=12, random_seed=4, r_range=(0.2, 1.0))
    points = [(1, 0.4, 0.3), (2, 0.7, 0.3), (2, 0.9, 0.6)]
    assert steps(search.evaluate(points)) == (1, 0)
    got = {(x.signal_id, x.trial): (x.sampen, x.se_sampen, x.mse) for x in bootstrap.trial_spread(source.packed(varied(spark)), [(i, *x) for i, x in enumerate(points)], 50, 4).collect()}
    assert len(got) == 18
    for p, some in ((0.3, [0, 1]), (0.6, [2])):
        grid = [points[i][:2] for i in some]
        plain = bootstrap.spread(bootstrap.grid_replicates(varied(spark), grid, p, 50, 4), entropy.grid_entropy(varied(spark), grid), ("m", "r")).collect()
        for x in plain:
            assert got[x.signal_id, some[grid.index((x.m, x.r))]] == pytest.approx((x.sampen, x.se_sampen, x.mse), nan_ok=True)


def test_efficiency_by_bootstrap_makes_each_replicate_once(spark):
    df = varied(spark)
    best = api.SampEnEfficiency(df, 1, (0.4, 0.8), r_step_size=0.2, interpolation_step_size=0.1, objective="bootstrap", n_boot=20)
    assert steps(best.table()) == (1, 0)
    got = {(x.signal_id, x.r): x.objective for x in best.table().collect()}
    assert len(got) == 6 * len(best.rs)
    for r in best.rs:
        own = {x.signal_id: x.sampen for x in entropy.sample_entropy(df, 1, r).collect()}
        for x in bootstrap.standard_error(df, 1, r, 0.5, 20, 0).collect():
            s, se = own[x.signal_id], x.se_sampen
            assert got[x.signal_id, r] == pytest.approx(se if math.isnan(s) or s == 0 else max(se, se / s), nan_ok=True)


def test_ranks_and_grouped_draws_equal_plain_ones():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 255, 256, 700):
        x = np.column_stack([rng.normal(size=n), rng.integers(0, 9, n) * 0.1, np.full(n, 1.0)])
        x[0, 0] = np.nan
        ranked = entropy.Ranked(x)
        for m, r in ((1, 0.1), (2, 0.3), (3, 0.1 + 0.2)):
            assert entropy.ranked_sampen(ranked.rank, *ranked.near(r), m) == pytest.approx(entropy.sampen_rows(x.T, m, r), nan_ok=True, rel=1e-15)
    for names, reps, n in (([b"17:1", b"17:2"], range(8, 12), 103), ([b"0:" + b"a" * 45], range(2), 11), ([b"0:" + b"a" * 60] * 2, range(2), 3)):
        want = [[[[int(hashlib.md5(b"%s:%d:%d:%d" % (a, rep, k, which)).hexdigest()[:8], 16) / 2**32 for rep in reps] for a in names] for k in range(n)] for which in (1, 2)]
        assert (draws.many(names, reps, n) == np.array(want)).all()


def test_the_best_tolerance_takes_signals_together(spark):
    df = varied(spark)
    best = api.SampEnEfficiency(df, 1, (0.4, 1.0), r_step_size=0.2, interpolation_step_size=0.1)
    assert steps(best.table()) == (1, 0) and steps(efficiency.cp_table(df, 1, best.rs)) == (1, 0)
    got = {(x.signal_id, x.r): (x.cp, x.sd) for x in efficiency.cp_table(df, 1, best.rs).collect()}
    values = {k: [x.value for x in df.where(df.signal_id == k).orderBy("timestamp").collect()] for k in ("a", "bb", "ccc", "d", "e")}
    assert len(got) == 6 * len(best.rs)
    for k, x in values.items():
        for r in best.rs:
            assert got[k, r] == pytest.approx(plain_cp(x, 1, r) if k != "e" else (math.nan, math.nan), nan_ok=True)


@pytest.mark.parametrize("n", [4, 6, 7, 40, 300])
@pytest.mark.parametrize("m", [1, 2])
def test_columns_of_signals_equal_plain_counting(n, m):
    rng = np.random.default_rng(n)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n) * 0.1, np.full(n, 3.0)])
    cp, sd = efficiency.cp_and_sd_columns(x, m, [0.3, 0.9])
    for i, r in enumerate([0.3, 0.9]):
        for k in range(3):
            try:
                want = plain_cp(list(x[:, k]), m, r) if n >= 2 * (m + 1) else (math.nan, math.nan)
            except ZeroDivisionError:  # no match of length m
                want = math.nan, math.nan
            assert (cp[i, k], sd[i, k]) == pytest.approx(want, nan_ok=True)


def events(spark, folder):
    """Some users' events beside which a query finds its SQL's."""
    rng = np.random.default_rng(12)
    rows = [(100 * u + i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), u, "x", float(v)) for u, n in ((1, 40), (2, 40), (30, 55), (400, 25)) for i, v in enumerate(rng.exponential(40, n).round(2))]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet")
    return str(folder)


def by_sql(folder, name, columns):
    """Rows of the query's SQL."""
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        return sorted(connection.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]}) q").fetchall(), key=str)


def test_conditional_probabilities_of_a_grid_take_one_pass(spark, tmp_path):
    made = catalog.QUERIES["cp_grid"](spark, events(spark, tmp_path))
    assert steps(made) == (1, 0)
    assert made.columns == ["signal_id", "cp", "m", "r"] and sorted(map(tuple, made.collect()), key=str) == by_sql(tmp_path, "cp_grid", made.columns)


def test_trials_of_the_grouped_form_leave_one_row_for_each_signal(spark, tmp_path):
    folder = events(spark, tmp_path)
    made = catalog.QUERIES["mse_objective_trials"](spark, folder)
    assert steps(made) == (1, 0)
    assert sorted(map(tuple, made.collect()), key=str) == by_sql(tmp_path, "mse_objective_trials", made.columns)
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, catalog.QUERIES["mse_objective_grid"](spark, folder).select(*made.columns).collect()), key=str)


def test_the_criterion_sends_each_point_once_for_all_tolerances(spark, tmp_path):
    made = catalog.QUERIES["cp_sd"](spark, events(spark, tmp_path))
    assert steps(made) == (1, 0) and "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect()), key=str) == by_sql(tmp_path, "cp_sd", made.columns)


def test_replicates_made_in_parts_equal_those_made_at_once(monkeypatch):
    """As many signals have them: replicates, and the texts of their draws, in several parts."""
    x, names, trials = np.random.default_rng(3).normal(size=(21, 7)), [b"17:%d" % k for k in range(7)], [(0, 1, 0.5, 0.3), (1, 2, 0.5, 0.3), (2, 2, 0.9, 0.6)]
    whole = bootstrap._entropies(names, x, trials, 12)
    monkeypatch.setattr(bootstrap, "CELLS", 5 * x.size)
    monkeypatch.setattr(draws, "_KEPT", 2 * 21 * 5 * 3)
    assert np.array_equal(bootstrap._entropies(names, x, trials, 12), whole, equal_nan=True)
    for i, (_, m, r, p) in enumerate(trials):
        rows = x[bootstrap.index_rows(bootstrap._draws("3", range(12), 21, 17), p), 3]
        assert whole[i, 3] == pytest.approx([*entropy.sampen_rows(x[:, 3][None], m, r), *entropy.sampen_rows(rows, m, r)], nan_ok=True)


def test_signals_of_one_length_are_one_table_up_to_its_cells():
    lists = [[9.0], [1.0, 2.0], [], [3.0, None], [5.0], [6.0, 7.0], [8.0, 9.0]]
    made = [(rows.tolist(), x.T.tolist()) for rows, x in source.alike(pa.array(lists, pa.list_(pa.float64())).slice(1), 4)]
    assert [rows for rows, _ in made] == [[1], [3], [0, 2], [4, 5]]
    for rows, x in made:
        assert np.array_equal(x, np.array([lists[1:][i] for i in rows], float), equal_nan=True)
    rng = np.random.default_rng(5)
    many = pa.array([rng.normal(size=n).tolist() for n in rng.integers(45, 100, 3000)])
    tables = [x.shape for _, x in source.alike(many, efficiency.CELLS)]
    assert sum(k for _, k in tables) == 3000 and len(tables) == 55 and max(n * k for n, k in tables) <= efficiency.CELLS
