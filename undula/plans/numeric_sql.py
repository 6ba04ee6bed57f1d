"""SQL for the numeric kernels: unit-root tests, Gaussian processes and the efficiency criterion.

Each takes a way of its own to the same numbers, with lists and recursion; `signals` must be there before.
"""

from __future__ import annotations

import math

import numpy as np


def _swept(name: str, source: str) -> str:
    """Clauses sweep (k lags and the constant taken out by Gram-Schmidt) and its fits, over `source`.

    `source` has signal_id, y (1-based), n and lags: columns are the lags in turn, then the level, then the
    target, all on the rows that the longest lag leaves.
    """
    rows = "[i + lags for i in range(1, n - lags)]"
    columns = f"""list_concat([[y[j - k + 1] - y[j - k] for j in {rows}] for k in range(1, lags + 1)],
   [[y[j] for j in {rows}], [y[j + 1] - y[j] for j in {rows}]])"""
    return f"""{name}_raw AS (SELECT signal_id, lags, {columns} AS c FROM {source}),
 {name} AS (SELECT signal_id, lags, 0 AS k, [[x - list_avg(v) for x in v] for v in c] AS c FROM {name}_raw
  UNION ALL SELECT signal_id, lags, k + 1, [[v[i] - c[1][i] * (list_dot_product(v, c[1]) / list_dot_product(c[1], c[1])) for i in range(1, len(v) + 1)] for v in c[2:]] FROM {name} WHERE k < lags),
 {name}_fit AS (SELECT signal_id, lags, k, len(c[-1]) AS size, list_dot_product(c[-2], c[-2]) AS sxx, list_dot_product(c[-1], c[-2]) / list_dot_product(c[-2], c[-2]) AS beta,
  list_dot_product(c[-1], c[-1]) - pow(list_dot_product(c[-1], c[-2]), 2) / list_dot_product(c[-2], c[-2]) AS rss FROM {name})"""


def _normal(z: str) -> str:
    """The standard normal distribution function by its series of odd powers."""
    terms = f"[exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(CAST(2 * k + 2 AS DOUBLE)) + k * ln(2.0) + lgamma(CAST(k + 1 AS DOUBLE))) for k in range(0, 250)]"
    return f"(0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum({terms}))"


def adf(source: str) -> str:
    """Clauses up to adf (signal_id, pvalue) of the augmented Dickey-Fuller test; they need WITH RECURSIVE."""
    return f"""adf_y AS (SELECT signal_id, list(value ORDER BY timestamp, value) AS y, count(*) AS n FROM {source} GROUP BY signal_id),
 adf_most AS (SELECT *, CAST(least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 2) AS BIGINT) AS lags FROM adf_y),
 adf_able AS (SELECT * FROM adf_most WHERE lags >= 0 AND list_max(y) > list_min(y)),
 {_swept("adf_all", "adf_able")},
 adf_aic AS (SELECT signal_id, k, row_number() OVER (PARTITION BY signal_id ORDER BY size * (ln(rss / size) + {math.log(2 * math.pi)!r} + 1) + 2 * (k + 2), k) AS place FROM adf_all_fit),
 adf_best AS (SELECT a.signal_id, a.y, a.n, CAST(b.k AS BIGINT) AS lags FROM adf_able a JOIN adf_aic b ON a.signal_id = b.signal_id AND b.place = 1),
 {_swept("adf_one", "adf_best")},
 adf_t AS (SELECT signal_id, beta / sqrt(rss / (size - lags - 2) / sxx) AS t FROM adf_one_fit WHERE k = lags AND size > lags + 2),
 adf_z AS (SELECT signal_id, t, CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END AS z FROM adf_t),
 adf AS (SELECT y.signal_id, CASE WHEN t IS NULL OR t > 2.74 THEN 1.0 WHEN t < -18.83 THEN 0.0 ELSE {_normal("z")} END AS pvalue FROM adf_y y LEFT JOIN adf_z z ON y.signal_id = z.signal_id)"""


def stationary() -> str:
    """Clauses up to stationary (signal_id, timestamp, value): normalised differences that reject a unit root."""
    return f"""diffs AS (SELECT * FROM (SELECT signal_id, timestamp, value - lag(value) OVER (PARTITION BY signal_id ORDER BY timestamp, value) AS value FROM signals) q WHERE value IS NOT NULL),
 {adf("diffs")},
 ranked AS (SELECT signal_id, pvalue, row_number() OVER (ORDER BY pvalue, signal_id) AS k, count(*) OVER () AS n FROM adf),
 failed AS (SELECT min(pvalue) AS p FROM ranked WHERE pvalue > 1 - pow(0.95, 1.0 / CAST(n - k + 1 AS DOUBLE))),
 kept AS (SELECT signal_id FROM adf, failed WHERE failed.p IS NULL OR pvalue < failed.p),
 moments AS (SELECT signal_id, avg(value) AS mean, stddev_samp(value) AS sd FROM diffs GROUP BY signal_id),
 stationary AS (SELECT d.signal_id, d.timestamp, (d.value - g.mean) / g.sd AS value FROM diffs d JOIN moments g ON d.signal_id = g.signal_id WHERE d.signal_id IN (SELECT signal_id FROM kept))"""


def detrended(scales: list[float], n_splits: int, eps: float) -> str:
    """Clauses up to detrended (signal_id, timestamp, value) of a process whose scales all signals share.

    Kernels depend on point numbers only, so each scale has one inverse triangle W for all signals and
    folds: a prediction from the first s points is the sum over i < s of (W k)_i (W y)_i.
    """
    listed = ", ".join(f"({i}, CAST({s!r} AS DOUBLE))" for i, s in enumerate(scales))
    cell = f"exp((i - j) * (i - j) / (-2.0 * scale * scale)) + CASE WHEN i = j THEN {eps!r} ELSE 0.0 END"
    return f"""gp_y AS (SELECT signal_id, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY timestamp, value) - 1 AS BIGINT) AS t, value FROM signals),
 gp_n AS (SELECT signal_id, count(*) AS n, count(*) // {n_splits + 1} AS step FROM gp_y GROUP BY signal_id),
 gp_top AS (SELECT max(n) AS top FROM gp_n),
 gp_scale AS (SELECT * FROM (VALUES {listed}) v(which, scale)),
 gp_sweep AS (SELECT which, top, CAST(0 AS BIGINT) AS k, [list_concat([{cell} for j in range(0, top)], [CASE WHEN i = j THEN 1.0 ELSE 0.0 END for j in range(0, top)]) for i in range(0, top)] AS rows FROM gp_scale, gp_top
  UNION ALL SELECT which, top, k + 1, [[row[j] - rows[1][j] * (row[k + 1] / rows[1][k + 1]) for j in range(1, 2 * top + 1)] for row in rows[2:]] FROM gp_sweep WHERE k + 1 < top),
 gp_w AS (SELECT which, k AS i, unnest(range(0, k + 1)) AS j, unnest([x / sqrt(rows[1][k + 1]) for x in rows[1][top + 1:top + k + 1]]) AS w FROM gp_sweep),
 gp_g AS (SELECT w.which, x.x, w.i, sum(w.w * exp((x.x - w.j) * (x.x - w.j) / (-2.0 * s.scale * s.scale))) AS g FROM gp_w w JOIN gp_scale s ON w.which = s.which, (SELECT unnest(range(0, top)) AS x FROM gp_top) x GROUP BY w.which, x.x, w.i),
 gp_z AS (SELECT w.which, y.signal_id, w.i, sum(w.w * y.value) AS z FROM gp_w w JOIN gp_y y ON w.j = y.t JOIN gp_n n ON y.signal_id = n.signal_id AND w.i < n.n GROUP BY w.which, y.signal_id, w.i),
 gp_fold AS (SELECT signal_id, n - ({n_splits} - f) * step AS s, step FROM gp_n, (SELECT unnest(range(0, {n_splits})) AS f) q),
 gp_guess AS (SELECT z.which, z.signal_id, f.s, y.t, any_value(y.value) AS value, sum(g.g * z.z) AS mean FROM gp_fold f JOIN gp_y y ON f.signal_id = y.signal_id AND y.t >= f.s AND y.t < f.s + f.step
  JOIN gp_z z ON z.signal_id = f.signal_id AND z.i < f.s JOIN gp_g g ON g.which = z.which AND g.x = y.t AND g.i = z.i GROUP BY z.which, z.signal_id, f.s, y.t),
 gp_error AS (SELECT which, signal_id, avg(error) AS error FROM (SELECT which, signal_id, s, avg((value - mean) * (value - mean)) AS error FROM gp_guess GROUP BY which, signal_id, s) q GROUP BY which, signal_id),
 gp_best AS (SELECT signal_id, which FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY error, which) AS place FROM gp_error) q WHERE place = 1),
 detrended AS (SELECT y.signal_id, CAST(y.t AS DOUBLE) AS timestamp, any_value(y.value) - sum(g.g * z.z) AS value FROM gp_best b JOIN gp_y y ON b.signal_id = y.signal_id JOIN gp_z z ON z.signal_id = b.signal_id AND z.which = b.which
  JOIN gp_g g ON g.which = z.which AND g.x = y.t AND g.i = z.i GROUP BY y.signal_id, y.t)"""


def shared_scales(seed: int, low: float, high: float, n: int) -> list[float]:
    """The length scales that all signals share: parameters to the SQL, which has no such generator."""
    return [float(s) for s in np.random.default_rng([seed]).uniform(low, high, n)]


def criterion(m: int, rs: str, name: str = "cp") -> str:
    """Clauses up to `name` (signal_id, r, cp, sd, objective) for the tolerances of the relation `rs`.

    All pairs' runs as rows; the counts of overlapping pairs are sums over a point and one d + 1 later.
    """
    p, width = name, 2 * (m + 1)
    return f"""{p}_x AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY timestamp, value) - 1 AS i, count(*) OVER (PARTITION BY signal_id) AS n, value AS x FROM signals),
 {p}_near AS (SELECT a.signal_id, r.r, a.n, a.i, b.i - a.i AS lag, abs(a.x - b.x) < r.r AS near FROM {p}_x a JOIN {p}_x b ON a.signal_id = b.signal_id AND a.i < b.i CROSS JOIN {rs} r),
 {p}_run AS (SELECT signal_id, r, n, i, lag, i - coalesce(max(CASE WHEN NOT near THEN i END) OVER (PARTITION BY signal_id, r, lag ORDER BY i), -1) AS run FROM {p}_near),
 {p}_hit AS (SELECT u.*, q.q FROM {p}_run u JOIN (VALUES ({m - 1}), ({m})) q(q) ON u.run > q.q),
 {p}_ahead AS (SELECT signal_id, r, q, i, count(*) AS c FROM {p}_hit GROUP BY signal_id, r, q, i),
 {p}_behind AS (SELECT signal_id, r, q, i + lag AS i, count(*) AS c FROM {p}_hit GROUP BY signal_id, r, q, i + lag),
 {p}_cell AS (SELECT x.signal_id, r.r, x.n, x.i, q.q, coalesce(h.c, 0) AS ahead, coalesce(e.c, 0) AS behind FROM {p}_x x CROSS JOIN {rs} r CROSS JOIN (VALUES ({m - 1}), ({m})) q(q)
  LEFT JOIN {p}_ahead h ON h.signal_id = x.signal_id AND h.r = r.r AND h.q = q.q AND h.i = x.i LEFT JOIN {p}_behind e ON e.signal_id = x.signal_id AND e.r = r.r AND e.q = q.q AND e.i = x.i),
 {p}_d AS (SELECT unnest(range(0, {m})) AS d),
 {p}_in AS (SELECT signal_id, r, q, i + lag AS i, d, count(*) AS c FROM {p}_hit JOIN {p}_d ON lag <= 2 * (d + 1) WHERE i + lag >= {width} OR i > 0 GROUP BY signal_id, r, q, i + lag, d),
 {p}_out AS (SELECT c.signal_id, c.r, c.q, c.i, d.d, count(*) AS c FROM {p}_cell c CROSS JOIN {p}_d d JOIN {p}_hit h ON h.signal_id = c.signal_id AND h.r = c.r AND h.q = c.q AND h.lag <= 2 * d.d + 1 AND h.i = least(c.i, c.n - 1 - h.lag) WHERE c.i <= c.n - 2 GROUP BY c.signal_id, c.r, c.q, c.i, d.d),
 {p}_term AS (SELECT l.signal_id, l.r, l.q, sum(2 * (l.ahead + l.behind - coalesce(n.c, 0)) * (e.ahead - coalesce(o.c, 0) + e.behind)) AS s FROM {p}_cell l CROSS JOIN {p}_d d JOIN {p}_cell e ON e.signal_id = l.signal_id AND e.r = l.r AND e.q = l.q AND e.i = l.i - d.d - 1
  LEFT JOIN {p}_in n ON n.signal_id = l.signal_id AND n.r = l.r AND n.q = l.q AND n.i = l.i AND n.d = d.d LEFT JOIN {p}_out o ON o.signal_id = e.signal_id AND o.r = e.r AND o.q = e.q AND o.i = e.i AND o.d = d.d GROUP BY l.signal_id, l.r, l.q),
 {p}_own AS (SELECT signal_id, r, n, q, sum((ahead + behind) * (ahead + behind - 1)) AS s FROM {p}_cell GROUP BY signal_id, r, n, q),
 {p}_pairs AS (SELECT o.signal_id, o.r, o.n, max(CASE WHEN o.q = {m - 1} THEN o.s + t.s END) AS first, max(CASE WHEN o.q = {m} THEN o.s + t.s END) AS second FROM {p}_own o JOIN {p}_term t ON o.signal_id = t.signal_id AND o.r = t.r AND o.q = t.q GROUP BY o.signal_id, o.r, o.n),
 {p}_ab AS (SELECT signal_id, r, count(CASE WHEN q = {m} THEN 1 END) AS a, count(CASE WHEN q = {m - 1} AND i + lag < n - 1 THEN 1 END) AS b FROM {p}_hit GROUP BY signal_id, r),
 {p}_ratio AS (SELECT w.signal_id, w.r, CAST(w.first AS DOUBLE) AS first, CAST(w.second AS DOUBLE) AS second, CASE WHEN w.n >= {width} AND c.b > 0 THEN CAST(c.b AS DOUBLE) END AS b, CASE WHEN w.n >= {width} AND c.b > 0 THEN CAST(c.a AS DOUBLE) / c.b END AS cp FROM {p}_pairs w LEFT JOIN {p}_ab c ON w.signal_id = c.signal_id AND w.r = c.r),
 {p}_sd AS (SELECT signal_id, r, cp, CASE WHEN cp IS NOT NULL THEN sqrt(cp * (1 - cp) / b + greatest(0, (second - first * cp * cp) / (b * b))) END AS sd FROM {p}_ratio),
 {p} AS (SELECT signal_id, r, cp, sd, CASE WHEN cp > 0 THEN greatest(sd / cp, CASE WHEN cp = 1 THEN 0.0 ELSE sd / cp / -ln(cp) END) END AS objective FROM {p}_sd)"""


def values(numbers: list[float]) -> str:
    """A relation with the numbers as its column r."""
    return f"(SELECT CAST(r AS DOUBLE) AS r FROM (VALUES {', '.join(f'({float(x)!r}::DOUBLE)' for x in numbers)}) v(r))"


def best_tolerance(rs: list[float], points: list[float], m: int) -> str:
    """Clauses up to star (signal_id, r, cp, sd, objective) at the first least point of the interpolated medians."""
    return f"""{criterion(m, values(rs), "curve")},
 medians AS (SELECT r, CASE WHEN count(*) = count(objective) THEN median(objective) END AS y FROM curve GROUP BY r),
 ends AS (SELECT r, y, lead(r) OVER (ORDER BY r) AS r1, lead(y) OVER (ORDER BY r) AS y1 FROM medians),
 points AS (SELECT p.r, CASE WHEN e.r1 IS NULL THEN e.y ELSE (e.y1 - e.y) / (e.r1 - e.r) * (p.r - e.r) + e.y END AS y FROM {values(points)} p JOIN ends e ON p.r >= e.r AND (e.r1 IS NULL OR p.r < e.r1)),
 best AS (SELECT r FROM points WHERE y IS NOT NULL ORDER BY y, r LIMIT 1),
 {criterion(m, "best", "star")}"""
