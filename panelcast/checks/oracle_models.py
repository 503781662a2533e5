"""Oracle SQL of the per-series models: the same fits by window functions, aggregates and recursion in DuckDB.

Where Spark maps one Gram matrix (ARIMA) or takes differences of calendar sums (additive model), the SQL sums every
product from the series' own rows.
"""

from __future__ import annotations

import math

from panelcast.checks.oracle import ORACLE, no_negative_zero
from panelcast.checks.views_sql import with_views

LONG = 12
Z95, Z80 = "1.959963984540054::DOUBLE", "1.2815515655446004::DOUBLE"


def recursive(name: str, *views: str, body: str) -> None:
    """``body`` continues the WITH clause of the views (it begins with a comma)."""
    text = with_views(*views).rstrip("\n") + body
    ORACLE[name] = no_negative_zero(text.replace("WITH ", "WITH RECURSIVE ", 1))


def gauss(name: str, source: str, size: str, keep: str = "unique_id") -> str:
    """CTE ``name``: the rows of ``source`` (keep, m: an augmented matrix) after Gauss-Jordan steps on ``size`` pivots;
    NULL once a pivot is as good as zero."""
    return f""",
{name}_r AS (
  SELECT {keep}, 0 AS k, CAST(m AS DOUBLE[][]) AS m, list_transform(m, lambda row, i: row[i]) AS dg, CAST({size} AS INTEGER) AS z FROM {source}
  UNION ALL
  SELECT {keep}, k + 1, CASE WHEN abs(m[k + 1][k + 1]) > 1e-10 * abs(dg[k + 1]) THEN
      list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
        ELSE list_transform(row, lambda x, j: x - row[k + 1] * (m[k + 1][j] / m[k + 1][k + 1])) END) END, dg, z
  FROM {name}_r WHERE k < z),
{name} AS MATERIALIZED (SELECT {keep}, m FROM {name}_r WHERE k = z)"""


def products(names: list[str], prefix: str = "s") -> str:
    return ", ".join(f"sum({a} * {b}) AS {prefix}_{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if j >= i)


def matrix(n: int, rows: int, prefix: str = "s") -> str:
    return "[" + ", ".join("[" + ", ".join(f"{prefix}_{min(i, j)}_{max(i, j)}" for j in range(n)) + "]" for i in range(rows)) + "]"


# ---------------------------------------------------------------- ARIMA
_X = ["one", *[f"l{k}" for k in range(1, LONG + 1)], "y"]
#: Series with their lags and the residuals of the long autoregression.
_SERIES = f"""
, s AS MATERIALIZED (
  SELECT *, 1.0::DOUBLE AS one, row_number() OVER w AS t, count(*) OVER (PARTITION BY unique_id) AS n,
         {", ".join(f"lag(y, {k}) OVER w AS l{k}" for k in range(1, LONG + 1))}
  FROM (SELECT item_id || '_' || store_id AS unique_id, date AS ds, CAST(sales AS DOUBLE) AS y FROM panel_dense
        WHERE date < (SELECT cut FROM cutoff)) z WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
facts AS MATERIALIZED (SELECT unique_id, count(*) AS n_days, max(ds) AS last, avg(y) AS mean, var_pop(y) AS variance, list(y ORDER BY ds) AS ys
          FROM s GROUP BY unique_id),
g1 AS (SELECT unique_id, {products(_X)} FROM s WHERE l{LONG} IS NOT NULL GROUP BY unique_id),
m1 AS (SELECT unique_id, {matrix(LONG + 2, LONG + 1)} AS m FROM g1)""" + gauss("long", "m1", str(LONG + 1)) + f""",
e AS MATERIALIZED (
  SELECT s.*, CASE WHEN l{LONG} IS NOT NULL THEN y - (m[1][{LONG + 2}]{"".join(f" + m[{k + 1}][{LONG + 2}] * l{k}" for k in range(1, LONG + 1))}) END AS e
  FROM s LEFT JOIN long USING (unique_id))"""

_FC = """
SELECT f.unique_id, CAST(last + h AS DATE) AS ds, CAST(h AS INTEGER) AS h, round(greatest(yhat, 0.0), 6) AS yhat,
       round(greatest(yhat - half, 0.0), 6) AS yhat_lower, round(greatest(yhat + half, 0.0), 6) AS yhat_upper, status FROM ("""

recursive("fc_arima", "panel_dense", "cutoff", body=_SERIES + f""",
v AS (SELECT unique_id, ds, y, e, y - l1 AS w, l1 - l2 AS w1, l7 - l8 AS w7, l8 - l9 AS w8, lag(e, 1) OVER (PARTITION BY unique_id ORDER BY ds) AS e1
      FROM e),
g2 AS (SELECT unique_id, count(*) AS n_rows, {products(["w1", "w7", "w8", "e1", "w"])} FROM v WHERE e1 IS NOT NULL GROUP BY unique_id),
m2 AS (SELECT unique_id, n_rows, s_4_4 AS ww, {matrix(5, 4)} AS m FROM g2)""" + gauss("fine", "m2", "4") + """,
c AS (SELECT unique_id, n_rows, f.m[1][5] AS a1, f.m[2][5] AS a7, f.m[3][5] AS a8, f.m[4][5] AS b1,
             ww - f.m[1][5] * m2.m[1][5] - f.m[2][5] * m2.m[2][5] - f.m[3][5] * m2.m[3][5] - f.m[4][5] * m2.m[4][5] AS rss
      FROM m2 JOIN fine f USING (unique_id)),
z AS MATERIALIZED (
  SELECT facts.unique_id, n_days, last, mean, variance, a1, a7, a8, b1, rss / n_rows AS sigma2, ys[len(ys) - 9:] AS tail, le.e AS e_last,
         CASE WHEN variance = 0 THEN 'constant' WHEN n_days - 13 <= 4 THEN 'too_short' WHEN a1 IS NULL OR NOT rss > 0 THEN 'singular' ELSE 'ok' END AS status
  FROM facts LEFT JOIN c USING (unique_id) LEFT JOIN (SELECT unique_id, arg_max(e, ds) AS e FROM e GROUP BY 1) le USING (unique_id)),
f AS (SELECT unique_id, 0 AS h, tail AS u, CAST([0, 0, 0, 0, 0, 0, 0, 0, 0, 1] AS DOUBLE[]) AS p, 0.0::DOUBLE AS acc FROM z WHERE status = 'ok'
      UNION ALL
      SELECT f.unique_id, h + 1,
        list_append(u, u[len(u)] + a1 * (u[len(u)] - u[len(u) - 1]) + a7 * (u[len(u) - 6] - u[len(u) - 7]) + a8 * (u[len(u) - 7] - u[len(u) - 8])
                       + CASE WHEN h = 0 THEN b1 * e_last ELSE 0.0 END),
        list_append(p, p[len(p)] + a1 * (p[len(p)] - p[len(p) - 1]) + a7 * (p[len(p) - 6] - p[len(p) - 7]) + a8 * (p[len(p) - 7] - p[len(p) - 8])
                       + CASE WHEN h = 0 THEN b1 ELSE 0.0 END),
        acc + p[len(p)] * p[len(p)]
      FROM f JOIN z USING (unique_id) WHERE h < 28)""" + _FC + f"""
  SELECT unique_id, h, u[len(u)] AS yhat, {Z95} * sqrt(sigma2 * acc) AS half FROM f JOIN z USING (unique_id) WHERE h > 0
  UNION ALL SELECT unique_id, CAST(h AS INTEGER), mean, {Z95} * sqrt(variance) FROM z, range(1, 29) r(h) WHERE status <> 'ok') f JOIN z USING (unique_id)
""")
ORACLE["arima_roundtrip"] = ORACLE["fc_arima"]
# who isn't simply fitted, by model: the ARIMA's statuses as above, the others by days and variance
ORACLE["run_failures"] = ORACLE["fc_arima"].split("\nf AS (SELECT unique_id, 0 AS h")[0].rstrip(",\n") + """,
every AS (SELECT DISTINCT item_id || '_' || store_id AS unique_id FROM panel_dense),
n AS (SELECT e.unique_id, f.n_days, f.variance, z.status FROM every e LEFT JOIN facts f USING (unique_id) LEFT JOIN z USING (unique_id))
SELECT * FROM (
  SELECT 'paths' AS model, unique_id, CASE WHEN n_days IS NULL THEN 'missing' WHEN n_days < 7 THEN 'too_short' ELSE 'ok' END AS status FROM n
  UNION ALL SELECT 'seasonal_ar', unique_id, CASE WHEN n_days IS NULL THEN 'missing' WHEN variance = 0 THEN 'constant' WHEN n_days < 12 THEN 'too_short' ELSE 'ok' END FROM n
  UNION ALL SELECT 'additive', unique_id, CASE WHEN n_days IS NULL THEN 'missing' WHEN n_days < 2 THEN 'too_short' WHEN variance = 0 THEN 'constant' ELSE 'ok' END FROM n
  UNION ALL SELECT 'arima', unique_id, coalesce(status, 'missing') FROM n
  UNION ALL SELECT 'broken', unique_id, 'failed' FROM n) WHERE status <> 'ok'
"""

# all orders: the differenced series and their lags from the rows themselves, every order a part of the d-th matrix
_W = {0: lambda k: f"l{k}" if k else "y", 1: lambda k: f"({_W[0](k)} - {_W[0](k + 1)})", 2: lambda k: f"({_W[1](k)} - {_W[1](k + 1)})"}
_N = 15   # 1, w, w lagged 1..10, innovations lagged 1..3


def _order_list() -> str:
    rows = []
    for p in range(4):
        for d in range(3):
            for q in range(4):
                ar = sorted({*range(1, p + 1), *range(7, 8 + p)})
                idx = [*([1] if d == 0 else []), *[2 + k for k in ar], *[12 + k for k in range(1, q + 1)]]
                rows.append(f"({p}, {d}, {q}, {len(rows)}, {idx})")
    return ", ".join(rows)


_ORDERS = _SERIES + """,
v AS MATERIALIZED (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM e
      WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
""" + ",\n".join(
    f"d{d} AS (SELECT unique_id, count(*) AS n_rows, {products(['one', *[_W[d](k) for k in range(11)], 'e1', 'e2', 'e3'])} FROM v "
    "WHERE e3 IS NOT NULL GROUP BY unique_id)" for d in range(3)) + """,
g AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT unique_id, {d} AS d, n_rows, {matrix(_N, _N)} AS g FROM d{d}" for d in range(3)) + f"""),
o AS (SELECT * FROM (VALUES {_order_list()}) t(p, d, q, place, idx)),
sub AS MATERIALIZED (SELECT unique_id, p, d, q, place, idx, n_rows, g[2][2] AS ww, list_transform(idx, lambda i: list_append(list_transform(idx, lambda j: g[i][j]), g[i][2])) AS m
        FROM g JOIN o USING (d))""" + gauss("done", "sub", "len(idx)", "unique_id, p, d, q, place, idx") + """,
a AS (SELECT unique_id, p, d, q, place, len(idx) AS k, n_rows, variance, CASE WHEN n_rows > len(idx) AND rss > 0 THEN n_rows * ln(rss / n_rows) + 2 * (len(idx) + 1) END AS aic FROM (
  SELECT facts.unique_id, o.p, o.d, o.q, o.place, o.idx, sub.n_rows, variance,
         ww - list_sum(list_transform(done.m, lambda row, i: row[len(row)] * sub.m[i][len(row)])) AS rss
  FROM facts CROSS JOIN o LEFT JOIN sub USING (unique_id, p, d, q) LEFT JOIN done USING (unique_id, p, d, q)) x),
best AS (SELECT unique_id, arg_min(place, (aic, place)) AS place FROM a WHERE aic IS NOT NULL AND variance <> 0 GROUP BY unique_id)"""
recursive("arima_orders", "panel_dense", "cutoff", body=_ORDERS + """
SELECT a.unique_id, p, d, q, CAST(k AS INTEGER) AS k, round(aic, 6) AS aic, coalesce(a.place = best.place, FALSE) AS chosen
FROM a LEFT JOIN best USING (unique_id)
""")
recursive("fc_arima_auto", "panel_dense", "cutoff", body=_ORDERS + """
SELECT unique_id, CASE WHEN variance = 0 THEN 'constant' WHEN n_days - 15 <= 1 THEN 'too_short' WHEN place IS NULL THEN 'singular' ELSE 'ok' END AS status,
       CAST(28 AS BIGINT) AS n, CAST(last + 1 AS DATE) AS first_ds, CAST(last + 28 AS DATE) AS last_ds, TRUE AS ordered
FROM facts LEFT JOIN best USING (unique_id)
""")

# ---------------------------------------------------------------- additive model
_DAY = "date_diff('day', DATE '1970-01-01', {d})"
_WAVES = [f"{f}({_DAY} * {2 * math.pi * k / period!r}::DOUBLE)" for period, n in ((7.0, 3), (365.25, 10)) for k in range(1, n + 1) for f in ("sin", "cos")]
_NAMES = ["Christmas", "Halloween", "IndependenceDay", "Parade", "SuperBowl", "ValentinesDay"]
_FEATURES = ["1.0::DOUBLE", "CAST(date_diff('day', (SELECT min(date) FROM calendar), {d}) AS DOUBLE)", *_WAVES]
_NF, _NR, _NH = 2 + 26 + len(_NAMES), 2, 25
_FREE = _NF + _NR


def _features(date: str) -> str:
    flags = [f"CAST(coalesce(event_name_1 = '{x}', FALSE) OR coalesce(event_name_2 = '{x}', FALSE) AS DOUBLE)" for x in _NAMES]
    return "[" + ", ".join([f.format(d=date) for f in _FEATURES] + flags) + "]"


_FIT = f"""
, cal AS MATERIALIZED (SELECT date, {_features("date")} AS f FROM calendar),
s AS MATERIALIZED (
  SELECT unique_id, ds, y, price, snap, f, lag(y, 7) OVER (PARTITION BY unique_id ORDER BY ds) AS wk, min(ds) OVER u AS first, CAST(count(*) OVER u AS DOUBLE) AS n
  FROM (SELECT item_id || '_' || store_id AS unique_id, date AS ds, CAST(sales AS DOUBLE) AS y, CAST(sell_price AS DOUBLE) AS price,
               CAST(CASE state_id WHEN 'AFRICA' THEN snap_AFRICA WHEN 'AMERICA' THEN snap_AMERICA WHEN 'ASIA' THEN snap_ASIA WHEN 'EUROPE' THEN snap_EUROPE
                    WHEN 'MIDDLE EAST' THEN snap_MIDDLE_EAST ELSE FALSE END AS DOUBLE) AS snap
        FROM panel_dense WHERE date < (SELECT cut FROM cutoff)) z JOIN cal ON cal.date = ds
  WINDOW u AS (PARTITION BY unique_id)),
kn AS (SELECT DISTINCT unique_id, first, list_transform(range(1, 26), lambda j: CAST(floor((floor(n * 0.8::DOUBLE) - 1) * j / 25.0::DOUBLE + 0.5::DOUBLE) AS INTEGER)) AS kd FROM s),
x AS (SELECT unique_id, list(y ORDER BY ds) AS ys,
             list(list_concat(f, [price, snap], list_transform(kd, lambda k: greatest(date_diff('day', s.first, ds) - k, 0)::DOUBLE)) ORDER BY ds) AS rows,
             count(*) AS n, min(s.first) AS first, max(ds) AS last, avg(y) AS mean, var_pop(y) AS variance, max(abs(y)) AS scale, avg(pow(y - wk, 2)) AS noise,
             avg(price) AS price_mean, avg(snap) AS snap_mean, avg(price * price) AS price_sq, avg(snap * snap) AS snap_sq, any_value(kd) AS kd
      FROM s JOIN kn USING (unique_id) GROUP BY unique_id),
cols AS (SELECT * EXCLUDE (rows), list_transform(range(1, {_FREE + _NH + 1}), lambda i: list_transform(rows, lambda r: r[i])) AS xs FROM x),
full_m AS MATERIALIZED (SELECT *, list_transform(xs, lambda a: list_append(list_transform(xs, lambda b: list_dot_product(a, b)), list_dot_product(a, ys))) AS g,
             list_dot_product(ys, ys) AS yy, greatest(coalesce(noise / 2, variance) / nullif(pow(scale, 2), 0), 1e-8::DOUBLE) AS nz, greatest(n - 1, 1.0)::DOUBLE AS span
      FROM cols),
pen AS (SELECT unique_id, list_transform(g, lambda row, i: list_transform(row, lambda v, j: CASE WHEN i <> j OR i > {_FREE} THEN v
               WHEN i = 1 THEN v + nz / 25 WHEN i = 2 THEN v + nz * span * span / 25
               WHEN i = {_NF + 1} THEN v + nz / 100 * greatest(price_sq - price_mean * price_mean, 1e-6 * price_sq, 1e-6)
               WHEN i = {_NF + 2} THEN v + nz / 100 * greatest(snap_sq - snap_mean * snap_mean, 1e-6 * snap_sq, 1e-6)
               ELSE v + nz / 100 END)) AS m FROM full_m)""" + gauss("el", "pen", str(_FREE)) + f""",
small AS MATERIALIZED (SELECT unique_id, list_transform(el.m[{_FREE + 1}:], lambda row: row[{_FREE + 1}:]) AS a, nz * span * scale / 0.05::DOUBLE AS cut
          FROM el JOIN full_m USING (unique_id)),
cd AS (SELECT unique_id, 0 AS k, list_transform(range({_NH}), lambda j: 0.0::DOUBLE) AS b FROM small WHERE a IS NOT NULL
       UNION ALL
       SELECT unique_id, k + 1, list_transform(b, lambda v, i: CASE WHEN i <> k % {_NH} + 1 THEN v WHEN o[i] > 1e-9 THEN sign(gap) * greatest(abs(gap) - cut, 0.0) / o[i] ELSE 0.0 END)
       FROM (SELECT cd.unique_id, k, b, cut, a[k % {_NH} + 1] AS o,
                    a[k % {_NH} + 1][{_NH + 1}] - list_dot_product(a[k % {_NH} + 1][:{_NH}], b) + a[k % {_NH} + 1][k % {_NH} + 1] * b[k % {_NH} + 1] AS gap
             FROM cd JOIN small USING (unique_id) WHERE k < {100 * _NH}) q),
fitted AS MATERIALIZED (
  SELECT full_m.* EXCLUDE (xs, ys), CASE WHEN n < 2 THEN 'too_short' WHEN variance = 0 THEN 'constant' WHEN b IS NULL THEN 'singular' ELSE 'ok' END AS status,
         b AS deltas, list_transform(el.m[:{_FREE}], lambda row: row[{_FREE + _NH + 1}] - list_dot_product(row[{_FREE + 1}:{_FREE + _NH}], b)) AS beta
  FROM full_m LEFT JOIN el USING (unique_id) LEFT JOIN (SELECT unique_id, b FROM cd WHERE k = {100 * _NH}) USING (unique_id)),
model AS MATERIALIZED (
  SELECT unique_id, first, last, status, kd, price_mean, snap_mean, n,
         CASE WHEN status = 'ok' THEN beta ELSE list_concat([mean], list_transform(range({_FREE - 1}), lambda j: 0.0::DOUBLE)) END AS beta,
         CASE WHEN status = 'ok' THEN deltas ELSE list_transform(range({_NH}), lambda j: 0.0::DOUBLE) END AS deltas,
         CASE WHEN status = 'ok' THEN greatest((yy - list_sum(list_transform(g, lambda row, i: list_concat(beta, deltas)[i] *
              (2 * row[{_FREE + _NH + 1}] - list_dot_product(row[:{_FREE + _NH}], list_concat(beta, deltas)))))) / n, 0.0) ELSE variance END AS sigma2,
         CASE WHEN status = 'ok' THEN list_sum(list_transform(deltas, lambda v: abs(v))) / 25 ELSE 0.0 END AS spread
  FROM fitted),
fut AS (SELECT m.*, CAST(h AS INTEGER) AS h, CAST(last + CAST(h AS INTEGER) AS DATE) AS ds FROM model m, range(1, 29) r(h)),
parts AS (SELECT unique_id, ds, h, status,
         beta[1] + beta[2] * f[2] + list_sum(list_transform(deltas, lambda v, j: v * greatest(date_diff('day', first, ds) - kd[j], 0))) AS trend,
         list_dot_product(beta[3:8], f[3:8]) AS weekly, list_dot_product(beta[9:28], f[9:28]) AS yearly,
         list_dot_product(beta[29:{_NF}], f[29:{_NF}]) AS holidays, beta[{_NF + 1}] * price_mean AS part_sell_price, beta[{_NF + 2}] * snap_mean AS part_snap,
         {Z80} * sqrt(sigma2 + 25.0::DOUBLE / greatest(n * 0.8::DOUBLE, 1.0) * 2 * spread * spread * h * (h + 1) * (2 * h + 1) / 6) AS half
         FROM fut JOIN cal ON cal.date = ds)"""
_TOTAL = "trend + weekly + yearly + holidays + part_sell_price + part_snap"
recursive("fc_additive", "panel_dense", "cutoff", "calendar", body=_FIT + f"""
SELECT unique_id, ds, h, round(greatest({_TOTAL}, 0.0), 3) AS yhat, round(greatest({_TOTAL} - half, 0.0), 3) AS yhat_lower,
       round(greatest({_TOTAL} + half, 0.0), 3) AS yhat_upper, status FROM parts
""")
recursive("additive_components", "panel_dense", "cutoff", "calendar", body=_FIT + """
SELECT unique_id, ds, round(trend, 3) AS trend, round(weekly, 3) AS weekly, round(yearly, 3) AS yearly, round(holidays, 3) AS holidays,
       round(part_sell_price, 3) AS part_sell_price, round(part_snap, 3) AS part_snap, TRUE AS adds_up FROM parts
""")
recursive("additive_changepoints", "panel_dense", "cutoff", "calendar", body=_FIT + """
SELECT unique_id, CAST(j AS INTEGER) AS knot, CAST(first + kd[j] AS DATE) AS ds, round(deltas[j], 3) AS delta FROM model, range(1, 26) r(j)
""")
