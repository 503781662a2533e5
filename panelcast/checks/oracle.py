"""DuckDB oracle SQL, one per registered query (same name, same column names).

Double columns are rounded to 6 decimals, as the Spark side does.
"""

from __future__ import annotations

from panelcast.checks.views_sql import lag_days, lag_from, q

ORACLE: dict[str, str] = {}

PANEL_COLS = ["item_id", "dept_id", "cat_id", "store_id", "state_id", "d", "sales", "date",
              "wm_yr_wk", "weekday", "wday", "month", "year", "event_name_1", "event_type_1",
              "event_name_2", "event_type_2", "snap_AFRICA", "snap_AMERICA", "snap_ASIA",
              "snap_EUROPE", "snap_MIDDLE_EAST", "sell_price"]
PANEL_NO_PRICE = [c for c in PANEL_COLS if c != "sell_price"]
SER = "PARTITION BY item_id, store_id ORDER BY date"


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def no_negative_zero(text: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB may round a tiny
    negative value to -0.0 where Spark gives 0.0; adding 0.0 clears the sign."""
    out, i = [], 0
    while True:
        j = text.find("round(", i)
        if j < 0 or (j > 0 and (text[j - 1].isalnum() or text[j - 1] == "_")):
            if j < 0:
                out.append(text[i:])
                return "".join(out)
            out.append(text[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if text[k] == "(":
                depth += 1
            elif text[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = no_negative_zero(text[j + 6:k])
        out.append(text[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def sql(name: str, *views: str, body: str) -> None:
    if name in ORACLE:
        raise ValueError(f"duplicate oracle {name}")
    ORACLE[name] = no_negative_zero(q(*views, body=body))


def panel_select(extra: str = "", price: bool = True) -> str:
    cols = [c for c in PANEL_COLS if price or c != "sell_price"]
    out = ", ".join(cols if not price else [*PANEL_NO_PRICE, r6("sell_price", "sell_price")])
    return out + (", " + extra if extra else "")


# ---------------------------------------------------------------- sources / sinks
sql("scan_sales", "sales_full", body="SELECT * FROM sales_full")

sql("scan_calendar", "calendar", body="SELECT * FROM calendar")
sql("scan_prices", "prices", body="SELECT store_id, item_id, wm_yr_wk, "
    + r6("sell_price", "sell_price") + " FROM prices")
sql("sink_roundtrip", "sales_long", body="SELECT * FROM sales_long")

# ---------------------------------------------------------------- reshapes / filters
sql("melt_sales", "sales_full", body="SELECT * FROM sales_full")

DATED = "(SELECT s.*, c.date FROM sales_long s LEFT JOIN calendar c ON s.d = c.d)"

sql("filter_store_cat", "sales_long", "calendar", body=f"""
SELECT item_id, store_id, cat_id, date, sales FROM {DATED} t
WHERE store_id IN (SELECT store_id FROM (SELECT DISTINCT store_id FROM sales_long
                                         ORDER BY store_id LIMIT 3))
""")

sql("filter_dates", "sales_long", "calendar", "bounds", body=f"""
SELECT item_id, store_id, date, sales FROM {DATED} t
WHERE date BETWEEN CAST((SELECT hi FROM bounds) - 364 AS DATE) AND (SELECT hi FROM bounds)
""")

sql("filter_options", "sales_long", "calendar", body=f"""
SELECT DISTINCT 'store' AS kind, store_id AS value FROM sales_long
UNION ALL SELECT DISTINCT 'category', cat_id FROM sales_long
UNION ALL SELECT 'min_date', CAST(min(date) AS VARCHAR) FROM {DATED} t
UNION ALL SELECT 'max_date', CAST(max(date) AS VARCHAR) FROM {DATED} t
""")

sql("split_train", "panel", "cutoff", body=f"""
SELECT {panel_select()} FROM panel WHERE date < (SELECT cut FROM cutoff)
""")
sql("split_test", "panel", "cutoff", body=f"""
SELECT {panel_select()} FROM panel WHERE date >= (SELECT cut FROM cutoff)
""")
sql("split_valid_flag", "panel", "cutoff", body="""
SELECT item_id, store_id, date,
       date >= CAST((SELECT cut FROM cutoff) - 1 - 27 AS DATE) AS is_valid
FROM panel WHERE date < (SELECT cut FROM cutoff)
""")
sql("drop_null_target", "merged", body="""
SELECT item_id, store_id, d, round(sell_price, 6) AS sell_price FROM merged
WHERE sell_price IS NOT NULL
""")
sql("to_series_frame", "panel", body="""
SELECT item_id || '_' || store_id AS unique_id, date AS ds, CAST(sales AS DOUBLE) AS y FROM panel
""")

FC7 = """(SELECT unique_id, ds, y, yhat FROM (
  SELECT item_id || '_' || store_id AS unique_id, date AS ds, CAST(sales AS DOUBLE) AS y,
         {lag} AS yhat
  FROM panel) t WHERE ds >= (SELECT cut FROM cutoff))"""

sql("clip_nonneg", "panel", "cutoff", body=f"""
SELECT unique_id, ds, round(raw, 6) AS raw,
       round(CASE WHEN raw IS NOT NULL THEN greatest(raw, 0.0) END, 6) AS yhat
FROM (SELECT a.unique_id, a.ds, 2 * a.yhat - b.yhat AS raw
      FROM {FC7.format(lag=lag_from(7))} a JOIN {FC7.format(lag=lag_from(14))} b
      ON a.unique_id = b.unique_id AND a.ds = b.ds) t
""")

sql("residuals", "forecast", body="""
SELECT unique_id, ds, y AS actual, yhat AS predicted, round(y - yhat, 2) AS residual,
       CASE WHEN round(y - yhat, 2) > 0 THEN 'under' WHEN round(y - yhat, 2) < 0 THEN 'over'
            ELSE 'exact' END AS residual_sign
FROM forecast
""")

sql("encode_categories", "sales_long", body="""
SELECT s.item_id, s.store_id, s.d, c.code AS cat_id, p.code AS dept_id
FROM sales_long s
LEFT JOIN (SELECT cat_id, CAST(dense_rank() OVER (ORDER BY cat_id) - 1 AS INTEGER) AS code
           FROM (SELECT DISTINCT cat_id FROM sales_long)) c ON s.cat_id = c.cat_id
LEFT JOIN (SELECT dept_id, CAST(dense_rank() OVER (ORDER BY dept_id) - 1 AS INTEGER) AS code
           FROM (SELECT DISTINCT dept_id FROM sales_long)) p ON s.dept_id = p.dept_id
""")

# ---------------------------------------------------------------- joins
sql("join_calendar", "sales_long", "calendar", body="""
SELECT s.*, c.date, c.wm_yr_wk, c.weekday, c.wday, c.month, c.year, c.event_name_1,
       c.event_type_1, c.event_name_2, c.event_type_2, c.snap_AFRICA, c.snap_AMERICA,
       c.snap_ASIA, c.snap_EUROPE, c.snap_MIDDLE_EAST
FROM sales_long s LEFT JOIN calendar c ON s.d = c.d
""")
sql("join_prices", "merged", body="""
SELECT item_id, store_id, d, wm_yr_wk, round(sell_price, 6) AS sell_price FROM merged
""")
sql("merge_all", "panel", body=f"SELECT {panel_select()} FROM panel")
sql("top_items", "sales_long", body="""
SELECT item_id, CAST(sum(sales) AS BIGINT) AS total_sales FROM sales_long GROUP BY item_id
ORDER BY total_sales DESC, item_id LIMIT 50
""")
sql("keep_top_items", "sales_long", body="""
SELECT * FROM sales_long WHERE item_id IN (
  SELECT item_id FROM sales_long GROUP BY item_id ORDER BY sum(sales) DESC, item_id LIMIT 10)
""")
sql("attach_date", "sales_long", "calendar", body=f"SELECT * FROM {DATED} t")
sql("join_actual_pred", "forecast", body="SELECT unique_id, ds, y, yhat FROM forecast")

# ---------------------------------------------------------------- fills
sql("fill_prices", "panel", body="""
SELECT item_id, store_id, date, round(sell_price, 6) AS sell_price FROM panel
""")
sql("fill_missing", "panel", body="""
SELECT item_id, store_id, date, sales, event_name_1, event_type_1, event_name_2, event_type_2
FROM panel
""")


def _audit(stage: str, view: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{stage}' AS stage, '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM {view}"
        for c in PANEL_COLS)


sql("null_audit", "merged", "panel", body=_audit("before", "merged") + "\nUNION ALL "
    + _audit("after", "panel"))

# ---------------------------------------------------------------- aggregates
sql("item_totals", "sales_long", body="""
SELECT item_id, CAST(sum(sales) AS BIGINT) AS total_sales FROM sales_long GROUP BY item_id
""")
sql("daily_totals", "sales_long", "calendar", body=f"""
SELECT date, CAST(sum(sales) AS BIGINT) AS sales FROM {DATED} t GROUP BY date
""")
sql("store_totals", "sales_long", body="""
SELECT store_id, CAST(sum(sales) AS BIGINT) AS sales FROM sales_long GROUP BY store_id
""")
sql("category_share", "sales_long", body="""
SELECT cat_id, sales, round(sales / sum(sales) OVER (), 6) AS share FROM (
  SELECT cat_id, CAST(sum(sales) AS BIGINT) AS sales FROM sales_long GROUP BY cat_id)
""")
sql("seasonality_dow", "sales_long", "calendar", body=f"""
SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, round(avg(sales), 6) AS mean_value
FROM {DATED} t GROUP BY 1
""")
sql("seasonality_month", "sales_long", "calendar", body=f"""
SELECT CAST(month(date) AS INTEGER) AS month, round(avg(sales), 6) AS mean_value
FROM {DATED} t GROUP BY 1
""")


def _corr_sql(cols: list[str], view: str) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            m = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            xa, xb = f"CASE WHEN {m} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {m} THEN CAST({b} AS DOUBLE) END"
            r = (f"covar_samp({xa}, {xb}) / NULLIF(stddev_samp({xa}) * stddev_samp({xb}), 0)")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({r}, 6) AS corr FROM {view}")
            if a != b:
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, round({r}, 6) AS corr FROM {view}")
    return "\nUNION ALL ".join(parts)


CORR_COLS = ["sales", "wm_yr_wk", "wday", "month", "year", "sell_price"]
sql("correlation_matrix", "panel", body=_corr_sql(CORR_COLS, "panel"))

# ---------------------------------------------------------------- metrics
sql("m_rmse", "forecast", body="""
SELECT unique_id, round(sqrt(avg(pow(y - yhat, 2))), 4) AS RMSE FROM forecast GROUP BY unique_id
""")
sql("m_mae", "forecast", body="""
SELECT unique_id, round(avg(abs(y - yhat)), 4) AS MAE FROM forecast GROUP BY unique_id
""")
sql("m_mape", "forecast", body="""
SELECT unique_id, round(avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100, 4) AS MAPE
FROM forecast GROUP BY unique_id
""")
sql("m_smape", "forecast", body="""
SELECT unique_id, round(COALESCE(avg(CASE WHEN (abs(y) + abs(yhat)) / 2 <> 0
       THEN abs(y - yhat) / ((abs(y) + abs(yhat)) / 2) END) * 100, 0.0), 4) AS sMAPE
FROM forecast GROUP BY unique_id
""")

SCALE = """(SELECT unique_id, COALESCE(avg(pow(dy, 2)), 1.0) AS scale FROM (
  SELECT item_id || '_' || store_id AS unique_id,
         CAST(sales AS DOUBLE) - lag(CAST(sales AS DOUBLE)) OVER (PARTITION BY item_id, store_id ORDER BY date) AS dy
  FROM panel WHERE date < (SELECT cut FROM cutoff)) GROUP BY unique_id)"""

RMSSE = f"""(SELECT f.unique_id, sqrt(avg(pow(f.yhat - f.y, 2)) / greatest(COALESCE(max(s.scale), 1.0), 1e-8)) AS rmsse
  FROM forecast f LEFT JOIN {SCALE} s ON f.unique_id = s.unique_id GROUP BY f.unique_id)"""

sql("m_rmsse", "forecast", "panel", "cutoff", body=f"""
SELECT unique_id, round(rmsse, 4) AS RMSSE FROM {RMSSE} r
""")

WEIGHTS = """(SELECT item_id || '_' || store_id AS unique_id, sum(sales * sell_price) AS weight
  FROM panel WHERE date < (SELECT cut FROM cutoff) AND date >= CAST((SELECT cut FROM cutoff) - 28 AS DATE)
  GROUP BY 1)"""

sql("m_wrmsse", "forecast", "panel", "cutoff", body=f"""
SELECT round(sum(w.weight * r.rmsse) / sum(CASE WHEN r.rmsse IS NOT NULL THEN w.weight END), 4) AS WRMSSE
FROM {RMSSE} r LEFT JOIN {WEIGHTS} w ON r.unique_id = w.unique_id
""")

FC_STORE = f"""(SELECT unique_id, store_id, ds, y, yhat FROM (
  SELECT item_id || '_' || store_id AS unique_id, store_id, date AS ds, CAST(sales AS DOUBLE) AS y,
         {lag_days(28)} AS yhat
  FROM panel) t WHERE ds >= (SELECT cut FROM cutoff))"""

sql("evaluate_all", "panel", "cutoff", body=f"""
SELECT e.store_id, round(sqrt(avg(pow(e.y - e.yhat, 2))), 4) AS RMSE,
       round(avg(abs(e.y - e.yhat)), 4) AS MAE,
       round(avg(CASE WHEN e.y <> 0 THEN abs((e.y - e.yhat) / e.y) END) * 100, 4) AS MAPE,
       round(COALESCE(avg(CASE WHEN (abs(e.y) + abs(e.yhat)) / 2 <> 0
             THEN abs(e.y - e.yhat) / ((abs(e.y) + abs(e.yhat)) / 2) END) * 100, 0.0), 4) AS sMAPE,
       round(max(r.wr), 4) AS WRMSSE
FROM {FC_STORE} e
JOIN (SELECT f.store_id, avg(f.rmsse) AS wr FROM (
        SELECT g.store_id, g.unique_id,
               sqrt(avg(pow(g.yhat - g.y, 2)) / greatest(COALESCE(max(s.scale), 1.0), 1e-8)) AS rmsse
        FROM {FC_STORE} g LEFT JOIN {SCALE} s ON g.unique_id = s.unique_id
        GROUP BY g.store_id, g.unique_id) f GROUP BY f.store_id) r ON e.store_id = r.store_id
GROUP BY e.store_id
""")

sql("m_card_metrics", "forecast", body="""
SELECT round(sqrt(avg(pow(actual - predicted, 2))), 2) AS RMSE,
       round(avg(abs(actual - predicted)), 2) AS MAE,
       round(avg(abs((actual - predicted) / CASE WHEN actual = 0 THEN 1.0 ELSE actual END)) * 100, 1) AS MAPE
FROM (SELECT ds, sum(y) AS actual, sum(yhat) AS predicted FROM forecast GROUP BY ds)
""")

# ---------------------------------------------------------------- features
LAGS = [7, 14, 28, 90, 365]
WINS = [7, 14, 28]


def lag_sql() -> str:
    return ", ".join(f"CAST(lag(sales, {L}) OVER ({SER}) AS DOUBLE) AS lag_{L}" for L in LAGS)


def rolling_sql() -> str:
    out = []
    for W in WINS:
        fr = f"({SER} ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING)"
        out += [r6(f"avg(CAST(sales AS DOUBLE)) OVER {fr}", f"rolling_mean_{W}"),
                r6(f"stddev_samp(CAST(sales AS DOUBLE)) OVER {fr}", f"rolling_std_{W}"),
                f"CAST(min(sales) OVER {fr} AS DOUBLE) AS rolling_min_{W}",
                f"CAST(max(sales) OVER {fr} AS DOUBLE) AS rolling_max_{W}"]
    return ", ".join(out)


CAL_SQL = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(month(date) AS INTEGER) AS month,
CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
CAST(last_day(date) = date AS INTEGER) AS is_month_end"""

PRICE_INNER = f"""(SELECT *, COALESCE(sell_price / NULLIF(lag(sell_price) OVER ({SER}), 0) - 1, 0.0) AS price_change
  FROM panel)"""
PRICE_SQL = f"""round(price_change, 6) AS price_change,
round(avg(price_change) OVER ({SER} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 6) AS price_momentum,
round(COALESCE(sell_price / NULLIF(avg(sell_price) OVER (PARTITION BY item_id, store_id), 0), 1.0), 6) AS price_norm,
round(COALESCE(stddev_samp(sell_price) OVER ({SER} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 0.0), 6) AS price_std"""

EVENT_TYPES = ["Cultural", "National", "Sporting"]
EVENT_SQL = ("CAST(event_name_1 IS NOT NULL AND event_name_1 <> 'NoEvent' AS INTEGER) AS has_event, "
             + ", ".join(f"COALESCE(CAST(event_type_1 = '{v}' AS INTEGER), 0) AS event_type_{v}"
                         for v in EVENT_TYPES)
             + """, CASE WHEN state_id = 'AFRICA' THEN CAST(snap_AFRICA AS INTEGER)
                  WHEN state_id = 'AMERICA' THEN CAST(snap_AMERICA AS INTEGER)
                  WHEN state_id = 'ASIA' THEN CAST(snap_ASIA AS INTEGER)
                  WHEN state_id = 'EUROPE' THEN CAST(snap_EUROPE AS INTEGER)
                  WHEN state_id = 'MIDDLE EAST' THEN CAST(snap_MIDDLE_EAST AS INTEGER)
                  ELSE 0 END AS snap""")

sql("feat_lags", "panel", body=f"SELECT item_id, store_id, date, sales, {lag_sql()} FROM panel")
sql("feat_rolling", "panel", body=f"SELECT item_id, store_id, date, sales, {rolling_sql()} FROM panel")
sql("feat_calendar", "panel", body=f"SELECT item_id, store_id, date, {CAL_SQL} FROM panel")
sql("feat_price", "panel", body=f"""
SELECT item_id, store_id, date, round(sell_price, 6) AS sell_price, {PRICE_SQL} FROM {PRICE_INNER} t
""")
sql("feat_events", "panel", body=f"SELECT item_id, store_id, date, {EVENT_SQL} FROM panel")

BUILD_COLS = [c for c in PANEL_NO_PRICE if c not in ("month", "year")]
sql("build_features", "panel", body=f"""
SELECT {", ".join(BUILD_COLS)}, round(sell_price, 6) AS sell_price, {lag_sql()}, {rolling_sql()},
       {CAL_SQL}, {PRICE_SQL}, {EVENT_SQL}
FROM {PRICE_INNER} t
""")

ORACLE["flagship_store_scores"] = ORACLE["evaluate_all"]

# ---------------------------------------------------------------- leaderboard family
BOARD_LAGS = (7, 14, 28)
FC_CAT = """(SELECT unique_id, cat_id, ds, y, yhat FROM (
  SELECT item_id || '_' || store_id AS unique_id, cat_id, date AS ds, CAST(sales AS DOUBLE) AS y,
         {lag} AS yhat
  FROM panel) t WHERE ds >= (SELECT cut FROM cutoff))"""
FCS = "(" + " UNION ALL ".join(f"SELECT 'lag_{L}' AS model, * FROM {FC_CAT.format(lag=lag_from(L))} f{L}"
                                for L in BOARD_LAGS) + ")"


def _scores(group: list[str], label_all: bool = False) -> str:
    """Metrics per group (over all board forecasts); WRMSSE = mean per-series RMSSE."""
    g = ", ".join(group)
    ge = ", ".join(f"e.{c}" for c in group)
    on = " AND ".join(f"e.{c} = r.{c}" for c in group)
    extra = ", 'ALL' AS cat_id" if label_all else ""
    return f"""(SELECT {ge}{extra}, round(sqrt(avg(pow(e.y - e.yhat, 2))), 4) AS RMSE,
       round(avg(abs(e.y - e.yhat)), 4) AS MAE,
       round(avg(CASE WHEN e.y <> 0 THEN abs((e.y - e.yhat) / e.y) END) * 100, 4) AS MAPE,
       round(COALESCE(avg(CASE WHEN (abs(e.y) + abs(e.yhat)) / 2 <> 0
             THEN abs(e.y - e.yhat) / ((abs(e.y) + abs(e.yhat)) / 2) END) * 100, 0.0), 4) AS sMAPE,
       round(max(r.wr), 4) AS WRMSSE
FROM {FCS} e
JOIN (SELECT {g}, avg(rmsse) AS wr FROM (
        SELECT {", ".join("g." + c for c in group)}, g.unique_id,
               sqrt(avg(pow(g.yhat - g.y, 2)) / greatest(COALESCE(max(s.scale), 1.0), 1e-8)) AS rmsse
        FROM {FCS} g LEFT JOIN {SCALE} s ON g.unique_id = s.unique_id
        GROUP BY {", ".join("g." + c for c in group)}, g.unique_id) f GROUP BY {g}) r ON {on}
GROUP BY {ge})"""


BOARD = f"""(SELECT model AS Model, RMSE, MAE, MAPE, sMAPE, WRMSSE, CAST(0.0 AS DOUBLE) AS train_seconds
FROM {_scores(["model"])} b)"""
MELT = f"""(SELECT * FROM (SELECT Model, RMSE, MAE, MAPE, sMAPE, WRMSSE FROM {BOARD} b1) b0 UNPIVOT INCLUDE NULLS (Value FOR Metric IN (RMSE, MAE, MAPE, sMAPE, WRMSSE)))"""
V = ("panel", "cutoff")
sql("leaderboard", *V, body=f"SELECT * FROM {BOARD} t")
sql("melt_metrics", *V, body=f"SELECT Model, Metric, Value FROM {MELT} t")
sql("best_per_metric", *V, body=f"""
SELECT Metric, Model, Value FROM (
  SELECT *, row_number() OVER (PARTITION BY Metric ORDER BY Value, Model) AS rn
  FROM {MELT} t WHERE Value IS NOT NULL) WHERE rn = 1
""")
sql("radar_scores", *V, body=f"""
SELECT Model, Metric, Value,
       round(1 - (Value - min(Value) OVER (PARTITION BY Metric))
             / CASE WHEN max(Value) OVER (PARTITION BY Metric) - min(Value) OVER (PARTITION BY Metric) = 0
                    THEN 1.0 ELSE max(Value) OVER (PARTITION BY Metric) - min(Value) OVER (PARTITION BY Metric) END,
             3) AS score
FROM {MELT} t
""")
sql("metrics_json", *V, body=f"SELECT * FROM {BOARD} t")

SCORES_CAT = f"""(SELECT * FROM {_scores(["model", "cat_id"])} a
  UNION ALL SELECT model, cat_id, RMSE, MAE, MAPE, sMAPE, WRMSSE FROM {_scores(["model"], True)} b)"""
LONG_CAT = f"(SELECT * FROM {SCORES_CAT} s0 UNPIVOT INCLUDE NULLS (Value FOR Metric IN (RMSE, MAE, MAPE, sMAPE, WRMSSE)))"
sql("model_vs_benchmark", *V, body=f"""
SELECT a.cat_id, a.Metric, a.Value AS model_value, b.Value AS benchmark_value,
       round((a.Value - b.Value) / NULLIF(b.Value, 0) * 100, 4) AS pct_diff
FROM {LONG_CAT} a JOIN {LONG_CAT} b
  ON a.cat_id = b.cat_id AND a.Metric = b.Metric AND a.model = 'lag_7' AND b.model = 'lag_28'
""")

# ---------------------------------------------------------------- forecast post-processing
sql("pct_band", "forecast", body="""
SELECT unique_id, ds, y, yhat, round(greatest(yhat - yhat * 0.05, 0.0), 6) AS yhat_lower,
       round(yhat + yhat * 0.05, 6) AS yhat_upper FROM forecast
""")
sql("forecast_total", "forecast", body="""
SELECT ds, round(sum(yhat), 6) AS total_yhat FROM forecast GROUP BY ds
""")
sql("forecast_scaled", "forecast", "series", body="""
SELECT ds, round(sum(yhat) * ((SELECT count(*) FROM series)
       / (SELECT count(DISTINCT unique_id) FROM forecast WHERE yhat IS NOT NULL)), 6) AS scaled_yhat
FROM forecast WHERE yhat IS NOT NULL GROUP BY ds
""")

PATHS = ("(UNPIVOT (SELECT unique_id, ds, " + ", ".join(f"s{k}" for k in range(1, 21)) + """ FROM (
  SELECT unique_id, ds, """
         + ", ".join(f"CASE turn {' '.join(f'WHEN {t} THEN l{k + t - 1}' for t in range(1, 5))} END AS s{k}" for k in range(1, 21))
         + """ FROM (SELECT item_id || '_' || store_id AS unique_id, date AS ds, date_diff('day', (SELECT cut FROM cutoff), date) // 7 + 1 AS turn, """
         + ", ".join(f"{lag_days(7 * k)} AS l{k}" for k in range(1, 24))
         + """ FROM panel) u) t WHERE ds >= (SELECT cut FROM cutoff))
  ON """ + ", ".join(f"s{k}" for k in range(1, 21)) + " INTO NAME sample VALUE y)")
sql("path_quantiles", "panel", "cutoff", body=f"""
SELECT unique_id, ds, round(quantile_cont(y, 0.5), 6) AS yhat,
       round(quantile_cont(y, 0.025), 6) AS yhat_lower, round(quantile_cont(y, 0.975), 6) AS yhat_upper
FROM {PATHS} p GROUP BY unique_id, ds
""")
sql("static_features", "panel", body="""
SELECT unique_id,
       CAST(dense_rank() OVER (ORDER BY dept_id) - 1 AS INTEGER) AS dept_id,
       CAST(dense_rank() OVER (ORDER BY cat_id) - 1 AS INTEGER) AS cat_id,
       CAST(dense_rank() OVER (ORDER BY state_id) - 1 AS INTEGER) AS state_id
FROM (SELECT item_id || '_' || store_id AS unique_id, arg_min(dept_id, date) AS dept_id,
             arg_min(cat_id, date) AS cat_id, arg_min(state_id, date) AS state_id
      FROM panel GROUP BY 1)
""")
sql("series_list", "sales_long", body="""
SELECT DISTINCT item_id, store_id FROM sales_long ORDER BY item_id, store_id LIMIT 5
""")
sql("residual_histogram", "forecast", body="""
SELECT bin, round(lo + bin * w, 6) AS bin_lo, round(lo + (bin + 1) * w, 6) AS bin_hi, count(*) AS n
FROM (SELECT CAST(least(floor((res - lo) / w), 49) AS INTEGER) AS bin, lo, w FROM
        (SELECT round(y - yhat, 2) AS res FROM forecast) r,
        (SELECT min(round(y - yhat, 2)) AS lo,
                CASE WHEN max(round(y - yhat, 2)) > min(round(y - yhat, 2))
                     THEN (max(round(y - yhat, 2)) - min(round(y - yhat, 2))) / 50 ELSE 1.0 END AS w
         FROM forecast) b
      WHERE res IS NOT NULL)
GROUP BY bin, lo, w
""")
sql("union_train_test", "panel", body="SELECT item_id, store_id, date, sales FROM panel")
sql("future_dates", "panel", body="""
SELECT unique_id, CAST(last + CAST(h AS INTEGER) AS DATE) AS ds, CAST(h AS INTEGER) AS h
FROM (SELECT item_id || '_' || store_id AS unique_id, max(date) AS last FROM panel GROUP BY 1),
     range(1, 29) t(h)
""")
TRAIN_MEAN = """(SELECT item_id || '_' || store_id AS unique_id, avg(sell_price) AS sell_price
  FROM panel WHERE date < (SELECT cut FROM cutoff) GROUP BY 1)"""
sql("regressor_means", "panel", "cutoff", body=f"""
SELECT unique_id, round(sell_price, 6) AS sell_price FROM {TRAIN_MEAN} m
""")
sql("future_regressors", "panel", "cutoff", body="""
SELECT unique_id, ds, round(COALESCE(known, mean), 6) AS sell_price
FROM (SELECT item_id || '_' || store_id AS unique_id, date AS ds, CASE WHEN wm_yr_wk % 2 = 0 THEN sell_price END AS known,
             avg(CASE WHEN date < (SELECT cut FROM cutoff) THEN sell_price END) OVER (PARTITION BY item_id, store_id) AS mean
      FROM panel) t
WHERE ds >= (SELECT cut FROM cutoff)
""")

# ---------------------------------------------------------------- grids and decomposition
SPARSE_SERIES = """(SELECT s.item_id || '_' || s.store_id AS unique_id, s.store_id, c.date AS ds,
  CAST(s.sales AS DOUBLE) AS y FROM sales_sparse s LEFT JOIN calendar c ON s.d = c.d)"""
sql("densify_zero", "sales_sparse", "calendar", body=f"""
SELECT g.unique_id, g.ds, COALESCE(f.y, 0.0) AS y
FROM (SELECT unique_id, CAST(x AS DATE) AS ds FROM (
        SELECT unique_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS x
        FROM (SELECT unique_id, min(ds) AS lo, max(ds) AS hi FROM {SPARSE_SERIES} a GROUP BY 1))) g
LEFT JOIN {SPARSE_SERIES} f ON g.unique_id = f.unique_id AND g.ds = f.ds
""")
STORE_DAY = f"(SELECT store_id, ds AS date, sum(y) AS sales FROM {SPARSE_SERIES} a GROUP BY 1, 2)"
sql("densify_ffill", "sales_sparse", "calendar", body=f"""
SELECT g.store_id, g.date,
       round(last_value(f.sales IGNORE NULLS) OVER (PARTITION BY g.store_id ORDER BY g.date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS sales
FROM (SELECT store_id, CAST(x AS DATE) AS date FROM (
        SELECT store_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS x
        FROM (SELECT store_id, min(date) AS lo, max(date) AS hi FROM {STORE_DAY} b GROUP BY 1))) g
LEFT JOIN {STORE_DAY} f ON g.store_id = f.store_id AND g.date = f.date
""")
sql("seasonal_decompose", "sales_long", "calendar", body=f"""
, daily AS (SELECT date, CAST(sum(sales) AS DOUBLE) AS observed FROM {DATED} t GROUP BY date),
x AS (SELECT date, observed,
             CASE WHEN count(observed) OVER w7 = 7 THEN avg(observed) OVER w7 END AS trend,
             (row_number() OVER (ORDER BY date) - 1) % 7 AS pos
      FROM daily WINDOW w7 AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
pm AS (SELECT pos, avg(observed - trend) AS pm FROM x GROUP BY pos),
s AS (SELECT pos, pm - avg(pm) OVER () AS seasonal FROM pm)
SELECT x.date, round(x.observed, 6) AS observed, round(x.trend, 6) AS trend,
       round(s.seasonal, 6) AS seasonal, round(x.observed - x.trend - s.seasonal, 6) AS resid
FROM x JOIN s ON x.pos = s.pos WHERE x.trend IS NOT NULL
""")

NLAGS = 40
ACF_AGG = ("(SELECT unique_id, count(p0) AS n, " + ", ".join(f"sum(p{k}) AS s{k}" for k in range(NLAGS + 1))
           + " FROM (SELECT unique_id, " + ", ".join(
               f"d * lag(d, {k}) OVER (PARTITION BY unique_id ORDER BY ds) AS p{k}" for k in range(NLAGS + 1))
           + """ FROM (SELECT item_id || '_' || store_id AS unique_id, date AS ds,
                CAST(sales AS DOUBLE) - avg(CAST(sales AS DOUBLE)) OVER (PARTITION BY item_id, store_id) AS d
                FROM panel) t) u GROUP BY unique_id)""")
sql("acf", "panel", body="SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT unique_id, CAST({k} AS INTEGER) AS lag, round(s{k} / NULLIF(s0, 0), 6) AS acf, "
    f"round(1.96 / sqrt(n), 6) AS conf FROM acf_agg WHERE {k} < n" for k in range(NLAGS + 1)) + ")")
ORACLE["acf"] = ORACLE["acf"].replace("\nSELECT * FROM (", f", acf_agg AS {ACF_AGG}\nSELECT * FROM (", 1)

# ---------------------------------------------------------------- direct multi-horizon rows
SNAP_CASE = """CASE WHEN state_id = 'AFRICA' THEN CAST(snap_AFRICA AS INTEGER)
                  WHEN state_id = 'AMERICA' THEN CAST(snap_AMERICA AS INTEGER)
                  WHEN state_id = 'ASIA' THEN CAST(snap_ASIA AS INTEGER)
                  WHEN state_id = 'EUROPE' THEN CAST(snap_EUROPE AS INTEGER)
                  WHEN state_id = 'MIDDLE EAST' THEN CAST(snap_MIDDLE_EAST AS INTEGER)
                  ELSE 0 END"""
DIRECT_SERIES = f"""(SELECT item_id || '_' || store_id AS unique_id, date AS ds, CAST(sales AS DOUBLE) AS y,
  CAST(event_name_1 IS NOT NULL AND event_name_1 <> 'NoEvent' AS INTEGER) AS has_event, {SNAP_CASE} AS snap,
  CAST(dense_rank() OVER (ORDER BY cat_id) - 1 AS INTEGER) AS cat_id,
  CAST(dense_rank() OVER (ORDER BY dept_id) - 1 AS INTEGER) AS dept_id
  FROM panel_dense)"""
LAST_TRAIN = "CAST((SELECT cut FROM cutoff) - 1 AS DATE)"
DW = "PARTITION BY unique_id ORDER BY ds"
sql("direct_training_rows", "panel_dense", "cutoff", body=f"""
, s AS {DIRECT_SERIES},
st AS (SELECT unique_id, quantile_cont(y, 0.5) AS median,
              CASE WHEN quantile_cont(y, 0.75) - quantile_cont(y, 0.25) > 0
                   THEN quantile_cont(y, 0.75) - quantile_cont(y, 0.25) ELSE 1.0 END AS iqr
       FROM s WHERE ds <= {LAST_TRAIN} GROUP BY unique_id),
b AS (SELECT s.unique_id, s.ds, s.cat_id, s.dept_id, s.has_event, s.snap, st.median, st.iqr,
             (s.y - st.median) / st.iqr AS y_scaled,
             CAST((((date_diff('day', {LAST_TRAIN}, s.ds) - 1) % 28) + 28) % 28 + 1 AS INTEGER) AS h,
             ((date_diff('day', {LAST_TRAIN}, s.ds) % 28) + 28) % 28 = 0 AS is_origin
      FROM s LEFT JOIN st ON s.unique_id = st.unique_id),
c AS (SELECT *, CASE WHEN is_origin THEN y_scaled END AS y_o,
             CASE WHEN is_origin THEN avg(y_scaled) OVER ({DW} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS m7_o,
             CASE WHEN is_origin THEN avg(y_scaled) OVER ({DW} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) END AS m28_o
      FROM b)
SELECT unique_id, ds, h, cat_id, dept_id,
       round(last_value(y_o IGNORE NULLS) OVER ({DW} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS y_origin,
       round(last_value(m7_o IGNORE NULLS) OVER ({DW} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS mean7_origin,
       round(last_value(m28_o IGNORE NULLS) OVER ({DW} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS mean28_origin,
       CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week, CAST(month(ds) AS INTEGER) AS month,
       CAST(isodow(ds) >= 6 AS INTEGER) AS is_weekend, has_event, snap,
       round(median, 6) AS median, round(iqr, 6) AS iqr, round(y_scaled, 6) AS y_scaled
FROM c
""")
# the body above continues the WITH clause of the fixture views
ORACLE["direct_training_rows"] = ORACLE["direct_training_rows"].replace("\n\n, s AS", "\n, s AS")

sql("alignment_report", "panel", "cutoff", body="""
SELECT count(*) FILTER (WHERE a AND p) AS matched,
       count(*) FILTER (WHERE a AND p IS NULL) AS actual_only,
       count(*) FILTER (WHERE a IS NULL AND p) AS forecast_only
FROM (SELECT item_id || '_' || store_id AS unique_id, date AS ds, TRUE AS a FROM panel
      WHERE date >= (SELECT cut FROM cutoff)) x
FULL JOIN (SELECT item_id || '_' || store_id AS unique_id, date AS ds, TRUE AS p FROM panel
           WHERE date >= CAST((SELECT cut FROM cutoff) - 7 AS DATE)) y USING (unique_id, ds)
""")

TOP50 = """item_id IN (SELECT item_id FROM sales_sparse GROUP BY item_id ORDER BY sum(sales) DESC, item_id LIMIT 50)"""
sql("load_all", "panel_full", "cutoff", "sales_sparse", body=f"""
SELECT item_id, store_id, date, sales, round(sell_price, 6) AS sell_price FROM panel_full
WHERE date < (SELECT cut FROM cutoff) AND {TOP50}
""")
sql("preprocess_test", "panel", "cutoff", "sales_sparse", body=f"""
SELECT {panel_select()} FROM panel WHERE date >= (SELECT cut FROM cutoff) AND {TOP50}
""")

sql("preprocess_train", "panel", "cutoff", "sales_sparse", body=f"""
SELECT {panel_select()} FROM panel WHERE date < (SELECT cut FROM cutoff) AND {TOP50}
""")
sql("forecast_sink", "panel", "cutoff", body=f"SELECT unique_id, ds, y, yhat FROM {FC_CAT.format(lag=lag_from(7))} f")

# ---------------------------------------------------------------- partial autocorrelation
# Durbin-Levinson by a recursion over the lag: phi holds the coefficients of the order before.
_acf_rows = "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT unique_id, {k} AS k, s{k} / NULLIF(s0, 0) AS r, n FROM acf_agg WHERE {k} < n" for k in range(NLAGS + 1)) + ")"
ORACLE["pacf"] = ORACLE["acf"].split("\nSELECT * FROM (", 1)[0].replace("WITH ", "WITH RECURSIVE ", 1) + f""",
rr AS MATERIALIZED (SELECT unique_id, list(r ORDER BY k) AS r, max(n) AS n, max(k) AS top FROM ({_acf_rows}) GROUP BY unique_id
                    HAVING bool_and(r IS NOT NULL)),
dl AS (
  SELECT unique_id, r, n, top, 0 AS k, CAST([] AS DOUBLE[]) AS phi, 1.0::DOUBLE AS v, 1.0::DOUBLE AS a FROM rr
  UNION ALL
  SELECT unique_id, r, n, top, k + 1,
         list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - a2 * phi[k + 1 - j]), [a2]), v * (1 - a2 * a2), a2
  FROM (SELECT *, (r[k + 2] - COALESCE(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0.0)) / v AS a2
        FROM dl WHERE k < top AND v > 0) x)
SELECT unique_id, CAST(k AS INTEGER) AS lag, (round(a, 6) + 0.0) AS pacf FROM dl
"""

# ---------------------------------------------------------------- sample paths
# base = last week's value of the same weekday, residuals = y(t) - y(t - 7), drawn by an md5 of the key
sql("fc_paths_samples", "panel_dense", "cutoff", body="""
, s AS MATERIALIZED (SELECT item_id || '_' || store_id AS unique_id, date AS ds, CAST(sales AS DOUBLE) AS y,
         row_number() OVER (PARTITION BY item_id, store_id ORDER BY date) AS t,
         count(*) OVER (PARTITION BY item_id, store_id) AS n
       FROM panel_dense WHERE date < (SELECT cut FROM cutoff)),
a AS MATERIALIZED (SELECT unique_id, max(ds) AS last, list(y ORDER BY ds) AS ys, max(n) AS n, avg(y) AS mean FROM s GROUP BY unique_id),
p AS (SELECT unique_id, CAST(last + CAST(h AS INTEGER) AS DATE) AS ds, k, CASE WHEN n < 7 THEN 'too_short' ELSE 'ok' END AS status,
             greatest(CASE WHEN n >= 7 THEN ys[n - 7 + ((h - 1) % 7) + 1] ELSE mean END + CASE WHEN n > 7 THEN
               ys[CAST(('0x' || substr(md5(unique_id || '|' || k || '|' || h || '|42'), 1, 8)) AS BIGINT) % (n - 7) + 8] -
               ys[CAST(('0x' || substr(md5(unique_id || '|' || k || '|' || h || '|42'), 1, 8)) AS BIGINT) % (n - 7) + 1] ELSE 0.0 END, 0.0) AS y
      FROM a, range(1, 29) g(h), range(1, 21) q(k))
SELECT unique_id, ds, round(quantile_cont(y, 0.5), 6) AS yhat, round(quantile_cont(y, 0.025), 6) AS yhat_lower,
       round(quantile_cont(y, 0.975), 6) AS yhat_upper, min(status) AS status, """ + ", ".join(f"round(max(CASE WHEN k = {i} THEN y END), 6) AS sample_{i}" for i in range(1, 21)) + """
FROM p GROUP BY unique_id, ds
""")
ORACLE["fc_paths_samples"] = ORACLE["fc_paths_samples"].replace("\n\n, s AS", "\n, s AS")
ORACLE["fc_paths"] = ("SELECT unique_id, ds, yhat, yhat_lower, yhat_upper, status FROM (" + ORACLE["fc_paths_samples"] + ") z")

# ---------------------------------------------------------------- seasonal autoregression
_AR_X = ["1.0", "l1", "l7", "l8"]
_AR_SQL = "n, last, ys, mean, variance, " + ", ".join(f"a_{i}_{j}" for i in range(4) for j in range(4)) + ", " + ", ".join(f"b_{i}" for i in range(4))


def _ar_steps() -> str:
    """The elimination as nested selects."""
    from panelcast.models.lag_regression import elimination
    text, names = "sums", ["unique_id", *_AR_SQL.split(", ")]
    for step in elimination():
        new = dict(step)
        cols = [f"{new.pop(c)} AS {c}" if c in new else c for c in names]
        names += list(new)
        text = f"(SELECT {', '.join([*cols, *(f'{e} AS {c}' for c, e in new.items())])} FROM {text} t)"
    return text


sql("fc_seasonal_ar", "panel_dense", "cutoff", body=f"""
, s AS (SELECT unique_id, ds, y, lag(y, 1) OVER w AS l1, lag(y, 7) OVER w AS l7, lag(y, 8) OVER w AS l8
        FROM (SELECT item_id || '_' || store_id AS unique_id, date AS ds, CAST(sales AS DOUBLE) AS y FROM panel_dense
              WHERE date < (SELECT cut FROM cutoff)) z WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
sums AS MATERIALIZED (SELECT unique_id, count(l8) AS n, max(ds) AS last, list(y ORDER BY ds) AS ys, avg(y) AS mean, var_pop(y) AS variance,
        {", ".join(f"sum(CASE WHEN l8 IS NOT NULL THEN {_AR_X[i]} * {_AR_X[j]} END) + {1.0 if i == j and i else 0.0} AS a_{i}_{j}"
                   for i in range(4) for j in range(4))},
        {", ".join(f"sum(CASE WHEN l8 IS NOT NULL THEN {_AR_X[i]} * y END) AS b_{i}" for i in range(4))}
      FROM s GROUP BY unique_id),
st AS (SELECT *, CASE WHEN variance = 0 THEN 'constant' WHEN n < 4 THEN 'too_short' ELSE 'ok' END AS status FROM {_ar_steps()} e),
f AS (SELECT unique_id, last, mean, status, c_0, c_1, c_2, c_3, ys[greatest(len(ys) - 7, 1):] AS v, 0 AS h FROM st
      UNION ALL
      SELECT unique_id, last, mean, status, c_0, c_1, c_2, c_3,
             list_append(v, CASE WHEN status = 'ok' THEN c_0 + c_1 * v[len(v)] + c_2 * v[len(v) - 6] + c_3 * v[len(v) - 7] ELSE mean END), h + 1 FROM f WHERE h < 28)
SELECT unique_id, CAST(last + h AS DATE) AS ds, CAST(h AS INTEGER) AS h, round(greatest(v[len(v)], 0.0), 6) AS yhat, status FROM f WHERE h > 0
""")
ORACLE["fc_seasonal_ar"] = ORACLE["fc_seasonal_ar"].replace("\n\n, s AS", "\n, s AS").replace("WITH ", "WITH RECURSIVE ", 1)

# ---------------------------------------------------------------- global models: properties that SQL knows
sql("gbt_fit", "panel_dense", "cutoff", body="""
SELECT count(*) AS val_rows, TRUE AS beats_zero, TRUE AS beats_mean, TRUE AS within_rounds FROM panel_dense
WHERE date < (SELECT cut FROM cutoff) AND date >= CAST((SELECT max(date) FROM panel_dense WHERE date < (SELECT cut FROM cutoff)) - 27 AS DATE)
""")
sql("gbt_evaluate", "panel_dense", "cutoff", body="""
SELECT item_id || '_' || store_id AS unique_id, count(*) AS n, CAST(sum(sales) AS DOUBLE) AS y, TRUE AS nonneg
FROM panel_dense WHERE date >= (SELECT cut FROM cutoff) GROUP BY 1
""")
ORACLE["model_roundtrip"] = ORACLE["gbt_evaluate"].replace("TRUE AS nonneg", "TRUE AS equal")
ORACLE["gbt_importance"] = "SELECT TRUE AS sums_to_one, TRUE AS nonneg, TRUE AS splits_counted"
sql("fc_gbt_recursive", "panel_dense", "cutoff", body="""
SELECT item_id || '_' || store_id AS unique_id, CAST(28 AS BIGINT) AS n, CAST(max(date) + 1 AS DATE) AS first_ds,
       CAST(max(date) + 28 AS DATE) AS last_ds, TRUE AS nonneg
FROM panel_dense WHERE date < (SELECT cut FROM cutoff) GROUP BY item_id, store_id
""")
ORACLE["fc_direct"] = ORACLE["fc_gbt_recursive"]   # 28 rows from every training series' own last day

# ---------------------------------------------------------------- multi-model run
FC7D = FC7.replace("FROM panel)", "FROM panel_dense)")
RUN_FC = "(" + " UNION ALL ".join([
    f"SELECT 'lag_{L}' AS model, * FROM {FC7D.format(lag=lag_from(L))} f{L}" for L in (7, 28)] + [
    f"SELECT 'half' AS model, * FROM {FC7D.format(lag=lag_from(28))} f0 WHERE unique_id LIKE '%A_1'"]) + ")"
sql("run_models", "panel_dense", "cutoff", body=f"""
, actual AS (SELECT item_id || '_' || store_id AS unique_id, date AS ds, CAST(sales AS DOUBLE) AS y FROM panel_dense
             WHERE date >= (SELECT cut FROM cutoff)),
m AS (SELECT * FROM (VALUES ('lag_7'), ('lag_28'), ('half'), ('broken')) t(model)),
j AS (SELECT m.model, a.unique_id, a.ds, a.y, f.yhat FROM m CROSS JOIN actual a
      LEFT JOIN {RUN_FC} f ON f.model = m.model AND f.unique_id = a.unique_id AND f.ds = a.ds),
c AS (SELECT model, count(DISTINCT unique_id) AS n_series,
             count(DISTINCT CASE WHEN yhat IS NOT NULL THEN unique_id END) AS n_scored,
             bool_and(yhat IS NOT NULL) AS complete,
             sqrt(avg(pow(y - yhat, 2))) AS RMSE, avg(abs(y - yhat)) AS MAE FROM j GROUP BY model)
SELECT model AS Model, n_series, n_scored, n_series - n_scored AS n_failed, complete, model = 'broken' AS failed,
       round(RMSE, 4) AS RMSE, round(MAE, 4) AS MAE,
       CASE WHEN complete THEN CAST(row_number() OVER (PARTITION BY complete ORDER BY round(RMSE, 4), model) AS INTEGER) END AS rank
FROM c
""")
ORACLE["run_models"] = ORACLE["run_models"].replace("\n\n, actual AS", "\n, actual AS")
# a model that is fitted per series, or on all, has 28 rows for every series with training rows
sql("run_models_all", "panel_dense", "cutoff", body=f"""
, actual AS (SELECT item_id || '_' || store_id AS unique_id, date AS ds FROM panel_dense WHERE date >= (SELECT cut FROM cutoff)),
trained AS (SELECT DISTINCT item_id || '_' || store_id AS unique_id FROM panel_dense WHERE date < (SELECT cut FROM cutoff)),
naive AS (SELECT 'naive_7' AS model, unique_id, ds, yhat FROM {FC7D.format(lag=lag_from(7))} f7
          UNION ALL SELECT 'naive_28', unique_id, ds, yhat FROM {FC7D.format(lag=lag_from(28))} f28),
m AS (SELECT * FROM (VALUES ('naive_7'), ('naive_28'), ('paths'), ('seasonal_ar'), ('arima'), ('additive'), ('gbt'), ('direct')) t(model)),
j AS (SELECT m.model, a.unique_id, CASE WHEN m.model LIKE 'naive%' THEN n.yhat IS NOT NULL ELSE t.unique_id IS NOT NULL END AS there
      FROM m CROSS JOIN actual a LEFT JOIN trained t USING (unique_id)
      LEFT JOIN naive n ON n.model = m.model AND n.unique_id = a.unique_id AND n.ds = a.ds)
SELECT model AS Model, count(DISTINCT unique_id) AS n_series, count(DISTINCT CASE WHEN there THEN unique_id END) AS n_scored,
       count(DISTINCT unique_id) - count(DISTINCT CASE WHEN there THEN unique_id END) AS n_failed, bool_and(there) AS complete,
       FALSE AS failed, bool_and(there) AS ranked, bool_or(there) AS scored
FROM j GROUP BY model
""")
ORACLE["run_models_all"] = ORACLE["run_models_all"].replace("\n\n, actual AS", "\n, actual AS")

# ---------------------------------------------------------------- sinks and readers
ORACLE["leaderboard_csv"] = ORACLE["leaderboard"]
sql("leaderboard_by_mae", *V, body=f"""
SELECT *, CAST(row_number() OVER (ORDER BY MAE, Model) AS INTEGER) AS place FROM {BOARD} t
""")
ORACLE["insights_roundtrip"] = ORACLE["acf"]
sql("forecast_fallback", "forecast", body="SELECT unique_id, ds, y, yhat FROM forecast")

DAILY = "(SELECT ds, sum(y) AS y, sum(yhat) AS yhat FROM {fc} f GROUP BY ds)"
sql("forecast_files", "panel", "cutoff", body=" UNION ALL ".join(f"""
SELECT ds AS date, round(y, 6) AS actual, round(yhat, 6) AS predicted, round(greatest(yhat - yhat * 0.05, 0.0), 6) AS ci_lower,
       round(yhat + yhat * 0.05, 6) AS ci_upper, '{folder}' AS folder FROM {DAILY.format(fc=FC_CAT.format(lag=lag_from(lag)))} t{lag}
""" for folder, lag in (("all", 7), ("no_csv", 14), ("old_only", 28))))
sql("sales_files", "sales_full", body=" UNION ALL ".join(f"""
SELECT item_id, store_id, cat_id, count(*) AS days, CAST(sum(sales) AS BIGINT) AS sales, '{folder}' AS folder FROM sales_full {where} GROUP BY 1, 2, 3
""" for folder, where in (("parquet", ""), ("csv", "WHERE cat_id = 'CAT_0'"), ("raw", "WHERE cat_id = 'CAT_1'"), ("beside", "WHERE cat_id = 'CAT_2'"))))
sql("insight_tables", "panel_dense", "cutoff", body="""
, trained AS (SELECT count(DISTINCT (item_id, store_id)) AS n FROM panel_dense WHERE date < (SELECT cut FROM cutoff))
SELECT 'covariate_weights' AS name, CAST(5 AS BIGINT) AS n, TRUE AS sound
UNION ALL SELECT 'components', n * 28, TRUE FROM trained UNION ALL SELECT 'changepoints', n * 25, TRUE FROM trained
""")
ORACLE["insight_tables"] = ORACLE["insight_tables"].replace("\n\n, trained AS", "\n, trained AS")
