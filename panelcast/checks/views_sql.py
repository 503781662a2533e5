"""DuckDB SQL for the derived retail views (the oracle side of the fixtures).

``with_views("panel", ...)`` returns a ``WITH`` clause holding the requested
views and everything they depend on, in dependency order. The definitions
mirror ``panelcast.sources.fixtures`` rule for rule.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


view("bounds", (), """
SELECT lo, CAST(lo + CAST(date_diff('day', lo, last) // 4 AS INTEGER) AS DATE) AS hi
FROM (SELECT CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem)
""")

view("base", ("bounds",), """
SELECT 'ITEM_' || CAST(l.l_partkey // 25 AS VARCHAR) AS item_id,
       'DEPT_' || CAST((l.l_partkey // 25) % 6 AS VARCHAR) AS dept_id,
       'CAT_' || CAST((l.l_partkey // 25) % 3 AS VARCHAR) AS cat_id,
       r.r_name || '_1' AS store_id, r.r_name AS state_id,
       date_diff('day', b.lo, CAST(l.l_shipdate AS DATE)) // 4 AS n,
       CAST(b.lo + CAST(date_diff('day', b.lo, CAST(l.l_shipdate AS DATE)) // 4 AS INTEGER) AS DATE) AS date,
       l.l_quantity AS quantity, p.p_retailprice AS retail_price
FROM lineitem l
JOIN bounds b ON TRUE
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
""")

view("sales_sparse", ("base",), """
SELECT item_id, dept_id, cat_id, store_id, state_id, 'd_' || CAST(n + 1 AS VARCHAR) AS d,
       CAST(sum(quantity) AS INTEGER) AS sales
FROM base GROUP BY item_id, dept_id, cat_id, store_id, state_id, n
""")

view("calendar", ("bounds",), """
SELECT date,
       CAST(11101 + n // 7 AS INTEGER) AS wm_yr_wk,
       dayname(date) AS weekday,
       CAST(((dayofweek(date) + 1) % 7) + 1 AS INTEGER) AS wday,
       CAST(month(date) AS INTEGER) AS month,
       CAST(year(date) AS INTEGER) AS year,
       'd_' || CAST(n + 1 AS VARCHAR) AS d,
       CASE WHEN strftime(date, '%m-%d') = '12-25' THEN 'Christmas'
            WHEN strftime(date, '%m-%d') = '07-04' THEN 'IndependenceDay'
            WHEN strftime(date, '%m-%d') = '02-14' THEN 'ValentinesDay'
            WHEN strftime(date, '%m-%d') = '10-31' THEN 'Halloween'
            WHEN month(date) = 2 AND day(date) <= 7 AND isodow(date) = 7 THEN 'SuperBowl' END AS event_name_1,
       CASE WHEN strftime(date, '%m-%d') = '12-25' THEN 'National'
            WHEN strftime(date, '%m-%d') = '07-04' THEN 'National'
            WHEN strftime(date, '%m-%d') = '02-14' THEN 'Cultural'
            WHEN strftime(date, '%m-%d') = '10-31' THEN 'Cultural'
            WHEN month(date) = 2 AND day(date) <= 7 AND isodow(date) = 7 THEN 'Sporting' END AS event_type_1,
       CASE WHEN strftime(date, '%m-%d') = '07-04' THEN 'Parade' END AS event_name_2,
       CASE WHEN strftime(date, '%m-%d') = '07-04' THEN 'Cultural' END AS event_type_2,
       day(date) BETWEEN 1 AND 10 AS snap_AFRICA,
       day(date) BETWEEN 1 AND 5 AS snap_AMERICA,
       day(date) BETWEEN 6 AND 15 AS snap_ASIA,
       day(date) BETWEEN 2 AND 12 AND day(date) % 2 = 0 AS snap_EUROPE,
       day(date) BETWEEN 11 AND 15 AS snap_MIDDLE_EAST
FROM (SELECT CAST(lo + CAST(i AS INTEGER) AS DATE) AS date, CAST(i AS INTEGER) AS n
      FROM bounds, range(0, date_diff('day', lo, hi) + 29) AS t(i))
""")

view("prices", ("base",), """
SELECT st.store_id, w.item_id, CAST(11101 + w.w AS INTEGER) AS wm_yr_wk, w.sell_price
FROM (SELECT item_id, n // 7 AS w, max(retail_price) AS sell_price FROM base GROUP BY 1, 2) w
JOIN (SELECT DISTINCT item_id, store_id FROM base) st ON st.item_id = w.item_id
WHERE w.w % 7 <> 3
""")

view("series", ("sales_sparse",), """
SELECT DISTINCT item_id, dept_id, cat_id, store_id, state_id FROM sales_sparse
""")

# every day from a series' first to its last sale
view("sales_dense", ("base",), """
SELECT g.item_id, g.dept_id, g.cat_id, g.store_id, g.state_id, 'd_' || CAST(g.n + 1 AS VARCHAR) AS d,
       CAST(COALESCE(f.u, 0) AS INTEGER) AS sales
FROM (SELECT item_id, dept_id, cat_id, store_id, state_id, unnest(range(min(n), max(n) + 1)) AS n
      FROM base GROUP BY 1, 2, 3, 4, 5) g
LEFT JOIN (SELECT item_id, store_id, n, sum(quantity) AS u FROM base GROUP BY 1, 2, 3) f
  ON f.item_id = g.item_id AND f.store_id = g.store_id AND f.n = g.n
""")

# the same without the weeks that are gaps
view("sales_long", ("sales_dense", "base"), """
SELECT s.* FROM sales_dense s
LEFT JOIN (SELECT DISTINCT item_id, store_id, n // 7 AS w FROM base) k
  ON k.item_id = s.item_id AND k.store_id = s.store_id AND k.w = (CAST(substring(s.d, 3) AS INTEGER) - 1) // 7
WHERE ((CAST(substring(s.d, 3) AS INTEGER) - 1) // 7) % 4 <> 0 OR k.w IS NOT NULL
""")

# the wide matrix melted: every series on every day of the data
view("sales_full", ("series", "calendar", "sales_sparse", "bounds"), """
SELECT s.item_id, s.dept_id, s.cat_id, s.store_id, s.state_id, c.d, COALESCE(f.sales, 0) AS sales
FROM series s CROSS JOIN (SELECT d FROM calendar WHERE date <= (SELECT hi FROM bounds)) c
LEFT JOIN sales_sparse f ON f.item_id = s.item_id AND f.store_id = s.store_id AND f.d = c.d
""")

# merged panel = sales ⟕ calendar ⟕ prices, prices filled per series
# (forward, then backward, then 0), events filled with 'NoEvent'. Backward: where the forward
# fill is NULL no price came yet, so it is the first price of the series.
for suffix, source in (("", "sales_long"), ("_dense", "sales_dense"), ("_full", "sales_full")):
    view(f"merged{suffix}", (source, "calendar", "prices"), f"""
SELECT s.*, c.date, c.wm_yr_wk, c.weekday, c.wday, c.month, c.year,
       c.event_name_1, c.event_type_1, c.event_name_2, c.event_type_2,
       c.snap_AFRICA, c.snap_AMERICA, c.snap_ASIA, c.snap_EUROPE, c.snap_MIDDLE_EAST,
       p.sell_price
FROM {source} s
LEFT JOIN calendar c ON s.d = c.d
LEFT JOIN prices p ON s.store_id = p.store_id AND s.item_id = p.item_id AND c.wm_yr_wk = p.wm_yr_wk
""")
    view(f"panel{suffix}", (f"merged{suffix}",), f"""
SELECT item_id, dept_id, cat_id, store_id, state_id, d, sales, date, wm_yr_wk, weekday, wday,
       month, year,
       COALESCE(event_name_1, 'NoEvent') AS event_name_1,
       COALESCE(event_type_1, 'NoEvent') AS event_type_1,
       COALESCE(event_name_2, 'NoEvent') AS event_name_2,
       COALESCE(event_type_2, 'NoEvent') AS event_type_2,
       snap_AFRICA, snap_AMERICA, snap_ASIA, snap_EUROPE, snap_MIDDLE_EAST,
       COALESCE(
         last_value(sell_price IGNORE NULLS) OVER (PARTITION BY item_id, store_id ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         first_value(sell_price IGNORE NULLS) OVER (PARTITION BY item_id, store_id ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
         0.0) AS sell_price
FROM merged{suffix}
""")

# the split date comes from the sales; the calendar runs on
view("cutoff", ("bounds",), """
SELECT CAST(hi - 27 AS DATE) AS cut FROM bounds
""")


def lag_days(days: int, y: str = "CAST(sales AS DOUBLE)", part: str = "item_id, store_id", date: str = "date") -> str:
    """The value ``days`` days earlier, 0 on a missing day, NULL before the series began."""
    return (f"CASE WHEN CAST({date} - {days} AS DATE) >= min({date}) OVER (PARTITION BY {part}) THEN COALESCE(max({y}) OVER "
            f"(PARTITION BY {part} ORDER BY {date} RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL {days} DAY PRECEDING), 0.0) END")


def lag_from(lag: int, horizon: int = 28, cut: str = "(SELECT cut FROM cutoff)", part: str = "item_id, store_id", date: str = "date") -> str:
    """Seasonal-naive value from the day before ``cut``: step h repeats the day lag * ceil(h / lag) before it."""
    turn = f"(date_diff('day', {cut}, {date}) // {lag} + 1)"
    whens = " ".join(f"WHEN {turn} = {k} THEN {lag_days(lag * k, part=part, date=date)}" for k in range(1, -(-horizon // lag) + 1))
    return f"CASE {whens} END"


# forecast fixture: last 28 days, yhat = sales 28 days earlier
view("forecast", ("panel", "cutoff"), f"""
SELECT unique_id, ds, y, yhat FROM (
  SELECT item_id || '_' || store_id AS unique_id, date AS ds, CAST(sales AS DOUBLE) AS y, {lag_days(28)} AS yhat
  FROM panel) t
WHERE ds >= (SELECT cut FROM cutoff)
""")


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    # views used more than once are computed once
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1].strip()})" for n in order) + "\n"


def q(*names: str, body: str) -> str:
    """Compose a query: fixture views as CTEs (referred to by name) + body."""
    text = with_views(*names) + body
    return text
