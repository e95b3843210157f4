"""Marketing scorecard queries Q61-Q66 (Q62 is with the door queries)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfline.operators import accounts as acc
from shelfline.operators import scorecard as sc
from shelfline.plans.accounts import SHEET_CTES, _sheet
from shelfline.plans.registry import query
from shelfline.sources import roles

START, END, TODAY = date(2001, 4, 1), date(2001, 6, 30), date(2001, 6, 20)
YEAR = 2001

RETAIL = """SELECT CAST(date_trunc('week', order_date) AS DATE) AS week_start, CAST(sum(line_total_price) AS DOUBLE) AS revenue
FROM b2b_order_line WHERE order_status <> 'Draft' AND order_date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30' GROUP BY 1"""
WEB = """SELECT CAST(date_trunc('week', order_date) AS DATE) AS week_start, CAST(sum(subtotal) AS DOUBLE) AS revenue
FROM d2c_order WHERE channel = 'shopify' AND financial_status IN ('paid', 'partially_refunded')
  AND order_date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30' GROUP BY 1"""
CUMULATIVE = f"""SELECT week_start, round(CAST(sum(CAST(revenue AS DECIMAL(18,2))) OVER (ORDER BY week_start) AS DOUBLE), 2)
  AS cumulative_revenue FROM ({RETAIL})"""


def _retail(t):
    return sc.weekly_retail_revenue(roles.b2b_order_line(t, START, with_customer=False), START, END)


def _web(t):
    return sc.weekly_web_revenue(roles.d2c_order(t, START), START, END)


# Counts that real pages hold: the number of their tracker, and a version in the text.
TRACKER, VERSION = r"track\(([\d,]+)\)", r"(?i)version ([\d,.]*\d[KMB]?)"


def _counts(t):
    return sc.follower_counts(t.pages, TRACKER, VERSION)


@query("Q61_weekly_retail_revenue", RETAIL)
def _(t):
    return _retail(t)


@query("Q61_weekly_web_revenue", WEB)
def _(t):
    return _web(t)


KEY = """CASE WHEN label = '' THEN NULL WHEN label = 'Urgent Orders Spring' THEN 'urgent_orders'
  WHEN label = 'High Priority' THEN 'high_priority_orders' WHEN label = 'Unspecified Orders' THEN 'unspecified_orders'
  WHEN label = 'Buying Doors' THEN 'buying_doors' WHEN label = 'Open Orders' THEN 'open_orders'
  WHEN label = 'Retail To Date' THEN 'retail_to_date' WHEN lower(label) LIKE '%even buyer orders%' THEN 'even_buyer_orders' END"""
KEYED = f"""(SELECT * FROM (SELECT *, max(position) OVER (PARTITION BY key) AS last_position
  FROM (SELECT *, {KEY} AS key FROM sheet_cell) WHERE key IS NOT NULL) WHERE position = last_position)"""
VALUES = f"""SELECT key, week, TRY_CAST(trim(replace(replace(cell, '$', ''), ',', '')) AS DOUBLE) AS value
FROM {KEYED} WHERE cell <> '' AND cell <> '0'"""
TOTALS = f"""SELECT DISTINCT key, CAST(total * 100 AS DOUBLE) AS sheet_total FROM {KEYED} WHERE code <> '2-HIGH'"""


@query("Q63_sheet_values", VALUES)
def _(t):
    return sc.sheet_values(roles.metric_sheet(t), YEAR, roles.METRICS, position="position")


@query("Q63_sheet_totals", TOTALS)
def _(t):
    return sc.sheet_totals(roles.metric_sheet(t), roles.METRICS, position="position")


@query("Q64_cumulative_revenue", CUMULATIVE)
def _(t):
    return sc.cumulative_weeks(_retail(t))


EXACT = r"""TRY_CAST(replace(regexp_extract(html, 'track\(([\d,]+)\)', 1), ',', '') AS BIGINT)"""
SHORT_TEXT = r"""upper(replace(regexp_extract(html, '(?i)version ([\d,.]*\d[KMB]?)', 1), ',', ''))"""
COUNTS = rf"""SELECT page_id, url, exact_count, CAST(floor(TRY_CAST(regexp_extract(raw, '^([\d.]+)', 1) AS DECIMAL(20,6))
  * CASE right(raw, 1) WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'B' THEN 1000000000 ELSE 1 END) AS BIGINT) AS abbreviated_count
FROM (SELECT page_id, url, {EXACT} AS exact_count, {SHORT_TEXT} AS raw FROM pages)"""


@query("Q66_follower_counts", COUNTS)
def _(t):
    return _counts(t)


GRID = f"""SELECT coalesce(l.key, s.key) AS key, coalesce(l.week, s.week) AS week, coalesce(live, value) AS value
FROM (SELECT 'retail_to_date' AS key, week_start AS week, cumulative_revenue AS live FROM ({CUMULATIVE})
  UNION ALL SELECT 'web_week', week_start, revenue FROM ({WEB})
  UNION ALL SELECT 'buying_doors', DATE '2001-06-18', CAST(n AS DOUBLE) FROM (
    SELECT count(DISTINCT vip_id) AS n FROM sheet WHERE days_since_last_order <= 90)
  UNION ALL SELECT 'largest_tracker', DATE '2001-06-18', CAST(n AS DOUBLE) FROM (
    SELECT max(exact_count) AS n FROM ({COUNTS}))) l
FULL JOIN ({VALUES}) s ON l.key = s.key AND l.week = s.week
WHERE coalesce(l.key, s.key) NOT IN ('retail_to_date', 'web_week') OR coalesce(l.week, s.week) >= DATE '2001-04-02'"""


def _grid(t):
    live = (
        sc.cumulative_weeks(_retail(t))
        .selectExpr("'retail_to_date' AS key", "week_start AS week", "cumulative_revenue AS value")
        .unionByName(_web(t).selectExpr("'web_week' AS key", "week_start AS week", "revenue AS value"))
    )
    doors = acc.active_doors(_sheet(t)).selectExpr("'buying_doors' AS key", "active_doors AS value")
    social = _counts(t).agg(F.max("exact_count").alias("value"))
    snapshots = doors.unionByName(social.selectExpr("'largest_tracker' AS key", "value"))
    written = sc.sheet_values(roles.metric_sheet(t), YEAR, roles.METRICS, position="position")
    return sc.metric_grid(live, snapshots, written, roles.SHEET_WEEKS, TODAY, roles.METRICS)


@query("Q65_metric_grid", f"WITH {SHEET_CTES} {GRID}")
def _(t):
    return _grid(t)


REGISTRY_SQL = " UNION ALL ".join(
    f"SELECT '{m.key}' AS key, '{m.name}' AS name, '{m.owner}' AS owner, '{m.source}' AS source, "
    f"CAST({m.target} AS DOUBLE) AS target, '{m.roll}' AS roll"
    for m in roles.METRICS
)


@query(
    "Q65_metric_scorecard",
    f"""WITH {SHEET_CTES}, grid AS ({GRID}), registry AS ({REGISTRY_SQL}),
rolled AS (SELECT key AS k, max(value) AS mx, sum(value) AS sm, arg_max(value, week) AS lt FROM grid
  WHERE week <= DATE '2001-06-20' GROUP BY 1),
v AS (SELECT r.*, coalesce(CASE roll WHEN 'max' THEN mx WHEN 'sum' THEN sm ELSE lt END, sheet_total) AS value
  FROM registry r LEFT JOIN rolled ON r.key = k LEFT JOIN ({TOTALS}) s ON r.key = s.key)
SELECT key, name, owner, source, target, value, pct AS pct_to_target,
  CASE WHEN pct >= 80 THEN 'green' WHEN pct >= 50 THEN 'yellow' ELSE 'red' END AS band
FROM (SELECT *, CASE WHEN value IS NOT NULL AND target > 0 THEN value / target * 100 ELSE 0 END AS pct FROM v)""",
    rounded=["value", "pct_to_target"],
    digits=2,
)
def _(t):
    registry = sc.registry_frame(t.spark, roles.METRICS)
    totals = sc.sheet_totals(roles.metric_sheet(t), roles.METRICS, position="position")
    return sc.metric_scorecard(registry, _grid(t), totals, TODAY)
