"""Inventory queries Q01-Q26."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.operators import forecasting as fc
from shelfline.operators import inventory as inv
from shelfline.plans import inputs
from shelfline.plans.inputs import AS_OF, DAYS, WINDOW_START
from shelfline.plans.registry import query
from shelfline.sources import roles

RATE = "(90 / CAST(7.0 AS DOUBLE))"
IN_WINDOW = "sale_date BETWEEN DATE '2001-08-01' - 90 AND DATE '2001-08-01'"
IN_TREND = "sale_date BETWEEN DATE '2001-08-01' - 84 AND DATE '2001-08-01'"
SUNDAY = "CAST({0} - CAST(dayofweek({0}) AS INTEGER) AS DATE)"
BOOK = """(pricebook_name IS NULL OR (lower(pricebook_name) NOT LIKE '%sample%'
  AND lower(pricebook_name) NOT LIKE '%suggested%'))"""


def _orders_where(days: int) -> str:
    return f"""account_type IN ('Distributor', 'Distribution Center') AND order_status NOT IN ('Draft', 'Cancelled')
  AND order_date BETWEEN DATE '2001-08-01' - {days} AND DATE '2001-08-01' AND {BOOK}"""


ORDER_TOTALS = f"""
SELECT account_id, customer_name AS distributor_name, CAST(sum(quantity) AS BIGINT) AS qty_ordered_cases,
  CAST(sum(quantity * coalesce(pack_size, 1)) AS BIGINT) AS qty_ordered,
  CAST(sum(line_total_price) AS DOUBLE) AS order_value, count(DISTINCT order_id) AS order_count,
  max(order_date) AS last_order_date
FROM b2b_order_line LEFT JOIN sku_map ON sku = sf_sku
WHERE {_orders_where(90)}
GROUP BY account_id, customer_name"""

DEPLETION = f"""
SELECT dist_code AS distributor_code, CAST(sum(units) AS BIGINT) AS qty_depleted,
  count(DISTINCT acct_code) AS stores_reached, count(*) AS transaction_count,
  CAST(sum(units) AS BIGINT) / {RATE} AS weekly_depletion_rate
FROM sold WHERE {IN_WINDOW} GROUP BY dist_code"""

CHANNEL_REVENUE = f"""
SELECT CAST(sum(line_total_price) AS DOUBLE) AS total_revenue FROM b2b_order_line
WHERE order_status <> 'Draft' AND order_date BETWEEN DATE '2001-08-01' - 90 AND DATE '2001-08-01' AND {BOOK}"""

COMBINED_CTES = f"""order_totals AS ({ORDER_TOTALS}), depletion AS ({DEPLETION}),
real_dist AS (SELECT * FROM distributor WHERE NOT is_parent_rollup),
rollup_rows AS (
  SELECT o.account_id, o.distributor_name, o.qty_ordered_cases, o.qty_ordered, o.order_value, o.order_count,
    array_to_string(list_sort(list_distinct(list(v.distributor_code))), ', ') AS vip_codes,
    CAST(sum(d.qty_depleted) AS BIGINT) AS total_qty_depleted, CAST(sum(d.stores_reached) AS BIGINT) AS unique_stores,
    CAST(sum(d.transaction_count) AS BIGINT) AS depletion_transactions, max(v.total_retailers) AS total_retailers,
    count(v.distributor_code) > 0 AS has_vip_match
  FROM order_totals o
    LEFT JOIN real_dist v ON o.account_id = v.sf_account_id OR o.account_id = v.parent_sf_account_id
    LEFT JOIN depletion d ON v.distributor_code = d.distributor_code
  GROUP BY o.account_id, o.distributor_name, o.qty_ordered_cases, o.qty_ordered, o.order_value, o.order_count),
vip_only AS (
  SELECT v.distributor_code AS account_id, v.distributor_name, CAST(0 AS BIGINT) AS qty_ordered_cases,
    CAST(0 AS BIGINT) AS qty_ordered, CAST(0 AS DOUBLE) AS order_value, CAST(0 AS BIGINT) AS order_count,
    v.distributor_code AS vip_codes, d.qty_depleted AS total_qty_depleted, d.stores_reached AS unique_stores,
    d.transaction_count AS depletion_transactions, v.total_retailers, TRUE AS has_vip_match
  FROM real_dist v JOIN depletion d ON v.distributor_code = d.distributor_code
  WHERE v.distributor_code NOT IN (SELECT v2.distributor_code FROM order_totals o JOIN real_dist v2
    ON o.account_id = v2.sf_account_id OR o.account_id = v2.parent_sf_account_id))"""

WITH_RATE = f"*, total_qty_depleted / {RATE} AS weekly_depletion_rate"

HEALTH_CTES = f"""{COMBINED_CTES}, health AS (
SELECT account_id AS distributor_code, distributor_name, account_id AS sfdc_distributor_account_id,
  coalesce(total_retailers, 0) AS total_retailers, qty_ordered AS total_qty_ordered,
  order_value AS total_order_value, order_count AS total_orders,
  (SELECT total_revenue FROM ({CHANNEL_REVENUE})) AS all_channel_revenue,
  coalesce(total_qty_depleted, 0) AS total_qty_depleted, coalesce(unique_stores, 0) AS unique_stores,
  coalesce(depletion_transactions, 0) AS depletion_transactions,
  coalesce(total_qty_depleted / {RATE}, 0) AS weekly_depletion_rate, has_vip_match,
  CASE WHEN has_vip_match THEN vip_codes END AS vip_codes,
  CASE WHEN total_qty_depleted > 0 THEN round(qty_ordered / total_qty_depleted, 2) END AS order_depletion_ratio,
  CASE WHEN total_qty_depleted > 0
    THEN round((qty_ordered - total_qty_depleted) / (total_qty_depleted / {RATE}), 1) END AS weeks_of_inventory,
  CASE WHEN coalesce(total_qty_depleted, 0) = 0 AND qty_ordered > 0 THEN 'No Depletion Data'
    WHEN qty_ordered = 0 AND total_qty_depleted > 0 THEN 'No Recent Orders'
    WHEN total_qty_depleted > 0 AND qty_ordered / total_qty_depleted > 1.3 THEN 'Overstock'
    WHEN total_qty_depleted > 0 AND qty_ordered / total_qty_depleted < 0.7 THEN 'Understock'
    WHEN total_qty_depleted > 0 THEN 'Balanced' ELSE 'No Data' END AS inventory_status
FROM (SELECT * FROM rollup_rows UNION ALL SELECT * FROM vip_only))"""

WEEKLY = f"""
SELECT coalesce(o.week_start, d.week_start) AS week_start, coalesce(qty_ordered, 0) AS qty_ordered,
  coalesce(order_value, 0) AS order_value, coalesce(order_count, 0) AS order_count,
  coalesce(qty_depleted, 0) AS qty_depleted, coalesce(stores_reached, 0) AS stores_reached
FROM (SELECT {SUNDAY.format('order_date')} AS week_start,
    CAST(sum(quantity * coalesce(pack_size, 1)) AS BIGINT) AS qty_ordered,
    CAST(sum(line_total_price) AS DOUBLE) AS order_value, count(DISTINCT order_id) AS order_count
  FROM b2b_order_line LEFT JOIN sku_map ON sku = sf_sku WHERE {_orders_where(84)} GROUP BY 1) o
FULL JOIN (SELECT {SUNDAY.format('sale_date')} AS week_start, CAST(sum(units) AS BIGINT) AS qty_depleted,
    count(DISTINCT acct_code) AS stores_reached FROM sold WHERE {IN_TREND} GROUP BY 1) d
  ON o.week_start = d.week_start"""

FAMILY_RULE = """CASE WHEN item_desc LIKE '%Seltzer%' OR (item_desc LIKE '%oz' AND units_per_case = 24) THEN 'Cans'
  WHEN item_desc LIKE '%750%' OR item_desc LIKE '%ml' THEN 'Bottles'
  WHEN item_desc LIKE '%Shot%' OR item_desc LIKE '%2 oz%' THEN 'Shots' ELSE 'Other' END"""

FAMILY_WEEKS = f"""
SELECT {SUNDAY.format('sale_date')} AS week_start, coalesce(product_family, 'Other') AS product_family,
  CAST(sum(units) AS BIGINT) AS qty_depleted, count(DISTINCT acct_code) AS stores_reached
FROM sold LEFT JOIN (SELECT item_code AS fam_code, {FAMILY_RULE} AS product_family FROM item_now) f
  ON sold.item_code = fam_code
WHERE {IN_TREND} GROUP BY 1, 2"""

DIST_WEEKS = f"""
SELECT *, avg(qty_depleted) OVER (PARTITION BY distributor_code ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ma_4wk,
  lag(qty_depleted, 4) OVER (PARTITION BY distributor_code ORDER BY week_start) AS qty_4wk_ago
FROM (SELECT distributor_code, distributor_name, {SUNDAY.format('sale_date')} AS week_start,
    CAST(sum(units) AS BIGINT) AS qty_depleted, count(DISTINCT acct_code) AS stores_reached,
    count(DISTINCT item_code) AS skus_sold
  FROM sold JOIN distributor ON dist_code = distributor_code AND NOT is_parent_rollup
  WHERE {IN_TREND} GROUP BY 1, 2, 3)"""

PRODUCTS = f"""
SELECT distributor_code, distributor_name, item_code, coalesce(item_desc, item_code) AS product_name, brand_desc AS brand,
  CAST(sum(units) AS BIGINT) AS qty_depleted, count(DISTINCT acct_code) AS stores_reached,
  count(*) AS transaction_count, round(CAST(sum(units) AS BIGINT) / {RATE}, 1) AS weekly_depletion_rate,
  CASE WHEN CAST(sum(units) AS BIGINT) / {RATE} >= 60 THEN 'High Velocity'
    WHEN CAST(sum(units) AS BIGINT) / {RATE} >= 18 THEN 'Medium Velocity' ELSE 'Low Velocity' END AS velocity_status
FROM sold JOIN distributor ON dist_code = distributor_code
WHERE {IN_WINDOW} GROUP BY distributor_code, distributor_name, item_code, item_desc, brand_desc"""

STATES = f"""
SELECT state, count(DISTINCT dist_code) AS distributor_count, CAST(sum(qty) AS BIGINT) AS total_depleted,
  CAST(sum(doors) AS BIGINT) AS total_doors, CAST(sum(pods) AS BIGINT) AS total_pods,
  round(CAST(sum(pods) AS DOUBLE) / nullif(sum(doors), 0), 1) AS avg_pods_per_dist,
  round(CAST(sum(qty) AS BIGINT) / {RATE}, 0) AS weekly_rate
FROM (SELECT state, dist_code, sum(units) AS qty, count(DISTINCT acct_code) AS doors,
    count(DISTINCT acct_code || '|' || item_code) AS pods
  FROM sold JOIN distributor_state ON dist_code = distributor_id
  WHERE {IN_WINDOW} AND length(state) = 2 GROUP BY state, dist_code)
GROUP BY state"""

WOI = f"""
SELECT distributor_id, coalesce(code_name, parent_account_name) AS distributor_name,
  CASE WHEN qty_ordered IS NOT NULL THEN distributor_id ELSE mapped_parent END AS parent_account_id,
  parent_account_name, item AS vip_item_code, coalesce(item_desc, item) AS product_name, category AS product_category,
  coalesce(qty_ordered_cases, 0) AS qty_ordered_cases, coalesce(qty_ordered, 0) AS qty_ordered,
  coalesce(order_value, 0) AS order_value, coalesce(qty_depleted, 0) AS qty_depleted,
  coalesce(qty_depleted, 0) / {RATE} AS weekly_depletion_rate,
  CASE WHEN qty_depleted > 0 THEN round((coalesce(qty_ordered, 0) - qty_depleted) / (qty_depleted / {RATE}), 1) END AS weeks_of_inventory,
  CASE WHEN coalesce(qty_depleted, 0) = 0 AND coalesce(qty_ordered, 0) > 0 THEN 'No Depletion'
    WHEN coalesce(qty_ordered, 0) = 0 AND qty_depleted > 0 THEN 'No Orders'
    WHEN qty_depleted > 0 AND qty_ordered / qty_depleted > 1.3 THEN 'Overstock'
    WHEN qty_depleted > 0 AND qty_ordered / qty_depleted < 0.7 THEN 'Understock'
    WHEN qty_depleted > 0 THEN 'Balanced' ELSE 'No Data' END AS inventory_status,
  CASE WHEN coalesce(qty_depleted, 0) / {RATE} >= 60 THEN 'High' WHEN coalesce(qty_depleted, 0) / {RATE} >= 18 THEN 'Medium'
    ELSE 'Low' END AS velocity_tier,
  CASE WHEN qty_depleted > 0 THEN round(coalesce(qty_ordered, 0) / qty_depleted, 2) END AS order_depletion_ratio,
  CAST(coalesce(qty_ordered, 0) - coalesce(qty_depleted, 0) AS DOUBLE) AS implied_inventory_delta,
  coalesce(dc_count, 0) AS dc_count, last_order_date, last_depletion_date
FROM (
  SELECT coalesce(b.distributor_id, s.distributor_id) AS distributor_id, coalesce(b.item, s.item) AS item,
    b.* EXCLUDE (distributor_id, item), s.* EXCLUDE (distributor_id, item)
  FROM (
    SELECT coalesce(owner, account_id) AS distributor_id, sku AS item, min(customer_name) AS parent_account_name,
      CAST(sum(quantity) AS BIGINT) AS qty_ordered_cases,
      CAST(sum(quantity * coalesce(pack_size, 1)) AS BIGINT) AS qty_ordered,
      CAST(sum(line_total_price) AS DOUBLE) AS order_value, max(order_date) AS last_order_date
    FROM b2b_order_line LEFT JOIN sku_map ON sku = sf_sku LEFT JOIN (
      SELECT account, coalesce(max(CASE WHEN account = owner THEN owner END), min(owner)) AS owner
      FROM (SELECT sf_account_id AS account, parent_sf_account_id AS owner FROM distributor WHERE NOT is_parent_rollup
        UNION ALL SELECT parent_sf_account_id, parent_sf_account_id FROM distributor WHERE NOT is_parent_rollup)
      GROUP BY account) ON account_id = account
    WHERE {_orders_where(90)} GROUP BY 1, 2) b
  FULL JOIN (
    SELECT parent_sf_account_id AS distributor_id, item_code AS item, min(distributor_name) AS code_name,
      max(parent_sf_account_id) AS mapped_parent, CAST(sum(units) AS BIGINT) AS qty_depleted,
      count(DISTINCT dist_code) AS dc_count, max(sale_date) AS last_depletion_date
    FROM sold JOIN distributor ON dist_code = distributor_code AND NOT is_parent_rollup
    WHERE {IN_WINDOW} GROUP BY 1, 2) s
  ON b.distributor_id = s.distributor_id AND b.item = s.item)
LEFT JOIN item_now ON item = item_code"""


@query(
    "Q01_uom_to_units",
    """SELECT uom, count(*) AS lines, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(units) AS BIGINT) AS units
FROM sold WHERE sale_date IS NOT NULL GROUP BY uom""",
)
def _(t):
    return inv.units_by_measure(inv.sell_through_lines(roles.sell_through_raw(t, with_account=False)), inputs.items(t))


@query("Q02_distributor_order_totals", ORDER_TOTALS)
def _(t):
    return inputs.order_totals(t)


@query("Q03_all_channel_revenue", CHANNEL_REVENUE)
def _(t):
    return inv.all_channel_revenue(roles.b2b_order_line(t, WINDOW_START, with_customer=False), AS_OF, DAYS)


@query("Q04_distributor_depletion", DEPLETION)
def _(t):
    return inputs.depletion(t)


@query("Q05_parent_rollup", f"WITH {COMBINED_CTES} SELECT * REPLACE (CASE WHEN has_vip_match THEN vip_codes END AS vip_codes), total_qty_depleted / {RATE} AS weekly_depletion_rate FROM rollup_rows")
def _(t):
    return inv.parent_rollup(inputs.order_totals(t), roles.distributor(t), inputs.depletion(t), DAYS)


@query("Q06_sell_through_only", f"WITH {COMBINED_CTES} SELECT {WITH_RATE} FROM vip_only")
def _(t):
    return inv.sell_through_only(
        inputs.order_totals(t), roles.distributor(t), inputs.depletion(t), DAYS
    )


@query("Q07_inventory_health", f"WITH {HEALTH_CTES} SELECT * FROM health")
def inventory_health(t):
    return inputs.health(t)


@query("Q08_product_depletion", PRODUCTS)
def _(t):
    return inputs.products(t)


@query("Q08_without_rollups", PRODUCTS.replace("WHERE", "WHERE NOT is_parent_rollup AND"))
def _(t):
    lines = inputs.sold_lines(t, inputs.WINDOW_START)
    return inv.product_depletion(lines, inputs.items(t), roles.distributor(t), AS_OF, inputs.DAYS, exclude_rollups=True)


@query("Q09_state_depletion", STATES)
def _(t):
    return inputs.states(t)


@query("Q10_weekly_orders_and_depletion", WEEKLY)
def _(t):
    return inputs.weekly(t)


@query("Q11_weekly_family_depletion", FAMILY_WEEKS)
def _(t):
    return inputs.family_weeks(t)


@query("Q12_distributor_weekly_trend", DIST_WEEKS, rounded=["ma_4wk"])
def _(t):
    return inputs.distributor_weeks(t)


@query("Q13_weeks_of_inventory_by_sku", WOI)
def _(t):
    return inputs.woi(t)


STATS = """count(*) AS n, avg(v) AS mean, avg(v) FILTER (WHERE up <= 4) AS first4,
  avg(v) FILTER (WHERE down <= 4) AS last4, avg(v) FILTER (WHERE down BETWEEN 5 AND 8) AS previous4,
  max(v) FILTER (WHERE down = 1) AS last_value, max(v) FILTER (WHERE down = 4) AS fourth_last,
  stddev_samp(v) AS sd_samp, stddev_pop(v) AS sd_pop, max(week_start) AS last_time"""

RISK_CTES = f"""{HEALTH_CTES}, trend_rows AS ({DIST_WEEKS}),
listed AS (SELECT DISTINCT row_code, trim(c) AS c FROM (
  SELECT distributor_code AS row_code, unnest(string_split(coalesce(vip_codes, distributor_code), ',')) AS c FROM health)),
added AS (SELECT row_code, week_start, CAST(sum(qty_depleted) AS DOUBLE) AS v
  FROM listed JOIN trend_rows ON c = distributor_code GROUP BY ALL),
stats AS (SELECT row_code AS code, {STATS} FROM (
  SELECT *, row_number() OVER (PARTITION BY row_code ORDER BY week_start) AS up,
    row_number() OVER (PARTITION BY row_code ORDER BY week_start DESC) AS down FROM added) GROUP BY row_code),
r1 AS (SELECT h.*, CASE WHEN n >= 8 AND first4 > 0 THEN (last4 - first4) / first4
    ELSE 0 END AS trend,
  CASE WHEN n >= 4 AND mean > 0 THEN sd_samp / mean ELSE 0.2 END AS cv
  FROM health h LEFT JOIN stats ON h.distributor_code = code),
r2 AS (SELECT *, CASE WHEN weekly_depletion_rate > 0 THEN weekly_depletion_rate * (1 + trend * 0.5) ELSE 0 END AS adj FROM r1),
r3 AS (SELECT *, CASE WHEN adj > 0 AND total_qty_ordered > 0 THEN total_qty_ordered / adj
    WHEN weeks_of_inventory > 0 THEN weeks_of_inventory END AS w FROM r2),
risk AS (SELECT distributor_code, distributor_name, weeks_of_inventory AS current_inventory_weeks, weekly_depletion_rate,
  adj AS adjusted_weekly_rate, trend * 100 AS velocity_trend_pct, cv AS velocity_cv, w AS weeks_until_stockout,
  CAST(DATE '2001-08-01' + CAST(floor(round(w * 7, 9)) AS INTEGER) AS DATE) AS predicted_stockout_date,
  CASE WHEN w IS NOT NULL THEN least(100, greatest(0, least(100, 100 - w * 8)) * (1 + greatest(0, trend * 0.3))
      * (1 + least(0.3, cv * 0.5)))
    WHEN total_qty_depleted > 0 THEN 50 ELSE 0 END AS risk_score,
  CASE WHEN adj > 0 THEN greatest(0, adj * 8 - total_qty_ordered) ELSE 0 END AS reorder_qty_suggested,
  CASE WHEN adj <= 0 THEN 'N/A' WHEN w < 3 THEN 'CRITICAL' WHEN w < 6 THEN 'HIGH' WHEN w < 10 THEN 'MEDIUM'
    ELSE 'LOW' END AS reorder_urgency,
  total_qty_ordered AS qty_ordered_period, total_qty_depleted AS qty_depleted_period FROM r3)"""

RISK_ROUNDED = ["adjusted_weekly_rate", "velocity_trend_pct", "velocity_cv", "weeks_until_stockout",
                "risk_score", "reorder_qty_suggested"]


def _risk(t):
    return fc.stockout_risk(inputs.health(t, inputs.WEEKS), None, AS_OF)


def _risk_from_trends(t):
    return fc.stockout_risk(inputs.health(t), inputs.distributor_weeks(t), AS_OF)


@query("Q14_stockout_risk", f"WITH {RISK_CTES} SELECT * FROM risk", rounded=RISK_ROUNDED, digits=4)
def _(t):
    return _risk(t)


@query("Q14_risk_from_trends", f"WITH {RISK_CTES} SELECT * FROM risk", rounded=RISK_ROUNDED, digits=4)
def _(t):
    return _risk_from_trends(t)


@query(
    "Q14_stockout_timeline",
    f"""WITH {RISK_CTES} SELECT * FROM risk WHERE predicted_stockout_date IS NOT NULL
ORDER BY weeks_until_stockout, distributor_code LIMIT 15""",
    rounded=RISK_ROUNDED,
    digits=4,
)
def _(t):
    return fc.stockout_timeline(_risk(t))


PROJECTION = """SELECT distributor_code, distributor_name, CAST(DATE '2001-08-01' + 7 * i AS DATE) AS forecast_week,
  i AS week_number, adjusted_weekly_rate AS projected_depletion,
  greatest(0, qty_ordered_period - i * adjusted_weekly_rate) AS projected_inventory,
  qty_ordered_period - i * adjusted_weekly_rate <= 0 AS is_stockout, adjusted_weekly_rate AS weekly_depletion_rate
FROM risk, (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS i)"""


@query(
    "Q15_inventory_projection",
    f"WITH {RISK_CTES} {PROJECTION}",
    rounded=["projected_depletion", "projected_inventory", "weekly_depletion_rate"],
    digits=4,
)
def _(t):
    return fc.inventory_projection(_risk(t), AS_OF)


@query(
    "Q15_projection_by_week",
    f"""WITH {RISK_CTES} SELECT forecast_week, sum(projected_depletion) AS total_projected_depletion,
  count(*) FILTER (WHERE is_stockout) AS distributors_in_stockout FROM ({PROJECTION}) GROUP BY forecast_week""",
    rounded=["total_projected_depletion"],
    digits=3,
)
def _(t):
    return fc.projection_by_week(fc.inventory_projection(_risk(t), AS_OF))


def _forecast_sql(key: str, rows: str) -> str:
    """Check for the damped trend: the week-by-week recursion itself."""
    return f"""
WITH RECURSIVE pts AS ({rows}),
st AS (SELECT {key}, {STATS} FROM (SELECT *,
    row_number() OVER (PARTITION BY {key} ORDER BY week_start) AS up,
    row_number() OVER (PARTITION BY {key} ORDER BY week_start DESC) AS down FROM pts) GROUP BY {key}),
base AS (SELECT {key}, last_time, mean, CASE WHEN n >= 4 THEN last4 ELSE mean END AS l0,
  CASE WHEN n >= 8 THEN (last4 - previous4) / 4 WHEN n >= 4 THEN (last_value - fourth_last) / 4 ELSE 0 END AS t0,
  least(CASE WHEN mean > 0 THEN sd_pop / mean ELSE 0.15 END, 0.25) AS cv FROM st),
rec AS (SELECT {key}, last_time, mean, l0, cv, 0 AS step, CAST(l0 AS DOUBLE) AS lvl, CAST(t0 AS DOUBLE) AS tr FROM base
  UNION ALL SELECT {key}, last_time, mean, l0, cv, step + 1, lvl + tr * 0.92 + 0.05 * (mean - lvl), tr * 0.92
  FROM rec WHERE step < 12),
fc AS (SELECT {key}, last_time, step, greatest(lvl, 0.5 * l0) AS forecast, 0.5 * l0 AS fl,
  cv * (1 + 0.1 * sqrt(step)) * greatest(lvl, 0.5 * l0) AS u FROM rec WHERE step > 0)
SELECT {key}, last_time, step, forecast, greatest(forecast - 0.8 * u, fl * 0.8) AS ci_80_lower,
  forecast + 0.8 * u AS ci_80_upper, greatest(forecast - 1.2 * u, fl * 0.6) AS ci_95_lower,
  forecast + 1.2 * u AS ci_95_upper FROM fc"""


CI = ["ci_80_lower", "ci_80_upper", "ci_95_lower", "ci_95_upper"]


@query(
    "Q16_damped_trend_forecast",
    _forecast_sql("distributor_code", f"SELECT distributor_code, week_start, CAST(qty_depleted AS DOUBLE) AS v FROM ({DIST_WEEKS})"),
    rounded=["forecast", *CI],
    digits=7,
)
def _(t):
    return fc.damped_trend_forecast(
        inputs.distributor_weeks(t), "week_start", "qty_depleted", ["distributor_code"]
    )


def _two_series_sql() -> str:
    one = _forecast_sql("series", f"""SELECT 'depletion' AS series, week_start, CAST(qty_depleted AS DOUBLE) AS v FROM ({WEEKLY})
  UNION ALL SELECT 'orders', week_start, order_value FROM ({WEEKLY})""")
    cols = []
    for s in ("depletion", "orders"):
        pick = lambda c: f"max({c}) FILTER (WHERE series = '{s}')"
        cols += [f"{pick('forecast')} AS {s}_{m}" for m in ("ensemble", "lr", "es", "mat")]
        cols += [f"{pick(c)} AS {s}_{c}" for c in CI]
    return f"""SELECT CAST(last_time + 7 * step AS DATE) AS week_start, TRUE AS is_forecast, {', '.join(cols)}
FROM ({one}) GROUP BY 1"""


TWO_SERIES = [f"{s}_{c}" for s in ("depletion", "orders") for c in ("ensemble", "lr", "es", "mat", *CI)]


@query("Q17_two_series_forecast", _two_series_sql(), rounded=TWO_SERIES, digits=3)
def _(t):
    return fc.two_series_forecast(inputs.weekly(t))


@query(
    "Q17_three_models",
    f"""WITH pts AS (SELECT distributor_code, week_start, CAST(qty_depleted AS DOUBLE) AS v FROM ({DIST_WEEKS})),
s AS (SELECT distributor_code, count(*) AS n, max(week_start) AS last_time, avg(v) AS mean, regr_slope(v, i) AS slope, avg(i) AS mid,
    list_reduce(list(v ORDER BY week_start), lambda a, x: a * 0.7 + x * 0.3) AS es, avg(v) FILTER (WHERE down <= 4) AS last4,
    avg(v) FILTER (WHERE down BETWEEN 5 AND 8) AS before4
  FROM (SELECT *, row_number() OVER (PARTITION BY distributor_code ORDER BY week_start) AS i,
    row_number() OVER (PARTITION BY distributor_code ORDER BY week_start DESC) AS down FROM pts) GROUP BY 1 HAVING count(*) >= 4)
SELECT *, (lr + es + mat) / 3 AS ensemble FROM (
  SELECT distributor_code, last_time, step, greatest(0, mean + slope * (n + step - mid)) AS lr, greatest(0, es) AS es,
    greatest(0, last4 + step * CASE WHEN n >= 8 THEN (last4 - before4) / 4 ELSE 0 END) AS mat
  FROM s, (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS step))""",
    rounded=["lr", "es", "mat", "ensemble"],
    digits=5,
)
def _(t):
    return fc.three_model_forecast(inputs.distributor_weeks(t), "week_start", "qty_depleted", ["distributor_code"])


@query(
    "Q18_period_filter",
    f"""SELECT period, start_date, CAST(DATE '2001-08-01' - start_date AS INTEGER) AS lookback_days,
  CAST(greatest((DATE '2001-08-01' - start_date) // 7, 4) AS INTEGER) AS trend_weeks,
  count(sale_date) AS lines, CAST(coalesce(sum(qty), 0) AS BIGINT) AS total,
  coalesce(sum(qty), 0) / nullif((DATE '2001-08-01' - start_date) / CAST(7 AS DOUBLE), 0) AS weekly_rate
FROM (SELECT unnest(['MTD', 'QTD', 'YTD', '30d', '60d', '90d', '180d']) AS period, unnest([DATE '2001-08-01', DATE '2001-07-01',
  DATE '2001-01-01', DATE '2001-07-02', DATE '2001-06-02', DATE '2001-05-03', DATE '2001-02-02']) AS start_date)
  LEFT JOIN sold ON sale_date >= start_date AND sale_date <= DATE '2001-08-01'
GROUP BY period, start_date""",
)
def _(t):
    from datetime import date

    periods = ["MTD", "QTD", "YTD", "30d", "60d", "90d", "180d"]
    return inv.period_totals(
        inputs.sold_lines(t, date(2001, 1, 1), with_account=False), "sale_date", "qty", AS_OF, periods
    )


FAMILY_SIZE = "CASE product_family WHEN 'Cans' THEN 24 WHEN 'Bottles' THEN 6 WHEN 'Shots' THEN 36 ELSE 6 END"


@query(
    "Q19_case_conversion",
    f"""SELECT product_family, units, case_size, cases, sum(units) OVER () / sum(cases) OVER () AS blended_divisor
FROM (SELECT product_family, CAST(sum(qty_depleted) AS BIGINT) AS units, {FAMILY_SIZE} AS case_size,
  CAST(sum(qty_depleted) AS BIGINT) / {FAMILY_SIZE} AS cases FROM ({FAMILY_WEEKS}) GROUP BY product_family)""",
    rounded=["blended_divisor", "cases"],
)
def _(t):
    return inv.case_conversion(inputs.family_weeks(t))


@query(
    "Q20_health_summary",
    f"""WITH {HEALTH_CTES} SELECT *, round(100.0 * overstock_count / greatest(with_depletion, 1), 1) AS overstock_pct,
  round(100.0 * understock_count / greatest(with_depletion, 1), 1) AS understock_pct,
  coalesce(round(total_qty_ordered / total_qty_depleted, 2), 0) AS order_depletion_ratio
FROM (SELECT count(*) AS distributors, max(all_channel_revenue) AS all_channel_revenue,
  CAST(sum(CAST(total_order_value AS DECIMAL(18,2))) AS DOUBLE) AS total_order_value,
  CAST(sum(total_qty_ordered) AS BIGINT) AS total_qty_ordered,
  CAST(sum(total_qty_depleted) AS BIGINT) AS total_qty_depleted,
  count(*) FILTER (WHERE total_qty_depleted > 0) AS with_depletion,
  count(*) FILTER (WHERE total_qty_depleted > 0 AND weeks_of_inventory > 12) AS overstock_count,
  count(*) FILTER (WHERE total_qty_depleted > 0 AND weeks_of_inventory < 4) AS understock_count,
  count(*) FILTER (WHERE total_qty_depleted > 0 AND weeks_of_inventory BETWEEN 4 AND 12) AS balanced_count,
  count(*) FILTER (WHERE total_qty_depleted = 0) AS no_depletion_count,
  avg(weeks_of_inventory) FILTER (WHERE total_qty_depleted > 0 AND weeks_of_inventory > 0) AS avg_weeks FROM health)""",
    rounded=["avg_weeks"],
)
def _(t):
    return inv.health_summary(inputs.health(t))


@query(
    "Q21_top_over_under_stocked",
    f"""WITH {HEALTH_CTES}
SELECT * FROM (SELECT * FROM health WHERE inventory_status = 'Overstock' AND weeks_of_inventory IS NOT NULL
  ORDER BY weeks_of_inventory DESC, distributor_code LIMIT 10)
UNION ALL SELECT * FROM (SELECT * FROM health WHERE inventory_status = 'Understock' AND weeks_of_inventory IS NOT NULL
  ORDER BY weeks_of_inventory, distributor_code LIMIT 10)""",
)
def _(t):
    return inv.extreme_stock(inputs.health(t), ["distributor_code"])


@query(
    "Q21_top_skus_over_under_stocked",
    f"""WITH woi AS ({WOI})
SELECT label, inventory_status, weeks_of_inventory FROM (
SELECT *, substr(product_name, 1, 25) || ' @ ' || substr(distributor_name, 1, 20) AS label FROM (
  SELECT * FROM (SELECT * FROM woi WHERE inventory_status = 'Overstock' AND weeks_of_inventory IS NOT NULL
    ORDER BY weeks_of_inventory DESC, distributor_id, vip_item_code LIMIT 10)
  UNION ALL SELECT * FROM (SELECT * FROM woi WHERE inventory_status = 'Understock' AND weeks_of_inventory IS NOT NULL
    ORDER BY weeks_of_inventory, distributor_id, vip_item_code LIMIT 10)))""",
)
def _(t):
    extremes = inv.extreme_stock(inputs.woi(t), ["distributor_id", "vip_item_code"])
    return extremes.select(inv.sku_label().alias("label"), "inventory_status", "weeks_of_inventory")


@query(
    "Q22_top_products",
    f"""SELECT product_name, CAST(sum(qty_depleted) AS BIGINT) AS qty_depleted,
  CAST(sum(stores_reached) AS BIGINT) AS stores_reached, CAST(sum(transaction_count) AS BIGINT) AS transaction_count
FROM ({PRODUCTS}) GROUP BY product_name ORDER BY 2 DESC, 1 LIMIT 15""",
)
def _(t):
    return inv.top_products(inputs.products(t))


@query(
    "Q22_velocity_mix",
    f'SELECT velocity_status, count(*) AS "rows" FROM ({PRODUCTS}) GROUP BY velocity_status',
)
def _(t):
    return inv.velocity_mix(inputs.products(t))


@query(
    "Q23_state_share",
    f"""SELECT *, total_pods / CAST(CASE WHEN total_doors = 0 THEN 1 ELSE total_doors END AS DOUBLE) AS avg_pods,
  CAST(100 AS DOUBLE) * total_depleted / sum(total_depleted) OVER () AS depletion_share_pct FROM ({STATES})""",
    rounded=["avg_pods", "depletion_share_pct"],
)
def _(t):
    return inv.state_share(inputs.states(t))


@query(
    "Q23_state_coverage",
    f"""SELECT count(*) AS states, CAST(sum(total_depleted) AS BIGINT) AS total_depleted,
  CAST(sum(total_doors) AS BIGINT) AS total_doors, CAST(sum(total_pods) AS BIGINT) AS total_pods,
  arg_max(state, total_depleted) AS top_state,
  CAST(100 AS DOUBLE) * max(total_depleted) / sum(total_depleted) AS top_state_pct FROM ({STATES})""",
    rounded=["top_state_pct"],
)
def _(t):
    return inv.state_coverage(inputs.states(t))


HEAT = {"2mg 750ml Bottle": "2mg Bottle", "5mg 750ml Bottle": "5mg Bottle", "10mg 750ml Bottle": "10mg Bottle",
        "10mg 16oz Seltzer": "10mg Seltzer", "5mg 12oz Seltzer": "5mg Seltzer", "5mg 2oz Shot": "5mg Shot",
        "10mg 2oz Shot": "10mg Shot"}


@query(
    "Q24_weeks_heat_map",
    f"""WITH cells AS (SELECT distributor_name, product_category, avg(weeks_of_inventory) AS weeks,
    sum(CAST(order_value AS DECIMAL(18,2))) AS value
  FROM ({WOI}) WHERE product_category NOT LIKE '%25mg%' AND weeks_of_inventory BETWEEN -52 AND 52 GROUP BY 1, 2),
big AS (SELECT distributor_name FROM cells GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 15)
SELECT distributor_name, """
    + ", ".join(
        f"greatest(least(coalesce(max(weeks) FILTER (WHERE product_category = '{c}'), 0), 52), -52) AS \"{s}\""
        for c, s in HEAT.items()
    )
    + " FROM cells WHERE distributor_name IN (SELECT distributor_name FROM big) GROUP BY 1",
    rounded=list(HEAT.values()),
)
def _(t):
    return inv.weeks_heat_map(inputs.woi(t))


@query(
    "Q25_weeks_detail",
    f"""SELECT distributor_name, product_name, product_category, qty_ordered, qty_depleted, weekly_depletion_rate,
  weeks_of_inventory, inventory_status, velocity_tier, dc_count
FROM ({WOI}) WHERE inventory_status IN ('Overstock', 'Understock', 'No Orders')
  AND product_category IN ('5mg 12oz Seltzer', '10mg 2oz Shot')""",
)
def _(t):
    return inv.weeks_detail(
        inputs.woi(t),
        distributors=["All"],
        statuses=["Overstock", "Understock", "No Orders"],
        categories=["5mg 12oz Seltzer", "10mg 2oz Shot"],
    )


@query(
    "Q26_family_share",
    f"""SELECT product_family, CAST(sum(qty_depleted) AS BIGINT) AS qty_depleted,
  CAST(sum(qty_depleted) AS BIGINT) / {FAMILY_SIZE} AS cases,
  round(CAST(100 AS DOUBLE) * sum(qty_depleted) / sum(sum(qty_depleted)) OVER (), 1) AS share_pct
FROM ({FAMILY_WEEKS}) GROUP BY product_family""",
)
def _(t):
    return inv.family_share(inputs.family_weeks(t))


@query(
    "Q26_smoothed_weeks",
    f"""SELECT *, CASE WHEN count(*) OVER w >= 2 THEN avg(qty_ordered) OVER w END AS orders_ma,
  CASE WHEN count(*) OVER w >= 2 THEN avg(qty_depleted) OVER w END AS depletion_ma
FROM ({WEEKLY}) WINDOW w AS (ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    rounded=["orders_ma", "depletion_ma"],
)
def _(t):
    return inv.smoothed_weeks(inputs.weekly(t))


@query(
    "Q14_reorder_table",
    f"""WITH {RISK_CTES} SELECT distributor_name, reorder_urgency, weeks_until_stockout, predicted_stockout_date,
  reorder_qty_suggested, adjusted_weekly_rate, velocity_trend_pct, risk_score FROM risk WHERE reorder_qty_suggested > 0""",
    rounded=["weeks_until_stockout", "reorder_qty_suggested", "adjusted_weekly_rate", "velocity_trend_pct", "risk_score"],
    digits=4,
)
def _(t):
    table = _risk(t).filter(F.col("reorder_qty_suggested") > 0)
    return table.orderBy(inv.urgency_order(), "distributor_name").select(
        "distributor_name", "reorder_urgency", "weeks_until_stockout", "predicted_stockout_date",
        "reorder_qty_suggested", "adjusted_weekly_rate", "velocity_trend_pct", "risk_score",
    )
