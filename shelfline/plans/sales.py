"""Sales queries Q40-Q60."""

from __future__ import annotations

from datetime import date

from shelfline.operators import forecasting as fc
from shelfline.operators import products as prod
from shelfline.operators import sales
from shelfline.plans.inputs import AS_OF, SALES_START
from shelfline.plans.registry import query
from shelfline.sources import roles

START, END = SALES_START, AS_OF
MOM_DAY = date(2001, 7, 31)
MOM_START = date(2001, 6, 1)
UTC_SINCE = date(2000, 7, 31)

LIVE = "order_status NOT IN ('Draft', 'Cancelled')"
RANGE = "BETWEEN DATE '2000-08-01' AND DATE '2001-08-01'"
MEASURES = """count(DISTINCT order_id) AS order_count, CAST(sum(line_revenue) AS DOUBLE) AS revenue,
  CAST(sum(units_qty) AS BIGINT) AS units"""
MONDAY = "CAST(date_trunc('week', {0}) AS DATE)"
DOW = "CAST(dayofweek({0}) + 1 AS INTEGER)"

B2B_DAILY = f"""SELECT order_date, {MEASURES}, {DOW.format('order_date')} AS day_of_week
FROM b2b_norm WHERE {LIVE} AND order_date {RANGE} GROUP BY order_date"""
B2B_WEEKLY = f"""SELECT {MONDAY.format('order_date')} AS week_start, {MEASURES}
FROM b2b_norm WHERE {LIVE} AND order_date {RANGE} GROUP BY 1"""
BY_ACCOUNT = f"""SELECT account_id, customer_name, account_type, u.name AS owner_name, {MEASURES},
  max(order_date) AS last_order_date, min(order_date) AS first_order_date
FROM b2b_norm LEFT JOIN account a ON account_id = a.id LEFT JOIN app_user u ON a.owner_id = u.id
WHERE {LIVE} AND order_date {RANGE} GROUP BY account_id, customer_name, account_type, u.name"""
B2B_STATE = f"""SELECT upper(trim(shipping_state)) AS state, {MEASURES}
FROM b2b_norm JOIN account a ON account_id = a.id
WHERE {LIVE} AND order_date {RANGE} AND shipping_state IS NOT NULL AND trim(shipping_state) <> '' GROUP BY 1"""


def _web_sql(column: str, weekly: bool = False) -> str:
    measures = f"count(DISTINCT id) AS order_count, CAST(sum({column}) AS DOUBLE) AS revenue"
    if weekly:
        return f"SELECT {MONDAY.format('local_day')} AS week_start, {measures} FROM web_order WHERE local_day {RANGE} GROUP BY 1"
    return f"""SELECT local_day AS order_date, {measures}, {DOW.format('local_day')} AS day_of_week
FROM web_order WHERE local_day {RANGE} GROUP BY local_day"""


NET, GROSS = "current_subtotal_price", "total_line_items_price"
CREDITS = f"""FROM credit_line WHERE detail_type = 'SalesItemLineDetail'
  AND (account_name LIKE '%:Refunds' OR account_name LIKE '%:Discounts') AND amount IS NOT NULL AND txn_date {RANGE}"""
CREDITS_DAILY = f"SELECT txn_date AS credit_date, CAST(sum(amount) AS DOUBLE) AS credit_amount {CREDITS} GROUP BY 1"
CREDITS_WEEKLY = f"SELECT {MONDAY.format('txn_date')} AS week_start, CAST(sum(amount) AS DOUBLE) AS credit_amount {CREDITS} GROUP BY 1"
NET_DAILY = f"""SELECT d.* REPLACE (round(revenue - coalesce(credit_amount, 0), 2) AS revenue)
FROM ({B2B_DAILY}) d LEFT JOIN ({CREDITS_DAILY}) c ON order_date = credit_date"""
NET_WEEKLY = f"""SELECT d.* REPLACE (round(revenue - coalesce(credit_amount, 0), 2) AS revenue)
FROM ({B2B_WEEKLY}) d LEFT JOIN ({CREDITS_WEEKLY}) c ON d.week_start = c.week_start"""


def _lines(t, since=START):
    return roles.b2b_order_line_norm(t, since)


def _web(t):
    return roles.web_order(t, UTC_SINCE)


def _documents(t):
    return roles.web_order_items(t, UTC_SINCE)


def _net_daily(t):
    daily = sales.b2b_daily(_lines(t), START, END)
    credits = sales.credits_daily(roles.credit_memo(t), START, END)
    return sales.net_of_credits(daily, credits, "order_date", "credit_date")


def _net_weekly(t):
    weekly = sales.b2b_weekly(_lines(t), START, END)
    credits = sales.credits_weekly(roles.credit_memo(t), START, END)
    return sales.net_of_credits(weekly, credits, "week_start", "week_start")


def _by_account(t):
    return sales.b2b_by_account(_lines(t), roles.account(t), roles.user(t), START, END)


@query("Q40_b2b_daily", B2B_DAILY)
def _(t):
    return sales.b2b_daily(_lines(t), START, END)


@query("Q41_b2b_weekly", B2B_WEEKLY)
def _(t):
    return sales.b2b_weekly(_lines(t), START, END)


@query("Q42_b2b_by_account", BY_ACCOUNT)
def _(t):
    return _by_account(t)


@query("Q43_web_daily_gross", _web_sql(GROSS))
def _(t):
    return sales.web_daily(_web(t), START, END)


@query("Q43_web_daily_net", _web_sql(NET))
def _(t):
    return sales.web_daily(_web(t), START, END, net=True)


@query("Q43_web_weekly_gross", _web_sql(GROSS, weekly=True))
def _(t):
    return sales.web_weekly(_web(t), START, END)


@query("Q43_web_weekly_net", _web_sql(NET, weekly=True))
def _(t):
    return sales.web_weekly(_web(t), START, END, net=True)


def _web_products_sql(amount: str) -> str:
    return f"""SELECT title AS product_name, sku, CAST(sum(quantity) AS BIGINT) AS units_sold,
  CAST(sum({amount}) AS DOUBLE) AS revenue, count(DISTINCT id) AS order_count, round(avg(price), 2) AS avg_price
FROM web_line WHERE local_day {RANGE} AND title IS NOT NULL GROUP BY 1, 2 HAVING sum(quantity) > 0"""


@query("Q44_web_products_gross", _web_products_sql("quantity * price"))
def _(t):
    return sales.web_products(_documents(t), START, END)


@query("Q44_web_products_net", _web_products_sql("quantity * price - total_discount"))
def _(t):
    return sales.web_products(_documents(t), START, END, net=True)


@query(
    "Q44_top_web_products",
    f"SELECT * FROM ({_web_products_sql('quantity * price - total_discount')}) ORDER BY revenue DESC, product_name, sku LIMIT 8",
)
def _(t):
    return sales.top_products(sales.web_products(_documents(t), START, END, net=True))


@query("Q45_b2b_by_state", B2B_STATE)
def _(t):
    return sales.b2b_by_state(_lines(t), roles.account(t), START, END)


def _web_state_sql(column: str) -> str:
    return f"""SELECT upper(trim(province_code)) AS state, count(DISTINCT id) AS order_count,
  CAST(sum({column}) AS DOUBLE) AS revenue
FROM web_order WHERE local_day {RANGE} AND trim(province_code) <> '' AND country_code = 'US' GROUP BY 1"""


@query("Q45_top_web_states", f"SELECT * FROM ({_web_state_sql(NET)}) ORDER BY revenue DESC, state LIMIT 15")
def _(t):
    return sales.top_states(sales.web_by_state(_web(t), START, END, net=True))


@query("Q45_web_by_state", _web_state_sql(NET))
def _(t):
    return sales.web_by_state(_web(t), START, END, net=True)


@query(
    "Q46_owner_options",
    f"""SELECT DISTINCT u.name AS owner_name FROM b2b_norm LEFT JOIN account a ON account_id = a.id
  LEFT JOIN app_user u ON a.owner_id = u.id WHERE {LIVE} AND u.name IS NOT NULL""",
)
def _(t):
    return sales.owner_options(_lines(t, None), roles.account(t), roles.user(t))


@query(
    "Q46_account_type_options",
    f"SELECT DISTINCT account_type FROM b2b_norm WHERE {LIVE} AND account_type IS NOT NULL",
)
def _(t):
    return sales.account_type_options(_lines(t, None))


@query(
    "Q46_distributor_options",
    """SELECT DISTINCT distributor_code, distributor_name, sf_account_id, total_retailers
FROM distributor WHERE distributor_code IS NOT NULL AND NOT is_parent_rollup""",
)
def _(t):
    from shelfline.operators.inventory import distributor_list

    return distributor_list(roles.distributor(t))


@query(
    "Q47_revenue_bridge",
    f"""SELECT CAST(sum({GROSS}) AS DOUBLE) AS gross_sales, CAST(sum(total_discounts) AS DOUBLE) AS discounts,
  CAST(sum({GROSS}) - sum(total_discounts) - sum({NET}) AS DOUBLE) AS returns,
  CAST(sum({NET}) AS DOUBLE) AS net_sales, count(DISTINCT id) AS orders FROM web_order WHERE local_day {RANGE}""",
)
def _(t):
    return sales.revenue_bridge(_web(t), START, END)


BILLED = f"""SELECT strftime(txn_date, '%Y-%m') AS month, count(*) AS invoices,
  CAST(sum(total_amt) AS DOUBLE) AS billed_revenue FROM invoice WHERE txn_date {RANGE} GROUP BY 1"""


@query("Q48_billed_monthly", BILLED)
def _(t):
    return sales.billed_monthly(roles.invoice(t), START, END)


@query(
    "Q48_billed_weekly",
    f"""SELECT {MONDAY.format('txn_date')} AS week_start, count(*) AS invoices,
  CAST(sum(total_amt) AS DOUBLE) AS billed_revenue FROM invoice WHERE txn_date {RANGE} GROUP BY 1""",
)
def _(t):
    return sales.billed_weekly(roles.invoice(t), START, END)


@query("Q49_credits_daily", CREDITS_DAILY)
def _(t):
    return sales.credits_daily(roles.credit_memo(t), START, END)


@query("Q49_credits_weekly", CREDITS_WEEKLY)
def _(t):
    return sales.credits_weekly(roles.credit_memo(t), START, END)


@query("Q49_credits_total", f"SELECT CAST(sum(amount) AS DOUBLE) AS total_credits {CREDITS}")
def _(t):
    return sales.credits_total(roles.credit_memo(t), START, END)


@query("Q50_net_daily", NET_DAILY)
def _(t):
    return _net_daily(t)


@query("Q50_net_weekly", NET_WEEKLY)
def _(t):
    return _net_weekly(t)


@query(
    "Q50_lost_credits",
    f"""SELECT * FROM ({CREDITS_DAILY}) WHERE credit_date NOT IN (SELECT order_date FROM b2b_norm
  WHERE {LIVE} AND order_date {RANGE} AND account_type = 'Key Account' AND product_code LIKE 'I1%')""",
)
def _(t):
    # Key-account sales of one item range: there are days without any.
    lines = _lines(t).filter("account_type = 'Key Account' AND product_code LIKE 'I1%'")
    daily = sales.b2b_daily(lines, START, END)
    credits = sales.credits_daily(roles.credit_memo(t), START, END)
    return sales.lost_credits(daily, credits, "order_date", "credit_date")


def _b2b_sku_sql(day: str) -> str:
    return f"""SELECT {day} AS order_date, product_code AS sku, product_name, {MEASURES}
FROM b2b_norm WHERE {LIVE} AND order_date {RANGE} AND product_name IS NOT NULL GROUP BY 1, 2, 3"""


def _web_sku_sql(day: str, amount: str) -> str:
    return f"""SELECT {day} AS order_date, sku, title AS product_name, CAST(sum(quantity) AS BIGINT) AS units,
  CAST(sum({amount}) AS DOUBLE) AS revenue, count(DISTINCT id) AS order_count
FROM web_line WHERE local_day {RANGE} AND title IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(quantity) > 0"""


WEB_NET = "quantity * price - total_discount"
COMBINED = f"""SELECT order_date, sku, product_name, units, revenue, order_count, 'B2B' AS channel
FROM ({_b2b_sku_sql('order_date')}) UNION ALL
SELECT order_date, sku, product_name, units, revenue, order_count, 'B2C' AS channel
FROM ({_web_sku_sql('local_day', WEB_NET)})"""


@query("Q51_b2b_sku_daily", _b2b_sku_sql("order_date"))
def _(t):
    return sales.b2b_sku_sales(_lines(t), START, END)


@query("Q51_b2b_sku_weekly", _b2b_sku_sql(MONDAY.format("order_date")))
def _(t):
    return sales.b2b_sku_sales(_lines(t), START, END, weekly=True)


@query("Q51_web_sku_daily", _web_sku_sql("local_day", "quantity * price"))
def _(t):
    return sales.web_sku_sales(_documents(t), START, END)


@query("Q51_web_sku_weekly_net", _web_sku_sql(MONDAY.format("local_day"), WEB_NET))
def _(t):
    return sales.web_sku_sales(_documents(t), START, END, weekly=True, net=True)


def _combined(t):
    return sales.combined_sku_sales(
        sales.b2b_sku_sales(_lines(t), START, END),
        sales.web_sku_sales(_documents(t), START, END, net=True),
    )


@query("Q51_combined_sku_daily", COMBINED)
def _(t):
    return _combined(t)


def _has(*needles: str) -> str:
    return " OR ".join(f"contains(lower(product_name), '{n}')" for n in needles)


HIERARCHY = f"""CASE WHEN {_has('shot', '2oz', '2 oz')} THEN 'Shots' WHEN {_has('750ml', '750 ml', 'bottle')} THEN 'Bottles'
    WHEN {_has('12oz', '12 oz')} THEN '12oz Seltzers' WHEN {_has('16oz', '16 oz')} THEN '16oz Seltzers'
    WHEN {_has('seltzer')} THEN 'Seltzers' ELSE 'Other' END AS family,
  CASE WHEN {_has('25mg')} THEN '25mg' WHEN {_has('10mg')} THEN '10mg' WHEN {_has('5mg')} THEN '5mg'
    WHEN {_has('2mg')} THEN '2mg' ELSE 'Unknown' END AS potency,
  CASE WHEN {_has('berry')} THEN 'Berry' WHEN {_has('citrus')} THEN 'Citrus' WHEN {_has('tropical')} THEN 'Tropical'
    WHEN {_has('spicy lime', 'spicylime')} THEN 'Spicy Lime' WHEN {_has('lemonade')} THEN 'Lemonade'
    WHEN {_has('cherry')} THEN 'Cherry' WHEN {_has('cranberry', 'crnbry')} THEN 'Cranberry'
    WHEN {_has('variety')} THEN 'Variety Pack' WHEN {_has('original')} THEN 'Original' ELSE 'Unknown' END AS flavor"""

SKU_SALES = f"SELECT *, {HIERARCHY} FROM ({_b2b_sku_sql('order_date')})"


def _sku_sales(t):
    return prod.with_hierarchy(sales.b2b_sku_sales(_lines(t), START, END))


@query(
    "Q52_product_hierarchy",
    f"""SELECT supplier_item, "desc" AS product_name, {HIERARCHY} FROM (SELECT *, "desc" AS product_name FROM item)""",
)
def _(t):
    named = roles.item(t).selectExpr("supplier_item", "`desc` AS product_name")
    return prod.with_hierarchy(named)


SPECIFIC = f"""CASE WHEN {_has('12oz', '12 oz')} THEN '12oz Seltzers' WHEN {_has('16oz', '16 oz')} THEN '16oz Seltzers'
    WHEN {_has('shot', '2oz', '2 oz')} THEN 'Shots' WHEN {_has('750ml', '750 ml', 'bottle')} THEN 'Bottles'
    WHEN {_has('seltzer')} THEN 'Seltzers' ELSE 'Other' END AS family,
  CASE WHEN {_has('25mg')} THEN '25mg' WHEN {_has('10mg')} THEN '10mg' WHEN {_has('5mg')} THEN '5mg'
    WHEN {_has('2mg')} THEN '2mg' ELSE 'Unknown' END AS potency,
  CASE WHEN {_has('cranberry', 'crnbry')} THEN 'Cranberry' WHEN {_has('berry')} THEN 'Berry' WHEN {_has('citrus')} THEN 'Citrus'
    WHEN {_has('tropical')} THEN 'Tropical' WHEN {_has('spicy lime', 'spicylime')} THEN 'Spicy Lime'
    WHEN {_has('lemonade')} THEN 'Lemonade' WHEN {_has('cherry')} THEN 'Cherry' WHEN {_has('variety')} THEN 'Variety Pack'
    WHEN {_has('original')} THEN 'Original' ELSE 'Unknown' END AS flavor"""


@query(
    "Q52_specific_first_hierarchy",
    f"""SELECT supplier_item, "desc" AS product_name, {SPECIFIC} FROM (SELECT *, "desc" AS product_name FROM item)""",
)
def _(t):
    named = roles.item(t).selectExpr("supplier_item", "`desc` AS product_name")
    return prod.with_hierarchy(
        named, family_rules=prod.SPECIFIC_FIRST_FAMILY_RULES, flavor_rules=prod.SPECIFIC_FIRST_FLAVOR_RULES
    )


COMBINE_DAILY = """SELECT coalesce(b.order_date, w.order_date) AS order_date,
  coalesce(b.day_of_week, w.day_of_week) AS day_of_week, coalesce(b.revenue, 0) AS revenue_b2b,
  coalesce(w.revenue, 0) AS revenue_b2c, round(coalesce(b.revenue, 0) + coalesce(w.revenue, 0), 2) AS revenue
FROM ({b}) b FULL JOIN ({w}) w ON b.order_date = w.order_date AND b.day_of_week = w.day_of_week"""
NET_COMBINED = COMBINE_DAILY.format(b=NET_DAILY, w=_web_sql(NET))

SEASONAL = f"""WITH d AS ({NET_COMBINED}),
ranked AS (SELECT *, row_number() OVER (ORDER BY order_date DESC) AS down,
  avg(revenue) OVER (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma FROM d),
base AS (SELECT count(*) AS n, avg(revenue) AS overall, max(order_date) AS last_date,
  max(ma) FILTER (WHERE down = 1) AS last_ma,
  regr_slope(revenue, CAST(15 - down AS DOUBLE)) FILTER (WHERE down <= 14) AS slope FROM ranked),
dow AS (SELECT day_of_week, avg(revenue) AS dow_mean FROM d GROUP BY 1),
ahead AS (SELECT CAST(last_date + i AS DATE) AS order_date, i, overall, last_ma, slope,
  CAST(dayofweek(last_date + i) + 1 AS INTEGER) AS dw
  FROM base, (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS i) WHERE n >= 14)
SELECT order_date, greatest(0, (last_ma + slope * i * 0.3)
  * CASE WHEN overall > 0 AND dow_mean IS NOT NULL THEN dow_mean / overall ELSE 1 END) AS forecast_revenue
FROM ahead LEFT JOIN dow ON dw = day_of_week"""


def _net_combined(t):
    return sales.combine_daily(_net_daily(t), sales.web_daily(_web(t), START, END, net=True))


@query("Q53_seasonal_forecast", SEASONAL, rounded=["forecast_revenue"], digits=3)
def _(t):
    return fc.seasonal_forecast(_net_combined(t), 30)


@query(
    "Q54_forecast_summary",
    f"""SELECT s AS forecast_total, s / 30 AS daily_average, s / 30 * 30 AS monthly_run_rate
FROM (SELECT sum(forecast_revenue) AS s FROM ({SEASONAL}))""",
    rounded=["forecast_total", "daily_average", "monthly_run_rate"],
    digits=2,
)
def _(t):
    return fc.forecast_summary(fc.seasonal_forecast(_net_combined(t), 30), 30)


@query(
    "Q54_combined_daily",
    f"""SELECT *, avg(revenue) OVER (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma_7
FROM ({NET_COMBINED})""",
    rounded=["ma_7"],
    digits=3,
)
def _(t):
    return sales.smoothed_daily(_net_combined(t))


@query(
    "Q54_combined_weekly",
    f"""SELECT coalesce(b.week_start, w.week_start) AS week_start, coalesce(b.revenue, 0) AS b2b,
  coalesce(w.revenue, 0) AS b2c FROM ({NET_WEEKLY}) b FULL JOIN ({_web_sql(NET, weekly=True)}) w
  ON b.week_start = w.week_start""",
)
def _(t):
    return sales.combine_weekly(_net_weekly(t), sales.web_weekly(_web(t), START, END, net=True))


@query(
    "Q54_channel_mix",
    f"""SELECT channel, revenue, orders, 100 * revenue / sum(revenue) OVER () AS share_pct,
  revenue / orders AS avg_order_value, revenue / 366 AS daily_average
FROM (SELECT 'B2B' AS channel, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
    CAST(sum(order_count) AS BIGINT) AS orders FROM ({NET_DAILY})
  UNION ALL SELECT 'B2C', CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE), CAST(sum(order_count) AS BIGINT)
  FROM ({_web_sql(NET)}))""",
    rounded=["share_pct", "avg_order_value", "daily_average"],
    digits=4,
)
def _(t):
    web = sales.web_daily(_web(t), START, END, net=True)
    return sales.channel_mix(_net_daily(t), web, START, END)


@query(
    "Q55_same_day_month_over_month",
    f"""SELECT cur AS current_month, prev AS last_month, (cur - prev) / prev * 100 AS mom_pct FROM (
  SELECT CAST(sum(line_revenue) FILTER (WHERE order_date BETWEEN DATE '2001-07-01' AND DATE '2001-07-31') AS DOUBLE) AS cur,
    CAST(sum(line_revenue) FILTER (WHERE order_date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30') AS DOUBLE) AS prev
  FROM b2b_norm WHERE {LIVE})""",
    rounded=["mom_pct"],
)
def _(t):
    daily = sales.b2b_daily(_lines(t, MOM_START), MOM_START, MOM_DAY)
    return sales.same_day_month_over_month(daily, MOM_DAY)


BOOKED = f"""SELECT strftime(order_date, '%Y-%m') AS month, count(DISTINCT order_id) AS orders,
  CAST(sum(line_revenue) AS DOUBLE) AS booked_revenue FROM b2b_norm WHERE {LIVE} AND order_date {RANGE} GROUP BY 1"""
RECON = f"""SELECT *, round(billed_revenue - booked_revenue, 2) AS gap,
  coalesce(CAST(100 AS DOUBLE) * round(billed_revenue - booked_revenue, 2) / nullif(booked_revenue, 0), 0) AS gap_pct
FROM (SELECT coalesce(a.month, b.month) AS month, coalesce(orders, 0) AS orders,
  coalesce(booked_revenue, 0) AS booked_revenue, coalesce(invoices, 0) AS invoices,
  coalesce(billed_revenue, 0) AS billed_revenue FROM ({BOOKED}) a FULL JOIN ({BILLED}) b ON a.month = b.month)"""


def _recon(t):
    booked = sales.booked_monthly(_lines(t), START, END)
    return sales.booked_vs_billed(booked, sales.billed_monthly(roles.invoice(t), START, END))


@query("Q56_booked_vs_billed", RECON, rounded=["gap_pct"])
def _(t):
    return _recon(t)


@query(
    "Q56_booked_vs_billed_long",
    f"""SELECT month, 'Booked' AS source, booked_revenue AS revenue FROM ({RECON})
UNION ALL SELECT month, 'Billed', billed_revenue FROM ({RECON})""",
)
def _(t):
    return sales.booked_vs_billed_long(_recon(t))


@query(
    "Q56_reconciliation_totals",
    f"""SELECT *, round(billed_revenue - booked_revenue, 2) AS gap,
  CAST(100 AS DOUBLE) * round(billed_revenue - booked_revenue, 2) / nullif(booked_revenue, 0) AS gap_pct
FROM (SELECT CAST(sum(CAST(booked_revenue AS DECIMAL(18,2))) AS DOUBLE) AS booked_revenue,
  CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(CAST(billed_revenue AS DECIMAL(18,2))) AS DOUBLE) AS billed_revenue,
  CAST(sum(invoices) AS BIGINT) AS invoices FROM ({RECON}))""",
    rounded=["gap_pct"],
)
def _(t):
    return sales.reconciliation_totals(_recon(t))


@query(
    "Q57_account_totals",
    f"""SELECT CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  CAST(sum(order_count) AS BIGINT) AS orders, count(*) AS accounts,
  CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) / sum(order_count) AS avg_order_value
FROM ({BY_ACCOUNT}) WHERE owner_name IN ('NATION_1', 'NATION_2', 'NATION_3')
  AND account_type IN ('Distributor', 'Retailer')""",
    rounded=["avg_order_value"],
)
def _(t):
    chosen = sales.filter_accounts(
        _by_account(t), ["NATION_1", "NATION_2", "NATION_3"], ["Distributor", "Retailer"]
    )
    return sales.account_totals(chosen)


@query(
    "Q57_top_accounts",
    f"""SELECT customer_name, account_type, owner_name, revenue, order_count FROM ({BY_ACCOUNT})
ORDER BY revenue DESC, account_id LIMIT 10""",
)
def _(t):
    return sales.top_accounts(_by_account(t))


@query(
    "Q57_revenue_by_type",
    f"""SELECT account_type, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM ({BY_ACCOUNT}) WHERE account_type IS NOT NULL GROUP BY 1""",
)
def _(t):
    return sales.revenue_by_type(_by_account(t))


@query("Q57_top_states", f"SELECT * FROM ({B2B_STATE}) ORDER BY revenue DESC, state LIMIT 15")
def _(t):
    return sales.top_states(sales.b2b_by_state(_lines(t), roles.account(t), START, END))


CENTS = "CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE)"


@query(
    "Q58_hierarchy_rollup",
    f"""SELECT family, potency, flavor, product_name, {CENTS} AS revenue, CAST(sum(units) AS BIGINT) AS units,
  count(DISTINCT sku) AS skus, CAST(4 - bit_count(grouping_id(family, potency, flavor, product_name)) AS INTEGER) AS level
FROM ({SKU_SALES}) GROUP BY ROLLUP (family, potency, flavor, product_name)""",
)
def _(t):
    return prod.hierarchy_rollup(_sku_sales(t))


@query(
    "Q58_sku_totals",
    f"""SELECT {CENTS} AS revenue, CAST(sum(units) AS BIGINT) AS units, count(DISTINCT sku) AS skus,
  count(DISTINCT family) AS families FROM (SELECT *, {HIERARCHY} FROM ({COMBINED}))""",
)
def _(t):
    return prod.sku_totals(prod.with_hierarchy(_combined(t)))


SHOTS = f"SELECT * FROM ({SKU_SALES}) WHERE family = 'Shots' AND potency = '5mg'"


@query(
    "Q58_top_series",
    f"""SELECT order_date, product_name, {CENTS} AS revenue FROM ({SKU_SALES})
WHERE product_name IN (SELECT product_name FROM ({SKU_SALES}) GROUP BY 1 ORDER BY {CENTS} DESC, 1 LIMIT 8) GROUP BY 1, 2""",
)
def _(t):
    return prod.top_group_series(_sku_sales(t), "product_name")


@query(
    "Q58_top_unit_series",
    f"""SELECT order_date, flavor, CAST(sum(units) AS BIGINT) AS units FROM ({SHOTS})
WHERE flavor IN (SELECT flavor FROM ({SHOTS}) GROUP BY 1 ORDER BY sum(units) DESC, 1 LIMIT 8) GROUP BY 1, 2""",
)
def _(t):
    chosen = prod.drill(_sku_sales(t), "Shots", "5mg")
    return prod.top_group_series(chosen, prod.drill_level("Shots", "5mg", None), "units")


@query(
    "Q58_largest_groups",
    f"""SELECT product_name, {CENTS} AS revenue, CAST(sum(units) AS BIGINT) AS units FROM ({SKU_SALES})
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(t):
    return prod.largest_groups(_sku_sales(t), "product_name")


@query(
    "Q59_day_of_week_average",
    f"""SELECT day_of_week, avg(revenue) AS revenue, CASE day_of_week WHEN 1 THEN 'Sun' WHEN 2 THEN 'Mon' WHEN 3 THEN 'Tue'
  WHEN 4 THEN 'Wed' WHEN 5 THEN 'Thu' WHEN 6 THEN 'Fri' ELSE 'Sat' END AS day_name
FROM ({_web_sql(NET)}) GROUP BY day_of_week""",
    rounded=["revenue"],
    digits=4,
)
def _(t):
    return sales.day_of_week_average(sales.web_daily(_web(t), START, END, net=True))


@query(
    "Q60_sku_comparison",
    f"""SELECT *, revenue / days_with_sales AS avg_daily_rev, units / CAST(days_with_sales AS DOUBLE) AS avg_daily_units
FROM (SELECT product_name, family, potency, flavor, {CENTS} AS revenue, CAST(sum(units) AS BIGINT) AS units,
  count(DISTINCT order_date) AS days_with_sales FROM ({SKU_SALES})
WHERE product_name IN (SELECT product_name FROM ({SKU_SALES}) GROUP BY 1 ORDER BY {CENTS} DESC, 1 LIMIT 3)
GROUP BY 1, 2, 3, 4)""",
    rounded=["avg_daily_rev", "avg_daily_units"],
    digits=4,
)
def _(t):
    return prod.sku_comparison(_sku_sales(t))


@query(
    "Q60_ranked_skus",
    f"""SELECT *, CAST(row_number() OVER (ORDER BY revenue DESC, sku, product_name) AS INTEGER) AS rank
FROM (SELECT sku, product_name, family, potency, flavor, {CENTS} AS revenue, CAST(sum(units) AS BIGINT) AS units,
  CAST(sum(order_count) AS BIGINT) AS order_count FROM ({SKU_SALES}) GROUP BY 1, 2, 3, 4, 5
ORDER BY revenue DESC, sku, product_name LIMIT 50)""",
)
def _(t):
    return prod.ranked_skus(_sku_sales(t))
