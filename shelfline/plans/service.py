"""Fulfilment and support queries Q27-Q39."""

from __future__ import annotations

from datetime import date

from shelfline.operators import fulfilment as ful
from shelfline.operators import support as sup
from shelfline.plans.registry import query
from shelfline.sources import roles

# A day in mid-month, so that every window has rows.
TODAY = date(2024, 1, 20)

STATS = """SELECT count(DISTINCT order_id) FILTER (WHERE now) AS orders_this_month,
  CAST(sum(CAST(order_total AS DECIMAL(18,2))) FILTER (WHERE now) AS DOUBLE) AS revenue_this_month,
  CAST(sum(CAST(shipment_cost AS DECIMAL(18,2))) FILTER (WHERE now) AS DOUBLE) AS shipping_this_month,
  count(*) FILTER (WHERE now AND fulfillment_status = 'shipped') AS shipped_this_month,
  count(*) FILTER (WHERE now AND fulfillment_status = 'pending') AS pending_this_month,
  round(100.0 * count(*) FILTER (WHERE now AND fulfillment_status = 'shipped') / nullif(count(*) FILTER (WHERE now), 0), 1) AS fulfillment_rate,
  round(avg(days_to_ship) FILTER (WHERE now AND fulfillment_status = 'shipped'), 1) AS avg_days_to_ship,
  count(DISTINCT order_id) FILTER (WHERE NOT now) AS orders_last_month,
  CAST(sum(CAST(order_total AS DECIMAL(18,2))) FILTER (WHERE NOT now) AS DOUBLE) AS revenue_last_month,
  CAST(sum(CAST(shipment_cost AS DECIMAL(18,2))) FILTER (WHERE NOT now) AS DOUBLE) AS shipping_last_month,
  count(DISTINCT order_id) FILTER (WHERE order_date = DATE '2024-01-20') AS orders_today,
  count(*) FILTER (WHERE order_date = DATE '2024-01-20' AND fulfillment_status = 'shipped') AS shipped_today
FROM (SELECT *, order_date >= DATE '2024-01-01' AS now FROM shipment WHERE order_date >= DATE '2023-12-01')"""


def _stats(t):
    return ful.month_to_date_stats(roles.shipment(t), TODAY)


@query("Q27_month_to_date_stats", STATS)
def _(t):
    return _stats(t)


DAILY_FULFILMENT = """SELECT order_date, count(DISTINCT order_id) AS orders_placed,
  count(*) FILTER (WHERE fulfillment_status = 'shipped') AS orders_shipped,
  CAST(round(CAST(100.0 * count(*) FILTER (WHERE fulfillment_status = 'shipped') / count(*) AS DECIMAL(38,4)), 1) AS DOUBLE) AS fulfillment_rate
FROM shipment GROUP BY 1"""


@query(
    "Q28_daily_fulfilment",
    f"""SELECT *, CASE WHEN count(*) OVER w >= 7 THEN avg(orders_placed) OVER w END AS ma7
FROM (SELECT * FROM ({DAILY_FULFILMENT}) ORDER BY order_date DESC LIMIT 90)
WINDOW w AS (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    rounded=["ma7"],
)
def _(t):
    return ful.recent_days(ful.daily_fulfilment(roles.shipment(t)))


CARRIERS = """SELECT CAST(date_trunc('month', order_date) AS DATE) AS order_month,
  coalesce(shipment_carrier, order_carrier) AS carrier_code, count(DISTINCT order_id) AS order_count,
  CAST(round(CAST(avg(shipment_cost) AS DECIMAL(38,7)), 4) AS DOUBLE) AS avg_shipping_cost FROM shipment GROUP BY 1, 2"""


@query("Q29_carrier_months", f"SELECT * FROM ({CARRIERS}) WHERE order_month >= DATE '2023-10-01'")
def _(t):
    return ful.recent_carrier_months(ful.carrier_months(roles.shipment(t)), TODAY)


@query(
    "Q29_current_carrier_mix",
    f"""SELECT *, CASE carrier_code WHEN 'ups_walleted' THEN 'UPS' WHEN 'ups' THEN 'UPS Direct' WHEN 'stamps_com' THEN 'Stamps.com'
  WHEN 'fedex' THEN 'FedEx' WHEN 'globalpost' THEN 'GlobalPost' WHEN 'dhl_express' THEN 'Dhl Express' END AS carrier_display
FROM ({CARRIERS}) WHERE order_month = (SELECT max(order_month) FROM ({CARRIERS})) AND carrier_code IS NOT NULL""",
)
def _(t):
    return ful.current_carrier_mix(ful.carrier_months(roles.shipment(t)))


@query(
    "Q30_state_distribution",
    """SELECT ship_country, ship_state, count(DISTINCT order_id) AS order_count FROM shipment
WHERE ship_country = 'US' GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 20""",
)
def _(t):
    return ful.top_ship_states(ful.state_distribution(roles.shipment(t)))


@query(
    "Q31_recent_orders",
    """SELECT order_number, order_date, fulfillment_status, order_total,
  coalesce(shipment_carrier, order_carrier, 'N/A') AS carrier, ship_state, tracking_number
FROM shipment WHERE order_date >= DATE '2024-01-13' ORDER BY order_date DESC, order_id DESC, tracking_number DESC LIMIT 25""",
)
def _(t):
    return ful.recent_orders(roles.shipment(t), TODAY)


@query(
    "Q32_status_breakdown",
    f"""WITH s AS ({STATS}) SELECT * FROM (SELECT 'Shipped' AS status, shipped_this_month AS count FROM s
  UNION ALL SELECT 'Pending', pending_this_month FROM s
  UNION ALL SELECT 'Cancelled', orders_this_month - shipped_this_month - pending_this_month FROM s) WHERE count > 0""",
)
def _(t):
    return ful.status_breakdown(_stats(t))


@query(
    "Q32_order_delta",
    f"""SELECT orders_this_month - orders_last_month AS order_delta,
  round(100.0 * (orders_this_month - orders_last_month) / greatest(orders_last_month, 1), 1) AS order_delta_pct FROM ({STATS})""",
)
def _(t):
    return ful.order_delta(_stats(t))


GOOD = "count(*) FILTER (WHERE csat_score = 'good')"
RATED = "count(*) FILTER (WHERE csat_score IN ('good', 'bad'))"
CSAT = f"{GOOD} / nullif({RATED}, 0)"


@query(
    "Q33_ticket_stats",
    f"""SELECT count(*) AS total_tickets, count(*) FILTER (WHERE status IN ('open', 'pending', 'new')) AS backlog,
  round(avg(resolution_minutes_business) / 60, 1) AS avg_resolution_hours,
  round(100.0 * count(*) FILTER (WHERE resolved_same_day) / nullif(count(*) FILTER (WHERE is_resolved), 0), 1) AS same_day_pct,
  round(100.0 * {GOOD} / nullif({RATED}, 0), 1) AS csat_rate,
  count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2024-01-20') AS today_tickets,
  count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2024-01-19') AS yesterday_tickets,
  round(100.0 * count(*) FILTER (WHERE first_response_under_1hr) / count(*), 1) AS fast_response_pct FROM ticket""",
)
def _(t):
    return sup.ticket_stats(roles.ticket(t), TODAY)


DAILY = f"SELECT created_date, count(*) AS ticket_count, {CSAT} AS csat_rate FROM ticket GROUP BY 1"


@query(
    "Q34_daily_metrics",
    f"""SELECT *, CASE WHEN count(*) OVER w >= 7 THEN avg(ticket_count) OVER w END AS ma7, csat_rate * 100 AS csat_rate_pct
FROM (SELECT * FROM ({DAILY}) ORDER BY created_date DESC LIMIT 90)
WINDOW w AS (ORDER BY created_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    rounded=["ma7", "csat_rate", "csat_rate_pct"],
)
def _(t):
    return sup.recent_daily_metrics(sup.daily_metrics(roles.ticket(t)))


AGENTS = f"""SELECT CAST(date_trunc('month', created_date) AS DATE) AS created_month, agent_name,
  count(*) AS tickets_handled, {CSAT} AS csat_rate FROM ticket GROUP BY 1, 2"""
LATEST = f"SELECT * FROM ({AGENTS}) WHERE created_month = (SELECT max(created_month) FROM ({AGENTS}))"


@query(
    "Q35_agent_months",
    f"SELECT * FROM ({AGENTS}) WHERE created_month >= DATE '2023-10-01'",
    rounded=["csat_rate"],
)
def _(t):
    return sup.recent_months(sup.agent_months(roles.ticket(t)), TODAY)


@query(
    "Q35_busiest_agents",
    f"SELECT * FROM ({LATEST}) ORDER BY tickets_handled DESC, agent_name LIMIT 10",
    rounded=["csat_rate"],
)
def _(t):
    return sup.busiest_agents(sup.agent_months(roles.ticket(t)))


@query(
    "Q35_best_rated_agents",
    f"""SELECT * FROM ({LATEST}) WHERE tickets_handled >= 10 AND csat_rate IS NOT NULL
ORDER BY csat_rate DESC, agent_name LIMIT 5""",
    rounded=["csat_rate"],
)
def _(t):
    return sup.best_rated_agents(sup.agent_months(roles.ticket(t)))


TAGS = f"""SELECT CAST(date_trunc('month', created_date) AS DATE) AS created_month, tag, count(*) AS ticket_count,
  avg(resolution_minutes_business) AS avg_resolution_minutes, {CSAT} AS csat_rate FROM ticket GROUP BY 1, 2"""


@query(
    "Q36_tag_analysis",
    f"""SELECT tag, CAST(sum(ticket_count) AS BIGINT) AS total_tickets, avg(avg_resolution_minutes) AS avg_resolution,
  avg(csat_rate) AS avg_csat FROM ({TAGS}) WHERE created_month >= DATE '2023-11-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
    rounded=["avg_resolution", "avg_csat"],
)
def _(t):
    return sup.tag_analysis(sup.tag_months(roles.ticket(t)), TODAY)


MONTHLY = f"""SELECT strftime(created_date, '%Y-%m') AS month, CAST(sum(ticket_count) AS BIGINT) AS total_tickets
FROM ({DAILY}) WHERE created_date >= DATE '2023-01-20' GROUP BY 1"""


def _tag_sum(*names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"CAST(coalesce(sum(ticket_count) FILTER (WHERE tag IN ({listed})), 0) AS BIGINT)"


@query(
    "Q37_tag_series",
    f"""SELECT month, total_tickets, coalesce(cs_reships, 0) AS cs_reships, coalesce(protectly, 0) AS protectly,
  coalesce(address_changes, 0) AS address_changes, coalesce(order_status, 0) AS order_status
FROM ({MONTHLY}) LEFT JOIN (SELECT strftime(created_month, '%Y-%m') AS m, {_tag_sum('reship', 'reshipment')} AS cs_reships,
  {_tag_sum('protectly')} AS protectly, {_tag_sum('address_change', 'wrongaddress')} AS address_changes,
  {_tag_sum('order_status')} AS order_status FROM ({TAGS}) WHERE created_month >= DATE '2023-01-20' GROUP BY 1) ON month = m""",
)
def _(t):
    tickets = roles.ticket(t)
    return sup.tag_series(sup.tag_months(tickets), sup.daily_metrics(tickets), TODAY)


@query("Q38_monthly_tickets", MONTHLY)
def _(t):
    return sup.monthly_tickets(sup.daily_metrics(roles.ticket(t)), TODAY)


@query(
    "Q39_hour_heat_map",
    "SELECT created_day_of_week, "
    + ", ".join(f"nullif(count(*) FILTER (WHERE created_hour = {h}), 0) AS h{h:02d}" for h in range(24))
    + " FROM ticket WHERE created_date >= DATE '2023-12-21' GROUP BY 1",
)
def _(t):
    return sup.hour_heat_map(roles.ticket(t), TODAY)
