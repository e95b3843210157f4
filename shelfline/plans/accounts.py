"""Key-account queries Q62 and Q67-Q82."""

from __future__ import annotations

from shelfline.functions.dates import month_column, trailing_months
from shelfline.operators import accounts as acc
from shelfline.plans.inputs import AS_OF, items, latest_sale, sold_lines
from shelfline.plans.registry import query
from shelfline.sources import roles

MONTHS = [month_column(m) for m in trailing_months(AS_OF)]
MONTH_DATES = [m.isoformat() for m in trailing_months(AS_OF)]

WINDOWS = {
    "l30": "sale_date > DATE '2001-08-01' - 30",
    "p30": "sale_date > DATE '2001-08-01' - 60 AND sale_date <= DATE '2001-08-01' - 30",
    "l90": "sale_date > DATE '2001-08-01' - 90",
    "p90": "sale_date > DATE '2001-08-01' - 180 AND sale_date <= DATE '2001-08-01' - 90",
    "ytd": "sale_date >= DATE '2001-01-01'",
}


def _qty(window: str) -> str:
    return f"CAST(coalesce(sum(units) FILTER (WHERE {WINDOWS[window]}), 0) AS BIGINT)"


def _pods(window: str) -> str:
    return f"count(DISTINCT item_code) FILTER (WHERE {WINDOWS[window]})"


SHEET_CTES = f"""facts AS (SELECT acct_code, min(sale_date) AS first_order_date, max(sale_date) AS most_recent_order_date,
  CAST(sum(units) AS BIGINT) AS qty_lifetime, {_qty('ytd')} AS qty_ytd, {_qty('l30')} AS qty_last_30_days,
  {_qty('p30')} AS qty_previous_30_days, {_qty('l90')} AS qty_last_90_days, {_qty('p90')} AS qty_previous_90_days,
  count(DISTINCT item_code) AS pod_lifetime, {_pods('ytd')} AS pod_ytd, {_pods('l30')} AS pod_last_30,
  {_pods('p30')} AS pod_previous_30
  FROM sold WHERE sale_date <= DATE '2001-08-01' GROUP BY acct_code),
main_dist AS (SELECT acct_code AS main_acct, distributor_name AS primary_distributor_name FROM (
  SELECT acct_code, dist_code, row_number() OVER (PARTITION BY acct_code ORDER BY sum(units) DESC, dist_code DESC) AS rn
  FROM sold WHERE sale_date <= DATE '2001-08-01' GROUP BY acct_code, dist_code)
  LEFT JOIN distributor ON dist_code = distributor_code WHERE rn = 1),
sheet AS (SELECT *, qty_last_30_days - qty_previous_30_days AS qty_delta_30d,
  CASE WHEN qty_previous_30_days > 0 THEN (qty_last_30_days - qty_previous_30_days) / qty_previous_30_days * CAST(100 AS DOUBLE) END AS qty_pct_change_30d,
  pod_last_30 - pod_previous_30 AS pod_delta,
  CASE WHEN days_since_last_order <= 90 THEN 'Active' WHEN days_since_last_order <= 180 THEN 'At Risk' ELSE 'Churned' END AS customer_status,
  CASE WHEN first_order_date > DATE '2001-08-01' - 30 THEN 'New'
    WHEN qty_previous_30_days = 0 AND qty_last_30_days > 0 THEN 'New Activity'
    WHEN qty_last_30_days > qty_previous_30_days THEN 'Growing'
    WHEN qty_last_30_days < qty_previous_30_days THEN 'Declining' ELSE 'Stable' END AS trend_30d
FROM (SELECT d.*, first_order_date, most_recent_order_date, primary_distributor_name,
  CAST(DATE '2001-08-01' - most_recent_order_date AS INTEGER) AS days_since_last_order,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('qty_lifetime', 'qty_ytd', 'qty_last_30_days', 'qty_previous_30_days', 'qty_last_90_days', 'qty_previous_90_days', 'pod_lifetime', 'pod_ytd', 'pod_last_30', 'pod_previous_30'))}
  FROM door d LEFT JOIN facts ON vip_id = acct_code LEFT JOIN main_dist ON vip_id = main_acct))"""
CHAINS_CTES = f"{SHEET_CTES}, chain_door AS (SELECT * FROM sheet WHERE chain_code IS NOT NULL AND chain_code <> '')"

WIDE_CTE = f"""wide AS (SELECT chain_code, chain_name, vip_id, store_name, city AS store_city, state AS store_state,
  distributor_name, item_code, coalesce(item_desc, item_code) AS item_name, {', '.join(
    f"CAST(coalesce(sum(units) FILTER (WHERE date_trunc('month', sale_date) = DATE '{d}'), 0) AS BIGINT) AS {m}"
    for m, d in zip(MONTHS, MONTH_DATES))},
  CAST(coalesce(sum(units) FILTER (WHERE sale_date >= DATE '2000-09-01'), 0) AS BIGINT) AS ttm_current,
  CAST(coalesce(sum(units) FILTER (WHERE sale_date >= DATE '1999-09-01' AND sale_date < DATE '2000-09-01'), 0) AS BIGINT) AS ttm_prior,
  CAST(sum(units) AS BIGINT) AS total_units_all_time
FROM sold JOIN door ON acct_code = vip_id LEFT JOIN distributor ON dist_code = distributor_code
WHERE sale_date <= DATE '2001-08-01' AND chain_code IS NOT NULL
GROUP BY chain_code, chain_name, vip_id, store_name, city, state, dist_code, distributor_name, item_code, item_desc)"""

UNIVERSE = """SELECT
  CAST(coalesce(sum(l90), 0) AS DOUBLE) AS l90d_volume, CAST(coalesce(sum(p90), 0) AS DOUBLE) AS prior_90d_volume,
  CAST(coalesce(sum(ytd), 0) AS DOUBLE) AS ytd_volume, CAST(coalesce(sum(py), 0) AS DOUBLE) AS py_ytd_volume,
  count(*) FILTER (WHERE l90 > 0) AS l90d_active_doors, count(*) FILTER (WHERE p90 > 0) AS prior_90d_active_doors,
  count(*) FILTER (WHERE ytd > 0) AS ytd_active_doors, count(*) FILTER (WHERE py > 0) AS py_ytd_active_doors
FROM (SELECT acct_code, sum(units) FILTER (WHERE sale_date > anchor - 90) AS l90,
    sum(units) FILTER (WHERE sale_date > anchor - 180 AND sale_date <= anchor - 90) AS p90,
    sum(units) FILTER (WHERE sale_date >= date_trunc('year', anchor)) AS ytd,
    sum(units) FILTER (WHERE sale_date >= date_trunc('year', anchor) - INTERVAL 1 YEAR AND sale_date <= anchor - INTERVAL 1 YEAR) AS py
  FROM sold, (SELECT max(sale_date) AS anchor FROM sold) GROUP BY acct_code)"""


def _facts(t):
    return acc.door_facts(sold_lines(t), items(t), AS_OF)


def _sheet(t, with_primary=False):
    if with_primary:
        facts = acc.door_facts_with_primary(sold_lines(t), items(t), roles.distributor(t), AS_OF)
    else:
        facts = _facts(t)
    return acc.door_fact_sheet(roles.door(t), facts, AS_OF)


def _chain_doors(t):
    return acc.chain_doors(_sheet(t))


def _skus(t):
    return acc.chain_sku_wide(sold_lines(t), items(t), roles.door(t), roles.distributor(t), AS_OF)


def _sku_cells(t):
    """``_skus`` for reports without distributors."""
    return acc.chain_sku_wide(sold_lines(t), items(t), roles.door(t), roles.distributor(t), AS_OF, named=False)


def _universe(t):
    end = latest_sale(t) or AS_OF
    return acc.universe_totals(sold_lines(t, acc.universe_since(end)), items(t), end)


@query(
    "Q62_active_doors",
    f"WITH {SHEET_CTES} SELECT count(DISTINCT vip_id) AS active_doors FROM sheet WHERE days_since_last_order <= 90",
)
def _(t):
    return acc.active_doors(_sheet(t))


@query("Q67_door_fact_sheet", f"WITH {SHEET_CTES} SELECT * FROM sheet", rounded=["qty_pct_change_30d"])
def _(t):
    return _sheet(t, with_primary=True)


@query("Q68_universe_totals", UNIVERSE)
def _(t):
    return _universe(t)


@query("Q69_chain_sku_wide", f"WITH {WIDE_CTE} SELECT * FROM wide")
def _(t):
    return _skus(t)


OWNER = """SELECT chain_code, sf_owner_name AS kam FROM (SELECT chain_code, sf_owner_name,
  row_number() OVER (PARTITION BY chain_code ORDER BY count(*) DESC, sf_owner_name) AS rn
  FROM door WHERE sf_owner_name IS NOT NULL AND chain_code IS NOT NULL GROUP BY 1, 2) WHERE rn = 1"""


@query("Q70_chain_owner", OWNER)
def _(t):
    return acc.chain_owner(roles.door(t))


def _kpi_sql(chain: str | None) -> str:
    where = f"WHERE chain_name = '{chain}'" if chain else ""
    pick = lambda u, own: own if chain else f"coalesce(nullif((SELECT {u} FROM universe), 0), {own})"
    recent, before = " + ".join(MONTHS[9:12]), " + ".join(MONTHS[6:9])
    return f"""WITH {SHEET_CTES}, {WIDE_CTE}, universe AS ({UNIVERSE}),
d AS (SELECT * FROM sheet {where}), s AS (SELECT * FROM wide {where}),
k AS (SELECT CAST(sum(qty_last_90_days) AS DOUBLE) AS depl, CAST(sum(qty_previous_90_days) AS DOUBLE) AS depl_p,
  CAST(count(*) FILTER (WHERE qty_last_90_days > 0) AS DOUBLE) AS act,
  CAST(count(*) FILTER (WHERE qty_previous_90_days > 0) AS DOUBLE) AS act_p,
  count(*) FILTER (WHERE qty_last_90_days > 0 AND channel_type = 'Off-Premise') AS off,
  count(*) FILTER (WHERE qty_previous_90_days > 0 AND channel_type = 'Off-Premise') AS off_p,
  count(*) FILTER (WHERE qty_last_30_days > 0 AND qty_previous_30_days > 0) AS again,
  count(*) FILTER (WHERE qty_previous_30_days > 0 AND qty_previous_90_days - qty_previous_30_days > 0) AS again_p FROM d),
u AS (SELECT k.*, {pick('l90d_volume', 'depl')} AS v, {pick('prior_90d_volume', 'depl_p')} AS v_p,
  CAST({pick('l90d_active_doors', 'act')} AS DOUBLE) AS a, CAST({pick('prior_90d_active_doors', 'act_p')} AS DOUBLE) AS a_p FROM k)
SELECT CAST(1 AS INTEGER) AS position, 'Depletions' AS kpi, 'Case equivs (L90D)' AS unit, v AS current, v_p AS prior FROM u
UNION ALL SELECT 2, 'Accounts Buying', 'Doors w/ sales (L90D)', a, a_p FROM u
UNION ALL SELECT 3, 'SKUs per Account', 'Avg SKUs / door',
  (SELECT avg(n) FROM (SELECT count(DISTINCT item_code) AS n FROM s WHERE {recent} > 0 GROUP BY vip_id)),
  (SELECT avg(n) FROM (SELECT count(DISTINCT item_code) AS n FROM s WHERE {before} > 0 GROUP BY vip_id))
UNION ALL SELECT 4, 'Velocity per Account', 'CE / active door (L90D)', v / a, v_p / a_p FROM u
UNION ALL SELECT 5, 'Off-Premise Buying %', 'Off-Prem / Total (L90D)', off / act * 100, off_p / act_p * 100 FROM u
UNION ALL SELECT 6, 'Reorder Rate', 'Doors ordering 2x+ (L90D)', again / act * 100, again_p / act_p * 100 FROM u"""


def scorecard_kpis(t, chain=None):
    end = None if chain else latest_sale(t)
    lines = sold_lines(t, acc.scorecard_since(AS_OF, end))
    return acc.scorecard_of_lines(lines, items(t), roles.door(t), AS_OF, end, chain)


@query("Q71_scorecard", _kpi_sql(None), rounded=["current", "prior"])
def _(t):
    return scorecard_kpis(t)


@query("Q71_scorecard_chain", _kpi_sql("BUILDING 1"), rounded=["current", "prior"])
def _(t):
    return scorecard_kpis(t, "BUILDING 1")


@query(
    "Q72_variance",
    f"""SELECT *, current - prior AS change,
  CASE WHEN current > prior THEN 'pos' WHEN current < prior THEN 'neg' ELSE 'neutral' END AS change_class,
  CASE WHEN prior <> 0 THEN (current - prior) / prior * 100 END AS pct_change,
  CASE WHEN prior <> 0 THEN CASE WHEN (current - prior) / prior > 0 THEN 'pos' WHEN (current - prior) / prior < 0 THEN 'neg' ELSE 'neutral' END
    WHEN current > 0 THEN 'pos' ELSE 'neutral' END AS pct_class,
  CASE WHEN prior <> 0 THEN NULL WHEN current > 0 THEN 'New' ELSE '—' END AS pct_label,
  CASE WHEN prior <> 0 THEN greatest(0, least(100, current / greatest(prior, current) * 100)) WHEN current <> 0 THEN 100 ELSE 0 END AS current_bar,
  CASE WHEN prior <> 0 THEN greatest(0, least(100, prior / greatest(prior, current) * 100)) ELSE 0 END AS prior_bar
FROM ({_kpi_sql(None)})""",
    rounded=["current", "prior", "change", "pct_change", "current_bar", "prior_bar"],
    digits=5,
)
def _(t):
    return acc.variance(scorecard_kpis(t))


STATUS = """count(*) FILTER (WHERE customer_status = 'Active') AS {0}, count(*) FILTER (WHERE customer_status = 'At Risk') AS {1},
  count(*) FILTER (WHERE customer_status = 'Churned') AS {2}"""


@query(
    "Q73_chain_scorecard",
    f"""WITH {CHAINS_CTES} SELECT *,
  CASE WHEN qty_prev_30d > 0 THEN (qty_30d - qty_prev_30d) / qty_prev_30d * 100 ELSE 0 END AS delta_pct,
  CASE WHEN active_stores >= total_stores * CAST(0.7 AS DOUBLE) THEN 'Healthy' WHEN active_stores >= total_stores * CAST(0.4 AS DOUBLE) THEN 'At Risk' ELSE 'Critical' END AS health
FROM (SELECT chain_code, chain_name, count(DISTINCT vip_id) AS total_stores,
  {STATUS.format('active_stores', 'at_risk_stores', 'churned_stores')}, CAST(sum(qty_last_90_days) AS BIGINT) AS volume,
  CAST(sum(qty_last_30_days) AS BIGINT) AS qty_30d, CAST(sum(qty_previous_30_days) AS BIGINT) AS qty_prev_30d,
  CAST(sum(pod_last_30) AS BIGINT) AS pod_30, count(DISTINCT state) AS states FROM chain_door GROUP BY 1, 2)""",
    rounded=["delta_pct"],
)
def _(t):
    return acc.chain_scorecard(_chain_doors(t), "Last 90d")


def _portfolio_sql(period: str, pod: str, where: str) -> str:
    return f"""WITH {CHAINS_CTES}, owner AS ({OWNER}) SELECT *,
  CASE WHEN qty_prev_30d > 0 THEN (qty_30d - qty_prev_30d) / qty_prev_30d * 100 ELSE 0 END AS growth_pct,
  coalesce(volume / nullif(active_doors, 0), 0) AS avg_per_active
FROM (SELECT count(DISTINCT chain_code) AS chains, count(*) AS doors, {STATUS.format('active_doors', 'at_risk_doors', 'churned_doors')},
  CAST(coalesce(sum({period}), 0) AS BIGINT) AS volume, CAST(coalesce(sum({pod}), 0) AS BIGINT) AS total_pod,
  CAST(coalesce(sum(qty_last_30_days), 0) AS BIGINT) AS qty_30d,
  CAST(coalesce(sum(qty_previous_30_days), 0) AS BIGINT) AS qty_prev_30d FROM chain_door WHERE {where})"""


@query("Q74_portfolio_kpis", _portfolio_sql("qty_ytd", "pod_ytd", "TRUE"), rounded=["growth_pct", "avg_per_active"])
def _(t):
    return acc.portfolio_kpis(_chain_doors(t), "YTD")


@query(
    "Q74_owner_portfolio_kpis",
    _portfolio_sql(
        "qty_last_30_days", "pod_last_30",
        "chain_code IN (SELECT chain_code FROM owner WHERE kam = 'Owner 1') AND state IN ('AA', 'BB', 'CC', 'DD', 'EE')",
    ),
    rounded=["growth_pct", "avg_per_active"],
)
def _(t):
    chosen = acc.portfolio(_chain_doors(t), "Owner 1", None, ["AA", "BB", "CC", "DD", "EE"])
    return acc.portfolio_kpis(chosen)


@query(
    "Q74_store_table",
    f"""WITH {CHAINS_CTES} SELECT vip_id, store_name, city, state, customer_status, trend_30d, qty_lifetime AS volume,
  pod_last_30, qty_delta_30d, qty_pct_change_30d, primary_distributor_name FROM chain_door WHERE chain_name = 'BUILDING 1'""",
    rounded=["qty_pct_change_30d"],
)
def _(t):
    doors = acc.chain_doors(_sheet(t, with_primary=True))
    return acc.store_table(doors, "BUILDING 1", "Lifetime")


@query(
    "Q75_top_states",
    f"""WITH {CHAINS_CTES} SELECT state, CAST(sum(qty_last_90_days) AS BIGINT) AS volume FROM chain_door
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
)
def _(t):
    return acc.top_states(_chain_doors(t), "Last 90d")


@query(
    "Q75_top_cities",
    f"""WITH {CHAINS_CTES} SELECT city, state, CAST(sum(qty_last_90_days) AS BIGINT) AS volume, count(DISTINCT vip_id) AS doors,
  city || ', ' || state AS location FROM chain_door GROUP BY 1, 2 ORDER BY 3 DESC, 5 LIMIT 15""",
)
def _(t):
    return acc.top_cities(_chain_doors(t), "Last 90d")


SKU_SUMMARY = """SELECT *, CASE WHEN case_equiv_prior > 0 THEN (case_equiv_ttm - case_equiv_prior) / case_equiv_prior * 100 ELSE 0 END AS growth_pct
FROM (SELECT item_code, item_name, count(DISTINCT vip_id) AS doors, CAST(sum(ttm_current) AS BIGINT) AS case_equiv_ttm,
  CAST(sum(ttm_prior) AS BIGINT) AS case_equiv_prior, CAST(sum(total_units_all_time) AS BIGINT) AS raw_units,
  count(DISTINCT chain_code) AS chains, count(DISTINCT store_state) AS states FROM wide GROUP BY 1, 2)"""


@query("Q76_sku_summary", f"WITH {WIDE_CTE} {SKU_SUMMARY}", rounded=["growth_pct"])
def _(t):
    return acc.sku_summary(_sku_cells(t))


def _leaders(n: int) -> str:
    return f"SELECT DISTINCT item_name FROM (SELECT * FROM ({SKU_SUMMARY}) ORDER BY case_equiv_ttm DESC, item_code LIMIT {n})"


@query(
    "Q77_sku_state_cells",
    f"""WITH {WIDE_CTE}, lead AS ({_leaders(10)}),
cells AS (SELECT store_state, item_name, CAST(sum(ttm_current) AS BIGINT) AS volume FROM wide
  WHERE item_name IN (SELECT item_name FROM lead) GROUP BY 1, 2),
st AS (SELECT store_state FROM cells GROUP BY 1 ORDER BY sum(volume) DESC, 1 LIMIT 20)
SELECT st.store_state, lead.item_name, coalesce(volume, 0) AS volume
FROM st CROSS JOIN lead LEFT JOIN cells ON cells.store_state = st.store_state AND cells.item_name = lead.item_name""",
)
def _(t):
    return acc.sku_state_cells(_sku_cells(t))


@query(
    "Q77_monthly_sku_trend",
    f"""WITH {WIDE_CTE}, m AS (SELECT item_name, {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in MONTHS)} FROM wide
  WHERE item_name IN ({_leaders(5)}) GROUP BY 1)
SELECT * FROM m UNPIVOT (volume FOR month IN ({', '.join(MONTHS)}))""",
)
def _(t):
    return acc.monthly_sku_trend(_sku_cells(t), MONTHS)


@query(
    "Q78_sku_movement",
    f"""WITH {WIDE_CTE}, m AS (SELECT *, doors_current - doors_previous AS door_delta FROM (
  SELECT item_code, item_name, count(*) FILTER (WHERE jul_01 > 0) AS doors_current,
    count(*) FILTER (WHERE jun_01 > 0) AS doors_previous FROM wide GROUP BY 1, 2))
SELECT *, 'gained' AS direction FROM (SELECT * FROM m WHERE door_delta > 0 ORDER BY door_delta DESC, item_code LIMIT 10)
UNION ALL SELECT *, 'lost' FROM (SELECT * FROM m WHERE door_delta < 0 ORDER BY door_delta DESC, item_code LIMIT 10)""",
)
def _(t):
    return acc.sku_movement(_sku_cells(t), "jul_01", "jun_01")


@query(
    "Q79_distribution_breadth",
    f"WITH {WIDE_CTE} "
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS month, count(DISTINCT item_code) FILTER (WHERE {m} > 0) AS skus,
  count(DISTINCT vip_id) FILTER (WHERE {m} > 0) AS doors, CAST(sum({m}) AS BIGINT) AS volume FROM wide"""
        for m in MONTHS
    ),
)
def _(t):
    return acc.distribution_breadth(_sku_cells(t), MONTHS)


@query(
    "Q80_new_doors",
    f"""WITH {CHAINS_CTES} SELECT chain_name, count(DISTINCT vip_id) AS new_doors, CAST(sum(qty_last_30_days) AS BIGINT) AS volume_30d
FROM chain_door WHERE trend_30d IN ('New', 'New Activity') GROUP BY 1""",
)
def _(t):
    return acc.new_doors_by_chain(_chain_doors(t))


@query(
    "Q80_lapsing_doors",
    f"""WITH {CHAINS_CTES} SELECT chain_name, count(DISTINCT vip_id) FILTER (WHERE customer_status = 'At Risk') AS at_risk,
  count(DISTINCT vip_id) FILTER (WHERE customer_status = 'Churned') AS churned
FROM chain_door WHERE customer_status IN ('At Risk', 'Churned') GROUP BY 1""",
)
def _(t):
    return acc.lapsing_doors_by_chain(_chain_doors(t))


@query(
    "Q81_city_expansion",
    f"""WITH {CHAINS_CTES} SELECT *, volume - prev_volume AS vol_delta, city || ', ' || state AS location
FROM (SELECT city, state, count(DISTINCT vip_id) AS doors, count(*) FILTER (WHERE customer_status = 'Active') AS active,
  count(*) FILTER (WHERE trend_30d = 'Growing') AS growing, count(*) FILTER (WHERE trend_30d IN ('New', 'New Activity')) AS new_doors,
  CAST(sum(qty_last_30_days) AS BIGINT) AS volume, CAST(sum(qty_previous_30_days) AS BIGINT) AS prev_volume FROM chain_door GROUP BY 1, 2)
ORDER BY vol_delta DESC, location LIMIT 15""",
)
def _(t):
    return acc.city_expansion(_chain_doors(t))


@query(
    "Q82_store_map",
    f"""WITH {CHAINS_CTES} SELECT vip_id, store_name, city, state, customer_status, google_latitude, google_longitude,
  greatest(ln(1 + greatest(qty_last_90_days, 1)) * 3, 5) AS size FROM chain_door
WHERE google_latitude IS NOT NULL AND google_longitude IS NOT NULL""",
    rounded=["size"],
)
def _(t):
    return acc.store_map(_chain_doors(t), "Last 90d")
