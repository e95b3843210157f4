"""Customer lifetime queries Q83-Q94."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfline.operators import lifetime as ltv
from shelfline.plans.inputs import AS_OF
from shelfline.plans.registry import query
from shelfline.sources import roles

OVERLAP_START, OVERLAP_END = date(1998, 6, 1), date(1998, 12, 1)

ORDERS_CTES = """legacy AS (SELECT order_id, lower(trim(billing_email)) AS email, date_created AS ordered_at, total,
    'woocommerce' AS source, status = 'refunded' AS refunded
  FROM legacy_order WHERE status IN ('completed', 'refunded') AND trim(billing_email) <> ''),
web AS (SELECT id AS order_id, lower(trim(email)) AS email, created_at AS ordered_at, total_price AS total,
    'shopify' AS source, financial_status IN ('refunded', 'partially_refunded') AS refunded
  FROM web_order WHERE financial_status IN ('paid', 'partially_refunded', 'refunded') AND cancelled_at IS NULL
    AND trim(email) <> '' AND CAST(created_at AS DATE) >= DATE '1998-06-01'),
dupes AS (SELECT DISTINCT l.order_id FROM legacy l JOIN web w ON l.email = w.email
    AND CAST(l.ordered_at AS DATE) = CAST(w.ordered_at AS DATE) AND abs(l.total - w.total) < 1.00
  WHERE l.ordered_at >= TIMESTAMP '1998-06-01' AND l.ordered_at < TIMESTAMP '1998-12-01'),
all_orders AS (SELECT * FROM legacy WHERE order_id NOT IN (SELECT order_id FROM dupes) UNION ALL SELECT * FROM web)"""

CUSTOMERS_CTES = f"""{ORDERS_CTES}, customers AS (SELECT email, CAST(sum(total) AS DOUBLE) AS lifetime_revenue,
  coalesce(CAST(sum(total) FILTER (WHERE source = 'woocommerce') AS DOUBLE), 0) AS woo_revenue,
  coalesce(CAST(sum(total) FILTER (WHERE source = 'shopify') AS DOUBLE), 0) AS shopify_revenue,
  count(*) AS lifetime_orders, count(*) FILTER (WHERE source = 'woocommerce') AS woo_orders,
  count(*) FILTER (WHERE source = 'shopify') AS shopify_orders, count(*) FILTER (WHERE refunded) AS refunded_orders,
  min(ordered_at) AS first_order, max(ordered_at) AS last_order, min(ordered_at) AS first_order_date,
  CAST(datediff('day', CAST(min(ordered_at) AS DATE), CAST(max(ordered_at) AS DATE)) AS INTEGER) AS customer_lifespan_days
FROM all_orders GROUP BY email)"""


def _cohorts_sql(orders: str) -> str:
    return f"""SELECT strftime(cohort_month, '%Y-%m') AS cohort, msf AS months_since_first,
  count(DISTINCT email) AS customers, count(*) AS orders, CAST(sum(total) AS DOUBLE) AS revenue,
  CAST(round(CAST(CAST(sum(total) AS DOUBLE) / count(DISTINCT email) AS DECIMAL(38,5)), 2) AS DOUBLE) AS revenue_per_customer
FROM (SELECT o.*, cohort_month,
    CAST(datediff('month', cohort_month, CAST(ordered_at AS DATE)) AS INTEGER) AS msf
  FROM {orders} o JOIN (SELECT email, CAST(date_trunc('month', min(ordered_at)) AS DATE) AS cohort_month
    FROM {orders} GROUP BY email) c ON o.email = c.email)
WHERE msf <= 18 GROUP BY 1, 2"""


COHORT_CTES = f"{ORDERS_CTES}, cohorts AS ({_cohorts_sql('all_orders')})"
GRID_CTES = f"""{COHORT_CTES}, sizes AS (SELECT cohort, sum(customers) FILTER (WHERE months_since_first = 0) AS size
  FROM cohorts GROUP BY 1),
spine AS (SELECT cohort, size, m AS months_since_first FROM sizes, (SELECT DISTINCT months_since_first AS m FROM cohorts))"""
CUMULATIVE = """SELECT s.cohort, s.months_since_first,
  CASE WHEN CAST(s.cohort || '-01' AS DATE) + to_months(s.months_since_first) <= DATE '2001-07-01'
    THEN CAST(sum(CAST(coalesce(revenue, 0) AS DECIMAL(18,2))) OVER (PARTITION BY s.cohort ORDER BY s.months_since_first) AS DOUBLE) / size END
    AS cumulative_per_customer
FROM spine s LEFT JOIN cohorts c ON s.cohort = c.cohort AND s.months_since_first = c.months_since_first"""


def _legacy(t):
    return ltv.legacy_orders(roles.legacy_order(t))


def _web(t):
    return ltv.web_orders(roles.web_order(t, roles.WEB_START))


def _orders(t):
    return ltv.deduplicated_orders(_legacy(t), _web(t), OVERLAP_START, OVERLAP_END)


def _customers(t):
    return ltv.customer_lifetime(_orders(t))


def _cohorts(t):
    return ltv.cohort_table(_orders(t))


@query("Q83_customer_lifetime", f"WITH {CUSTOMERS_CTES} SELECT * FROM customers")
def _(t):
    return _customers(t)


def _summary_sql(revenue: str, orders: str, where: str) -> str:
    return f"""WITH {CUSTOMERS_CTES} SELECT count(*) AS total_customers,
  CAST(sum(CAST({revenue} AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
  round(CAST(sum(CAST({revenue} AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS avg_ltv,
  round(quantile_disc({revenue}, 0.5), 2) AS median_ltv, round(avg({orders}), 1) AS avg_orders,
  count(*) FILTER (WHERE {orders} > 1) AS repeat_customers,
  count(*) FILTER (WHERE woo_orders > 0 AND shopify_orders > 0) AS cross_platform,
  CAST(sum(CAST(woo_revenue AS DECIMAL(18,2))) AS DOUBLE) AS woo_revenue,
  CAST(sum(CAST(shopify_revenue AS DECIMAL(18,2))) AS DOUBLE) AS shopify_revenue,
  count(*) FILTER (WHERE woo_orders > 0) AS woo_customers, count(*) FILTER (WHERE shopify_orders > 0) AS shopify_customers,
  round(avg(customer_lifespan_days), 0) AS avg_lifespan_days,
  count(*) FILTER (WHERE refunded_orders > 0) AS customers_with_refunds FROM customers WHERE {where}"""


@query("Q84_lifetime_summary", _summary_sql("lifetime_revenue", "lifetime_orders", "TRUE"))
def _(t):
    return ltv.lifetime_summary(ltv.select_platform(_customers(t)))


@query(
    "Q84_lifetime_summary_platform",
    _summary_sql(
        "shopify_revenue", "shopify_orders",
        "shopify_orders > 0 AND CAST(first_order_date AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
    ),
)
def _(t):
    selected = ltv.select_platform(_customers(t), "Shopify", date(1996, 1, 1), date(2000, 12, 31))
    return ltv.lifetime_summary(selected)


# The test orders are worth thousands; the buckets are exercised on a scale of 1:1000.
DISTRIBUTION = f"""WITH {CUSTOMERS_CTES} SELECT
  CASE WHEN r < 25 THEN '$0-25' WHEN r < 50 THEN '$25-50' WHEN r < 100 THEN '$50-100' WHEN r < 200 THEN '$100-200'
    WHEN r < 500 THEN '$200-500' WHEN r < 1000 THEN '$500-1K' ELSE '$1K+' END AS ltv_bucket,
  CAST(CASE WHEN r < 25 THEN 1 WHEN r < 50 THEN 2 WHEN r < 100 THEN 3 WHEN r < 200 THEN 4 WHEN r < 500 THEN 5
    WHEN r < 1000 THEN 6 ELSE 7 END AS INTEGER) AS bucket_order, count(*) AS customers,
  round(CAST(sum(CAST(r AS DECIMAL(18,2))) AS DOUBLE), 0) AS bucket_revenue
FROM (SELECT floor(lifetime_revenue / 1000) AS r FROM customers) GROUP BY 1, 2"""


def _distribution(t):
    selected = ltv.select_platform(_customers(t))
    return ltv.lifetime_distribution(
        selected.withColumn("revenue", F.floor(F.col("revenue") / 1000).cast("double"))
    )


@query("Q85_lifetime_distribution", DISTRIBUTION)
def _(t):
    return _distribution(t)


@query(
    "Q85_top_bucket_share",
    f"""SELECT *, CAST(100 AS DOUBLE) * top_customers / (SELECT sum(customers) FROM ({DISTRIBUTION})) AS customer_pct,
  100 * top_revenue / (SELECT sum(bucket_revenue) FROM ({DISTRIBUTION})) AS revenue_pct
FROM (SELECT CAST(sum(customers) AS BIGINT) AS top_customers, sum(bucket_revenue) AS top_revenue FROM ({DISTRIBUTION})
  WHERE ltv_bucket = '$1K+')""",
    rounded=["customer_pct", "revenue_pct"],
)
def _(t):
    return ltv.top_bucket_share(_distribution(t))


@query(
    "Q86_monthly_platform_revenue",
    """SELECT CAST(date_trunc('month', date_created) AS DATE) AS month, 'WooCommerce' AS platform, count(*) AS orders,
  CAST(sum(total) AS DOUBLE) AS revenue FROM legacy_order WHERE status IN ('completed', 'refunded')
  AND date_created >= TIMESTAMP '1996-01-01' GROUP BY 1
UNION ALL SELECT CAST(date_trunc('month', created_at) AS DATE), 'Shopify', count(*), CAST(sum(total_price) AS DOUBLE)
FROM web_order WHERE financial_status IN ('paid', 'partially_refunded', 'refunded') AND cancelled_at IS NULL
  AND CAST(created_at AS DATE) >= DATE '1998-06-01' GROUP BY 1""",
)
def _(t):
    return ltv.monthly_platform_revenue(
        roles.legacy_order(t), roles.web_order(t, roles.WEB_START), start=date(1996, 1, 1)
    )


@query("Q87_overlap_duplicates", f"WITH {ORDERS_CTES} SELECT order_id FROM dupes")
def _(t):
    return ltv.overlap_duplicates(_legacy(t), _web(t), OVERLAP_START, OVERLAP_END)


@query(
    "Q87_deduplicated_orders",
    f"""WITH {ORDERS_CTES} SELECT order_id, email, CAST(ordered_at AS TIMESTAMP) AS ordered_at,
  CAST(total AS DOUBLE) AS total, source, refunded FROM all_orders""",
)
def _(t):
    orders = _orders(t)
    return orders.withColumn("total", orders.total.cast("double"))


@query("Q88_cohort_table", f"WITH {COHORT_CTES} SELECT * FROM cohorts")
def _(t):
    return _cohorts(t)


@query(
    "Q88_cohort_table_platform",
    f"""WITH {ORDERS_CTES}, mine AS (SELECT * FROM all_orders WHERE source = 'woocommerce')
SELECT * FROM ({_cohorts_sql('mine')}) WHERE cohort >= '1995-06'""",
)
def _(t):
    return ltv.cohort_table(_orders(t), "WooCommerce", start=date(1995, 6, 1))


@query(
    "Q89_repeat_rate_by_quarter",
    f"""WITH {CUSTOMERS_CTES} SELECT year(first_order_date) || '-Q' || quarter(first_order_date) AS quarter,
  count(*) AS total_customers, count(*) FILTER (WHERE lifetime_orders > 1) AS repeat_customers,
  round(count(*) FILTER (WHERE lifetime_orders > 1) / count(*) * 100, 1) AS repeat_rate,
  round(avg(lifetime_orders), 2) AS avg_orders FROM customers GROUP BY 1""",
)
def _(t):
    return ltv.repeat_rate_by_quarter(ltv.select_platform(_customers(t)))


@query(
    "Q90_top_customers",
    f"""WITH {CUSTOMERS_CTES} SELECT left(sha256(email), 12) AS customer_id, lifetime_orders,
  round(lifetime_revenue, 2) AS lifetime_revenue, CAST(first_order AS DATE) AS first_order,
  CAST(last_order AS DATE) AS last_order, CASE WHEN woo_orders > 0 AND shopify_orders > 0 THEN 'Both'
    WHEN woo_orders > 0 THEN 'Woo' ELSE 'Shopify' END AS platform, refunded_orders
FROM (SELECT * FROM customers ORDER BY customers.lifetime_revenue DESC, email LIMIT 50)""",
)
def _(t):
    return ltv.top_customers(ltv.select_platform(_customers(t)))


def _mature_sql(h: int, cutoff: str) -> str:
    return f"""WITH {COHORT_CTES} SELECT {h} AS horizon_months, r / c AS ltv, n AS qualifying_cohorts,
  earliest_cohort, latest_cohort, CAST(c AS BIGINT) AS total_customers, r AS total_revenue
FROM (SELECT CAST(sum(CAST(revenue AS DECIMAL(18,2))) FILTER (WHERE months_since_first BETWEEN 0 AND {h - 1}) AS DOUBLE) AS r,
  sum(customers) FILTER (WHERE months_since_first = 0) AS c, count(DISTINCT cohort) AS n, min(cohort) AS earliest_cohort,
  max(cohort) AS latest_cohort FROM cohorts WHERE cohort <= '{cutoff}')"""


@query("Q91_mature_ltv_6", _mature_sql(6, "2001-02"), rounded=["ltv"])
def _(t):
    return ltv.mature_lifetime_value(_cohorts(t), 6, AS_OF)


@query("Q91_mature_ltv_12", _mature_sql(12, "2000-08"), rounded=["ltv"])
def _(t):
    return ltv.mature_lifetime_value(_cohorts(t), 12, AS_OF)


@query(
    "Q92_cumulative_value",
    f"WITH {GRID_CTES} {CUMULATIVE}",
    rounded=["cumulative_per_customer"],
    digits=3,
)
def _(t):
    return ltv.cumulative_value(_cohorts(t), AS_OF)


@query(
    "Q92_cumulative_matrix",
    f"WITH {GRID_CTES}, cum AS ({CUMULATIVE}) SELECT cohort, "
    + ", ".join(
        f"max(cumulative_per_customer) FILTER (WHERE months_since_first = {m}) AS m{m}" for m in range(19)
    )
    + " FROM cum WHERE cohort IN (SELECT cohort FROM sizes WHERE size > 5) GROUP BY cohort",
    rounded=[f"m{m}" for m in range(19)],
    digits=3,
)
def _(t):
    return ltv.cumulative_matrix(_cohorts(t), AS_OF, min_size=5)


@query(
    "Q93_retention",
    f"""WITH {GRID_CTES} SELECT s.cohort, s.months_since_first,
  CAST(100 AS DOUBLE) * coalesce(customers, 0) / size AS retention_pct
FROM spine s LEFT JOIN cohorts c ON s.cohort = c.cohort AND s.months_since_first = c.months_since_first
WHERE size > 50""",
    rounded=["retention_pct"],
)
def _(t):
    return ltv.retention(_cohorts(t))


@query(
    "Q94_recent_cohort_curves",
    f"""WITH {GRID_CTES} SELECT s.cohort, s.months_since_first,
  sum(coalesce(revenue_per_customer, 0)) OVER (PARTITION BY s.cohort ORDER BY s.months_since_first) AS cumulative_revenue
FROM spine s LEFT JOIN cohorts c ON s.cohort = c.cohort AND s.months_since_first = c.months_since_first
WHERE s.cohort IN (SELECT DISTINCT cohort FROM cohorts ORDER BY 1 DESC LIMIT 12)""",
    rounded=["cumulative_revenue"],
    digits=3,
)
def _(t):
    return ltv.recent_cohort_curves(_cohorts(t))
