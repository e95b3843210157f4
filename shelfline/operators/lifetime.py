"""Customer lifetime value over two order platforms.

Both platforms are brought to one order shape (``order_id``, ``email``,
``ordered_at``, ``total``, ``source``, ``refunded``). Customers are folded to
customer-months before any cohort work, so an address that owns a large share of
the orders weighs no more than its months.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.columns import money_sum, not_blank, percent, pseudonym, ratio
from shelfline.functions.dates import (
    calendar_months_between,
    month_floor,
    month_label,
    month_start,
    quarter_label,
    shift_months,
)
from shelfline.functions.windows import running_total

# Fixed values.
LEGACY, WEB = "woocommerce", "shopify"
LEGACY_VALID = ["completed", "refunded"]
WEB_VALID = ["paid", "partially_refunded", "refunded"]
REFUNDED = ["refunded", "partially_refunded"]
PLATFORM_LABELS = {LEGACY: "WooCommerce", WEB: "Shopify"}
MAX_COHORT_AGE = 18
MIN_COHORT_SIZE = 50
BUCKETS = [
    (25, "$0-25"), (50, "$25-50"), (100, "$50-100"), (200, "$100-200"), (500, "$200-500"),
    (1000, "$500-1K"),
]
TOP_BUCKET = "$1K+"
PLATFORM_COLUMNS = {
    "All": ("lifetime_revenue", "lifetime_orders"),
    "WooCommerce": ("woo_revenue", "woo_orders"),
    "Shopify": ("shopify_revenue", "shopify_orders"),
}
AMOUNT = "decimal(18,4)"
# Rank error of the approximate median is at most 1 / accuracy of the customers.
MEDIAN_ACCURACY = 100_000


# -- orders of both platforms ----------------------------------------------------

def _address(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def legacy_orders(raw: DataFrame) -> DataFrame:
    kept = raw.filter(F.col("status").isin(LEGACY_VALID) & not_blank("billing_email"))
    return kept.select(
        "order_id",
        _address("billing_email").alias("email"),
        F.col("date_created").alias("ordered_at"),
        F.col("total").cast(AMOUNT).alias("total"),
        F.lit(LEGACY).alias("source"),
        F.col("status").isin(REFUNDED).alias("refunded"),
    )


def web_orders(raw: DataFrame) -> DataFrame:
    kept = raw.filter(
        F.col("financial_status").isin(WEB_VALID) & F.col("cancelled_at").isNull() & not_blank("email")
    )
    return kept.select(
        F.col("id").alias("order_id"),
        _address("email").alias("email"),
        F.col("created_at").alias("ordered_at"),
        F.col("total_price").cast(AMOUNT).alias("total"),
        F.lit(WEB).alias("source"),
        F.col("financial_status").isin(REFUNDED).alias("refunded"),
    )


def _nearby_amounts(web: DataFrame) -> DataFrame:
    """For each address, day and whole-dollar bucket: what web totals lie around it.

    Two totals in one dollar bucket always differ by less than 1. Across neighbouring
    buckets only the closest total matters, so the band test needs three values per
    key instead of a comparison of every pair of orders.
    """
    buckets = web.groupBy("email", "day", "bucket").agg(
        F.min("total").alias("low"), F.max("total").alias("high")
    )
    nothing = F.lit(None).cast(AMOUNT)
    seen_from = lambda shift, same, above, below: F.struct(
        (F.col("bucket") + shift).alias("bucket"),
        F.lit(same).alias("same"),
        above.alias("above"),
        below.alias("below"),
    )
    views = F.array(
        seen_from(0, True, nothing, nothing),
        seen_from(-1, False, F.col("low"), nothing),
        seen_from(1, False, nothing, F.col("high")),
    )
    flat = buckets.select("email", "day", F.inline(views))
    return flat.groupBy("email", "day", "bucket").agg(
        F.bool_or("same").alias("same"), F.min("above").alias("above"), F.max("below").alias("below")
    )


def _flag_duplicates(legacy: DataFrame, web: DataFrame, window: Column) -> DataFrame:
    """The ``legacy`` orders of the window with ``is_duplicate``."""
    placed = F.col("ordered_at").cast("date")
    keyed = lambda df: df.filter(window).withColumns({"day": placed, "bucket": F.floor("total").cast("bigint")})
    joined = keyed(legacy).join(_nearby_amounts(keyed(web)), ["email", "day", "bucket"], "left")
    near = (
        F.col("same")
        | (F.col("above") - F.col("total") < 1)
        | (F.col("total") - F.col("below") < 1)
    )
    flagged = joined.withColumn("is_duplicate", F.coalesce(near, F.lit(False)))
    return flagged.select(*legacy.columns, "is_duplicate")


def _in_overlap(start: date, end: date) -> Column:
    placed = F.col("ordered_at").cast("date")
    return (placed >= F.lit(start)) & (placed < F.lit(end))


def overlap_duplicates(legacy: DataFrame, web: DataFrame, start: date, end: date) -> DataFrame:
    """Q87: legacy orders of the overlap window that the web platform holds too: same
    address, same day, totals less than 1.00 apart."""
    window = _in_overlap(start, end)
    flagged = _flag_duplicates(legacy, web, window)
    return flagged.filter("is_duplicate").select("order_id").distinct()


def deduplicated_orders(legacy: DataFrame, web: DataFrame, start: date, end: date) -> DataFrame:
    """Q87: all orders without those duplicates. Only the orders of the overlap window
    enter the duplicate join; the rest of the history passes by it, in a scan of its own."""
    window = _in_overlap(start, end)
    checked = _flag_duplicates(legacy, web, window).filter("NOT is_duplicate").drop("is_duplicate")
    outside = legacy.filter(~F.coalesce(window, F.lit(False)))
    return outside.unionByName(checked).unionByName(web)


# -- customers ---------------------------------------------------------------------

def customer_lifetime(orders: DataFrame) -> DataFrame:
    """Q83: one row per customer over both platforms."""
    of = lambda source: F.col("source") == source
    revenue = lambda source: F.coalesce(
        money_sum(F.when(of(source), F.col("total"))), F.lit(0.0)
    )
    out = orders.groupBy("email").agg(
        money_sum("total").alias("lifetime_revenue"),
        revenue(LEGACY).alias("woo_revenue"),
        revenue(WEB).alias("shopify_revenue"),
        F.count(F.lit(1)).alias("lifetime_orders"),
        F.count_if(of(LEGACY)).alias("woo_orders"),
        F.count_if(of(WEB)).alias("shopify_orders"),
        F.count_if("refunded").alias("refunded_orders"),
        F.min("ordered_at").alias("first_order"),
        F.max("ordered_at").alias("last_order"),
    )
    return out.withColumns(
        {
            "first_order_date": F.col("first_order"),
            "customer_lifespan_days": F.date_diff("last_order", "first_order"),
        }
    )


def select_platform(
    customers: DataFrame, platform: str = "All", start: date | None = None, end: date | None = None
) -> DataFrame:
    """Customers of a platform with their first order in a range; ``revenue`` and
    ``orders`` are that platform's columns."""
    revenue, orders = PLATFORM_COLUMNS[platform]
    kept = customers if platform == "All" else customers.filter(F.col(orders) > 0)
    first = F.col("first_order_date").cast("date")
    if start is not None:
        kept = kept.filter(first >= F.lit(start))
    if end is not None:
        kept = kept.filter(first <= F.lit(end))
    return kept.withColumns({"revenue": F.col(revenue), "orders": F.col(orders)})


def lifetime_summary(selected: DataFrame) -> DataFrame:
    """Q84: totals, means, approximate median, repeat and cross-platform customers."""
    legacy, web = F.col("woo_orders") > 0, F.col("shopify_orders") > 0
    return selected.agg(
        F.count(F.lit(1)).alias("total_customers"),
        money_sum("revenue").alias("total_revenue"),
        F.round(money_sum("revenue") / F.count("revenue"), 2).alias("avg_ltv"),
        F.round(F.percentile_approx("revenue", 0.5, MEDIAN_ACCURACY), 2).alias("median_ltv"),
        F.round(F.avg("orders"), 1).alias("avg_orders"),
        F.count_if(F.col("orders") > 1).alias("repeat_customers"),
        F.count_if(legacy & web).alias("cross_platform"),
        money_sum("woo_revenue").alias("woo_revenue"),
        money_sum("shopify_revenue").alias("shopify_revenue"),
        F.count_if(legacy).alias("woo_customers"),
        F.count_if(web).alias("shopify_customers"),
        F.round(F.avg("customer_lifespan_days"), 0).alias("avg_lifespan_days"),
        F.count_if(F.col("refunded_orders") > 0).alias("customers_with_refunds"),
    )


def lifetime_distribution(selected: DataFrame) -> DataFrame:
    """Q85: customers and revenue per value bucket."""
    amount = F.col("revenue")
    name = number = None
    for i, (limit, label) in enumerate(BUCKETS, start=1):
        below = amount < limit
        name = F.when(below, label) if name is None else name.when(below, label)
        number = F.when(below, i) if number is None else number.when(below, i)
    bucket = name.otherwise(TOP_BUCKET).alias("ltv_bucket")
    order = number.otherwise(len(BUCKETS) + 1).alias("bucket_order")
    return selected.groupBy(bucket, order).agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(money_sum("revenue"), 0).alias("bucket_revenue"),
    )


def top_bucket_share(distribution: DataFrame) -> DataFrame:
    """Q85: share of customers and of revenue in the top bucket."""
    top = F.col("ltv_bucket") == TOP_BUCKET
    out = distribution.agg(
        F.sum(F.when(top, F.col("customers"))).alias("top_customers"),
        F.sum(F.when(top, F.col("bucket_revenue"))).alias("top_revenue"),
        F.sum("customers").alias("customers"),
        F.sum("bucket_revenue").alias("revenue"),
    )
    return out.select(
        "top_customers",
        "top_revenue",
        percent("top_customers", "customers").alias("customer_pct"),
        percent("top_revenue", "revenue").alias("revenue_pct"),
    )


def monthly_platform_revenue(
    legacy_raw: DataFrame, web_raw: DataFrame, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Q86: valid orders and revenue per month and platform, before de-duplication."""
    legacy = legacy_raw.filter(F.col("status").isin(LEGACY_VALID)).select(
        F.col("date_created").cast("date").alias("day"),
        F.col("total").cast(AMOUNT).alias("total"),
        F.lit(PLATFORM_LABELS[LEGACY]).alias("platform"),
    )
    web = web_raw.filter(
        F.col("financial_status").isin(WEB_VALID) & F.col("cancelled_at").isNull()
    ).select(
        F.col("created_at").cast("date").alias("day"),
        F.col("total_price").cast(AMOUNT).alias("total"),
        F.lit(PLATFORM_LABELS[WEB]).alias("platform"),
    )
    both = legacy.unionByName(web)
    if start is not None:
        both = both.filter(F.col("day") >= F.lit(start))
    if end is not None:
        both = both.filter(F.col("day") <= F.lit(end))
    return both.groupBy(month_start("day").alias("month"), "platform").agg(
        F.count(F.lit(1)).alias("orders"), money_sum("total").alias("revenue")
    )


def repeat_rate_by_quarter(selected: DataFrame) -> DataFrame:
    """Q89: repeat customers per acquisition quarter."""
    repeat = F.count_if(F.col("orders") > 1)
    return selected.groupBy(quarter_label("first_order_date").alias("quarter")).agg(
        F.count(F.lit(1)).alias("total_customers"),
        repeat.alias("repeat_customers"),
        F.round(repeat / F.count(F.lit(1)) * 100, 1).alias("repeat_rate"),
        F.round(F.avg("orders"), 2).alias("avg_orders"),
    )


def top_customers(selected: DataFrame, n: int = 50, id_length: int = 12) -> DataFrame:
    """Q90: best customers; the address leaves the job only as a pseudonym."""
    legacy, web = F.col("woo_orders") > 0, F.col("shopify_orders") > 0
    platform = F.when(legacy & web, "Both").when(legacy, "Woo").otherwise("Shopify")
    best = selected.orderBy(F.col("revenue").desc(), "email").limit(n)
    return best.select(
        pseudonym("email", id_length).alias("customer_id"),
        F.col("orders").alias("lifetime_orders"),
        F.round("revenue", 2).alias("lifetime_revenue"),
        F.col("first_order").cast("date").alias("first_order"),
        F.col("last_order").cast("date").alias("last_order"),
        platform.alias("platform"),
        "refunded_orders",
    )


# -- cohorts -------------------------------------------------------------------------

def cohort_table(
    orders: DataFrame,
    platform: str = "All",
    start: date | None = None,
    end: date | None = None,
    max_age: int = MAX_COHORT_AGE,
) -> DataFrame:
    """Q88: customers, orders and revenue per cohort month and months since first order.

    Orders fold to one row per customer and month, where the cohort is the earliest
    month: no join back to the orders and no distinct count of customers.
    """
    if platform != "All":
        source = {label: s for s, label in PLATFORM_LABELS.items()}[platform]
        orders = orders.filter(F.col("source") == source)
    months = orders.groupBy("email", month_start("ordered_at").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), money_sum("total").alias("revenue")
    )
    cohort = F.min("month").over(Window.partitionBy("email"))
    aged = months.withColumn("cohort_month", cohort)
    age = calendar_months_between("month", "cohort_month")
    aged = aged.withColumn("months_since_first", age).filter(F.col("months_since_first") <= max_age)
    if start is not None:
        aged = aged.filter(F.col("cohort_month") >= F.lit(start))
    if end is not None:
        aged = aged.filter(F.col("cohort_month") <= F.lit(end))
    out = aged.groupBy(month_label("cohort_month").alias("cohort"), "months_since_first").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("orders").alias("orders"),
        money_sum("revenue").alias("revenue"),
    )
    return out.withColumn("revenue_per_customer", ratio("revenue", "customers", 2))


def mature_lifetime_value(cohorts: DataFrame, horizon: int, as_of: date) -> DataFrame:
    """Q91: revenue per customer through ``horizon`` months, over cohorts old enough.

    A cohort counts when it began at least ``horizon`` calendar months before the
    month of ``as_of``. Without any customer the row is zero with no cohort names.
    """
    cutoff = shift_months(month_floor(as_of), -horizon).strftime("%Y-%m")
    age = F.col("months_since_first")
    out = cohorts.filter(F.col("cohort") <= cutoff).agg(
        money_sum(F.when(age.between(0, horizon - 1), F.col("revenue"))).alias("_revenue"),
        F.sum(F.when(age == 0, F.col("customers"))).alias("_customers"),
        F.countDistinct("cohort").alias("_cohorts"),
        F.min("cohort").alias("_first"),
        F.max("cohort").alias("_last"),
    )
    any_customer = F.col("_customers") > 0
    or_zero = lambda c, zero: F.when(any_customer, F.coalesce(F.col(c), F.lit(zero))).otherwise(zero)
    return out.select(
        F.lit(horizon).alias("horizon_months"),
        F.coalesce(F.when(any_customer, F.col("_revenue") / F.col("_customers")), F.lit(0.0)).alias("ltv"),
        or_zero("_cohorts", 0).alias("qualifying_cohorts"),
        F.when(any_customer, F.col("_first")).alias("earliest_cohort"),
        F.when(any_customer, F.col("_last")).alias("latest_cohort"),
        or_zero("_customers", 0).alias("total_customers"),
        or_zero("_revenue", 0.0).alias("total_revenue"),
    )


def cohort_grid(cohorts: DataFrame, value: str, newest: int | None = None) -> DataFrame:
    """Every cohort (or the ``newest`` ones) with every observed age; cells without a
    row are 0, and ``size`` is the cohort's customer count at age 0 (NULL if it has none).

    A cohort folds to one row with its cells by age (at most the maximum age). The ages
    of all cohorts and the newest come from windows over these few rows, so the cohort
    table is computed once.
    """
    age = F.col("months_since_first")
    cells = cohorts.groupBy("cohort", age).agg(
        F.sum(value).alias("value"), F.sum(F.when(age == 0, F.col("customers"))).alias("size")
    )
    folded = cells.groupBy("cohort").agg(
        F.max("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("months_since_first", "value"))).alias("cells")
    )
    everyone = Window.partitionBy()
    ages = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("cells")).over(everyone))))
    ranked = folded.withColumns({"ages": ages, "rank": F.row_number().over(everyone.orderBy(F.col("cohort").desc()))})
    if newest is not None:
        ranked = ranked.filter(F.col("rank") <= newest)
    spread = ranked.select("cohort", "size", "cells", F.explode("ages").alias("months_since_first"))
    filled = F.coalesce(F.try_element_at("cells", age), F.lit(0))
    return spread.select("cohort", "size", "months_since_first", filled.alias("value"))


def _cumulative(cohorts: DataFrame, as_of: date) -> DataFrame:
    grid = cohort_grid(cohorts, "revenue")
    total = running_total("value", "months_since_first", ["cohort"])
    began = F.to_date(F.concat("cohort", F.lit("-01")))
    month = F.add_months(began, F.col("months_since_first"))
    baked = month <= F.lit(shift_months(month_floor(as_of), -1))
    per_customer = total / F.col("size")
    return grid.select(
        "cohort", "size", "months_since_first", F.when(baked, per_customer).alias("cumulative_per_customer")
    )


def cumulative_value(cohorts: DataFrame, as_of: date) -> DataFrame:
    """Q92: cumulative revenue per customer by age; cells after the last complete
    month are NULL because the cohort has not lived through them."""
    return _cumulative(cohorts, as_of).drop("size")


def cumulative_matrix(
    cohorts: DataFrame, as_of: date, max_age: int = MAX_COHORT_AGE, min_size: int | None = MIN_COHORT_SIZE
) -> DataFrame:
    """Q92: the same with one column per age, small cohorts left out."""
    long = _cumulative(cohorts, as_of)
    if min_size is not None:
        long = long.filter(F.col("size") > min_size)
    ages = list(range(max_age + 1))
    wide = long.groupBy("cohort").pivot("months_since_first", ages).agg(
        F.first("cumulative_per_customer")
    )
    return wide.select("cohort", *[F.col(str(a)).alias(f"m{a}") for a in ages])


def retention(cohorts: DataFrame, min_size: int = MIN_COHORT_SIZE) -> DataFrame:
    """Q93: customers per age in percent of age 0, for cohorts above ``min_size``."""
    grid = cohort_grid(cohorts, "customers").filter(F.col("size") > min_size)
    return grid.select(
        "cohort", "months_since_first", percent("value", "size").alias("retention_pct")
    )


def recent_cohort_curves(cohorts: DataFrame, n: int = 12) -> DataFrame:
    """Q94: cumulative sum of the per-month averages of the ``n`` newest cohorts."""
    grid = cohort_grid(cohorts, "revenue_per_customer", newest=n)
    total = running_total("value", "months_since_first", ["cohort"])
    return grid.select("cohort", "months_since_first", total.alias("cumulative_revenue"))
