"""Business-to-business and web sales, billing and credits, channel reports.

Revenue columns are exact cent sums. Web orders are bucketed by the local day of
``tz``; their scan is narrowed first by a UTC range one day wider on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.columns import (
    day_range,
    in_list,
    lookup,
    money_sum,
    not_blank,
    percent,
    ratio,
)
from shelfline.functions.dates import (
    DAY_ABBREVIATIONS,
    local_date,
    monday_week,
    month_floor,
    month_label,
    shift_months,
)
from shelfline.functions.windows import rolling_mean

# Fixed values.
DEAD_STATUSES = ["Draft", "Cancelled"]
WEB_ZONE = "America/Los_Angeles"
GROSS_COLUMN = "total_line_items_price"
NET_COLUMN = "current_subtotal_price"
NOT_PRODUCTS = ["%Shipping Protection%", "%Protectly%"]
CREDIT_ACCOUNTS = ["%:Refunds", "%:Discounts"]
CREDIT_DETAIL = "SalesItemLineDetail"
ITEM_SCHEMA = "array<struct<title:string,sku:string,quantity:string,price:string,total_discount:string>>"
CREDIT_SCHEMA = (
    "array<struct<Amount:string,DetailType:string,"
    "SalesItemLineDetail:struct<ItemAccountRef:struct<name:string>>>>"
)


# -- business-to-business ------------------------------------------------------

def live_lines(lines: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Lines of orders that are neither drafts nor cancelled, in a date range."""
    kept = lines.filter(~F.col("order_status").isin(DEAD_STATUSES))
    if start is not None:
        kept = kept.filter(F.col("order_date") >= F.lit(start))
    if end is not None:
        kept = kept.filter(F.col("order_date") <= F.lit(end))
    return kept


def _b2b_measures() -> list[Column]:
    return [
        F.countDistinct("order_id").alias("order_count"),
        money_sum("line_revenue").alias("revenue"),
        F.sum("units_qty").alias("units"),
    ]


def b2b_daily(lines: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Q40: orders, revenue and units per day; day of week 1 = Sunday."""
    daily = live_lines(lines, start, end).groupBy("order_date").agg(*_b2b_measures())
    return daily.withColumn("day_of_week", F.dayofweek("order_date"))


def b2b_weekly(lines: DataFrame, start: date, end: date) -> DataFrame:
    """Q41: the same per Monday week."""
    week = monday_week("order_date").alias("week_start")
    return live_lines(lines, start, end).groupBy(week).agg(*_b2b_measures())


def with_owner(df: DataFrame, accounts: DataFrame, users: DataFrame, account: str = "account_id") -> DataFrame:
    """Owner name through the account and user look-ups; both may miss."""
    owners = accounts.select(F.col("id").alias("_account"), "owner_id")
    names = users.select(F.col("id").alias("_user"), F.col("name").alias("owner_name"))
    located = df.join(owners, F.col(account) == F.col("_account"), "left")
    named = located.join(names, F.col("owner_id") == F.col("_user"), "left")
    return named.drop("_account", "_user", "owner_id")


def b2b_by_account(
    lines: DataFrame, accounts: DataFrame, users: DataFrame, start: date, end: date
) -> DataFrame:
    """Q42: totals per account with its owner; aggregated before the look-ups."""
    totals = (
        live_lines(lines, start, end)
        .groupBy("account_id", "customer_name", "account_type")
        .agg(
            *_b2b_measures(),
            F.max("order_date").alias("last_order_date"),
            F.min("order_date").alias("first_order_date"),
        )
    )
    return with_owner(totals, accounts, users)


def b2b_by_state(lines: DataFrame, accounts: DataFrame, start: date, end: date) -> DataFrame:
    """Q45: totals per ship-to state of the account."""
    located = accounts.filter(not_blank("shipping_state")).select(
        F.col("id").alias("account_id"), F.upper(F.trim("shipping_state")).alias("state")
    )
    per_order = (
        live_lines(lines, start, end)
        .groupBy("account_id", "order_id")
        .agg(money_sum("line_revenue").alias("line_revenue"), F.sum("units_qty").alias("units_qty"))
    )
    return per_order.join(located, "account_id").groupBy("state").agg(*_b2b_measures())


def owner_options(lines: DataFrame, accounts: DataFrame, users: DataFrame) -> DataFrame:
    """Q46: distinct owners of accounts that ordered."""
    buyers = live_lines(lines).select("account_id").distinct()
    return with_owner(buyers, accounts, users).filter("owner_name IS NOT NULL").select("owner_name").distinct()


def account_type_options(lines: DataFrame) -> DataFrame:
    """Q46: distinct account types that ordered."""
    return live_lines(lines).filter("account_type IS NOT NULL").select("account_type").distinct()


# -- web -----------------------------------------------------------------------

def _web_window(orders: DataFrame, start: date, end: date, tz: str) -> DataFrame:
    """Orders of a local-day range."""
    placed = F.col("created_at")
    coarse = (placed >= F.lit(start - timedelta(days=1))) & (placed < F.lit(end + timedelta(days=2)))
    local = orders.filter(coarse).withColumn("order_date", local_date("created_at", tz))
    return local.filter(day_range("order_date", start, end))


def _web_revenue(net: bool) -> str:
    return NET_COLUMN if net else GROSS_COLUMN


def web_daily(
    orders: DataFrame, start: date, end: date, net: bool = False, tz: str = WEB_ZONE
) -> DataFrame:
    """Q43: web orders and revenue per local day."""
    daily = _web_window(orders, start, end, tz).groupBy("order_date").agg(
        F.countDistinct("id").alias("order_count"), money_sum(_web_revenue(net)).alias("revenue")
    )
    return daily.withColumn("day_of_week", F.dayofweek("order_date"))


def web_weekly(
    orders: DataFrame, start: date, end: date, net: bool = False, tz: str = WEB_ZONE
) -> DataFrame:
    """Q43: the same per Monday week."""
    week = monday_week("order_date").alias("week_start")
    return _web_window(orders, start, end, tz).groupBy(week).agg(
        F.countDistinct("id").alias("order_count"), money_sum(_web_revenue(net)).alias("revenue")
    )


def web_by_state(
    orders: DataFrame, start: date, end: date, net: bool = False, tz: str = WEB_ZONE
) -> DataFrame:
    """Q45: web totals per US province code of the JSON shipping address."""
    placed = _web_window(orders, start, end, tz).withColumns(
        {
            "_state": F.get_json_object("shipping_address", "$.province_code"),
            "_country": F.get_json_object("shipping_address", "$.country_code"),
        }
    )
    kept = placed.filter(not_blank("_state") & (F.col("_country") == "US"))
    return kept.groupBy(F.upper(F.trim("_state")).alias("state")).agg(
        F.countDistinct("id").alias("order_count"), money_sum(_web_revenue(net)).alias("revenue")
    )


def revenue_bridge(orders: DataFrame, start: date, end: date, tz: str = WEB_ZONE) -> DataFrame:
    """Q47: gross sales, discounts, returns (what is left over) and net sales."""
    totals = _web_window(orders, start, end, tz).agg(
        money_sum(GROSS_COLUMN).alias("gross_sales"),
        money_sum("total_discounts").alias("discounts"),
        money_sum(NET_COLUMN).alias("net_sales"),
        F.countDistinct("id").alias("orders"),
    )
    returns = F.round(F.col("gross_sales") - F.col("discounts") - F.col("net_sales"), 2)
    return totals.withColumn("returns", returns)


def web_items(
    documents: DataFrame, start: date, end: date, net: bool = False, tz: str = WEB_ZONE
) -> DataFrame:
    """One row per product in the JSON item arrays; each document is parsed once.

    Orders without items drop out, as do unnamed items and protection products.
    """
    parsed = _web_window(documents, start, end, tz).select(
        F.col("id").alias("order_id"),
        "order_date",
        F.inline(F.from_json("line_items", ITEM_SCHEMA)),
    )
    products = F.col("title").isNotNull()
    for pattern in NOT_PRODUCTS:
        products &= ~F.col("title").like(pattern)
    quantity = F.col("quantity").cast("bigint")
    price = F.col("price").cast("double")
    discount = F.coalesce(F.col("total_discount").try_cast("double"), F.lit(0.0))
    amount = quantity * price - discount if net else quantity * price
    return parsed.filter(products).select(
        "order_id",
        "order_date",
        F.col("title").alias("product_name"),
        "sku",
        quantity.alias("quantity"),
        price.alias("unit_price"),
        amount.alias("amount"),
    )


def web_products(
    documents: DataFrame, start: date, end: date, net: bool = False, tz: str = WEB_ZONE
) -> DataFrame:
    """Q44: product performance, gross or net of line discounts."""
    out = web_items(documents, start, end, net, tz).groupBy("product_name", "sku").agg(
        F.sum("quantity").alias("units_sold"),
        money_sum("amount").alias("revenue"),
        F.countDistinct("order_id").alias("order_count"),
        F.round(F.avg("unit_price"), 2).alias("avg_price"),
    )
    return out.filter("units_sold > 0")


# -- billing and credits ---------------------------------------------------------

def billed_monthly(invoices: DataFrame, start: date, end: date) -> DataFrame:
    """Q48: invoices and billed revenue per month."""
    return invoices.filter(day_range("txn_date", start, end)).groupBy(
        month_label("txn_date").alias("month")
    ).agg(F.count(F.lit(1)).alias("invoices"), money_sum("total_amt").alias("billed_revenue"))


def billed_weekly(invoices: DataFrame, start: date, end: date) -> DataFrame:
    """Q48: the same per Monday week."""
    return invoices.filter(day_range("txn_date", start, end)).groupBy(
        monday_week("txn_date").alias("week_start")
    ).agg(F.count(F.lit(1)).alias("invoices"), money_sum("total_amt").alias("billed_revenue"))


def credit_lines(memos: DataFrame, start: date, end: date) -> DataFrame:
    """Refund and discount lines of the nested memo documents, with a usable amount."""
    lines = memos.filter(day_range("txn_date", start, end)).select(
        "txn_date", F.inline(F.from_json("line", CREDIT_SCHEMA))
    )
    account = F.col("SalesItemLineDetail.ItemAccountRef.name")
    credited = account.like(CREDIT_ACCOUNTS[0]) | account.like(CREDIT_ACCOUNTS[1])
    amount = F.col("Amount").try_cast("double")
    kept = lines.filter((F.col("DetailType") == CREDIT_DETAIL) & credited & amount.isNotNull())
    return kept.select(F.col("txn_date").alias("credit_date"), amount.alias("amount"))


def credits_daily(memos: DataFrame, start: date, end: date) -> DataFrame:
    """Q49: credits per day."""
    return credit_lines(memos, start, end).groupBy("credit_date").agg(
        money_sum("amount").alias("credit_amount")
    )


def credits_weekly(memos: DataFrame, start: date, end: date) -> DataFrame:
    """Q49: credits per Monday week."""
    return credit_lines(memos, start, end).groupBy(monday_week("credit_date").alias("week_start")).agg(
        money_sum("amount").alias("credit_amount")
    )


def credits_total(memos: DataFrame, start: date, end: date) -> DataFrame:
    """Q49: all credits of the period."""
    return credit_lines(memos, start, end).agg(money_sum("amount").alias("total_credits"))


def net_of_credits(sales: DataFrame, credits: DataFrame, day: str, credit_day: str) -> DataFrame:
    """Q50: revenue minus the credits of the same day or week.

    Credits of days without sales have no row to be taken from; ``lost_credits``
    lists them.
    """
    given = credits.select(F.col(credit_day).alias("_day"), "credit_amount")
    joined = sales.join(given, F.col(day) == F.col("_day"), "left").drop("_day")
    left_over = F.col("revenue") - F.coalesce("credit_amount", F.lit(0.0))
    return joined.withColumn("revenue", F.round(left_over, 2)).drop("credit_amount")


def lost_credits(sales: DataFrame, credits: DataFrame, day: str, credit_day: str) -> DataFrame:
    """Q50: credits that ``net_of_credits`` cannot subtract."""
    return credits.join(sales, F.col(credit_day) == F.col(day), "left_anti")


# -- SKU sales -------------------------------------------------------------------

def b2b_sku_sales(lines: DataFrame, start: date, end: date, weekly: bool = False) -> DataFrame:
    """Q51: units, revenue and orders per day (or Monday week) and SKU."""
    named = live_lines(lines, start, end).filter("product_name IS NOT NULL")
    when = monday_week("order_date") if weekly else F.col("order_date")
    return named.groupBy(
        when.alias("order_date"), F.col("product_code").alias("sku"), "product_name"
    ).agg(
        F.sum("units_qty").alias("units"),
        money_sum("line_revenue").alias("revenue"),
        F.countDistinct("order_id").alias("order_count"),
    )


def web_sku_sales(
    documents: DataFrame,
    start: date,
    end: date,
    weekly: bool = False,
    net: bool = False,
    tz: str = WEB_ZONE,
) -> DataFrame:
    """Q51: the same from the JSON items of web orders; units above zero only."""
    items = web_items(documents, start, end, net, tz)
    when = monday_week("order_date") if weekly else F.col("order_date")
    out = items.groupBy(when.alias("order_date"), "sku", "product_name").agg(
        F.sum("quantity").alias("units"),
        money_sum("amount").alias("revenue"),
        F.countDistinct("order_id").alias("order_count"),
    )
    return out.filter("units > 0")


def combined_sku_sales(b2b: DataFrame, web: DataFrame) -> DataFrame:
    """Q51: both channels in one frame with a channel tag."""
    tagged = b2b.withColumn("channel", F.lit("B2B"))
    return tagged.unionByName(web.withColumn("channel", F.lit("B2C")), allowMissingColumns=True)


# -- channels ----------------------------------------------------------------------

def combine_daily(b2b: DataFrame, web: DataFrame) -> DataFrame:
    """Q54: both channels per day, zero-filled, with the total."""
    left = b2b.select("order_date", "day_of_week", F.col("revenue").alias("revenue_b2b"))
    right = web.select("order_date", "day_of_week", F.col("revenue").alias("revenue_b2c"))
    both = left.join(right, ["order_date", "day_of_week"], "full").na.fill(0.0)
    return both.withColumn("revenue", F.round(F.col("revenue_b2b") + F.col("revenue_b2c"), 2))


def combine_weekly(b2b: DataFrame, web: DataFrame) -> DataFrame:
    """Q54: both channels per week, zero-filled."""
    left = b2b.select("week_start", F.col("revenue").alias("b2b"))
    right = web.select("week_start", F.col("revenue").alias("b2c"))
    return left.join(right, "week_start", "full").na.fill(0.0)


def smoothed_daily(daily: DataFrame) -> DataFrame:
    """Q54: combined daily revenue with its 7-row mean."""
    return daily.withColumn("ma_7", rolling_mean("revenue", "order_date", 7, 1))


def channel_mix(b2b: DataFrame, web: DataFrame, start: date, end: date) -> DataFrame:
    """Q54: revenue, share, orders, average order value and daily mean per channel."""
    days = (end - start).days + 1

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.coalesce(money_sum("revenue"), F.lit(0.0)).alias("revenue"),
            F.coalesce(F.sum("order_count"), F.lit(0)).alias("orders"),
        ).withColumn("channel", F.lit(name))

    both = total(b2b, "B2B").unionByName(total(web, "B2C"))
    whole = F.sum("revenue").over(Window.partitionBy())
    return both.withColumns(
        {
            "share_pct": F.when(whole > 0, percent("revenue", whole)).otherwise(0.0),
            "avg_order_value": F.coalesce(ratio("revenue", "orders"), F.lit(0.0)),
            "daily_average": F.col("revenue") / F.lit(float(days)),
        }
    )


def same_day_month_over_month(daily: DataFrame, as_of: date) -> DataFrame:
    """Q55: this month to date against last month up to the same day.

    The previous month's end is clamped to its length. ``daily`` must reach back to
    the start of that month.
    """
    current_start = month_floor(as_of)
    prior_end = shift_months(as_of, -1)
    prior_start = month_floor(prior_end)
    day = F.col("order_date")
    window = daily.filter(day_range("order_date", prior_start, as_of))
    total = lambda a, b: F.coalesce(
        money_sum(F.when(day_range(day, a, b), F.col("revenue"))), F.lit(0.0)
    )
    out = window.agg(
        total(current_start, as_of).alias("current_month"),
        total(prior_start, prior_end).alias("last_month"),
    )
    change = (F.col("current_month") - F.col("last_month")) / F.col("last_month") * 100
    return out.withColumn("mom_pct", F.when(F.col("last_month") > 0, change))


def booked_monthly(lines: DataFrame, start: date, end: date) -> DataFrame:
    return live_lines(lines, start, end).groupBy(month_label("order_date").alias("month")).agg(
        F.countDistinct("order_id").alias("orders"), money_sum("line_revenue").alias("booked_revenue")
    )


def booked_vs_billed(booked: DataFrame, billed: DataFrame) -> DataFrame:
    """Q56: order revenue against invoices per month with the gap."""
    both = booked.join(billed, "month", "full").na.fill(0)
    gap = F.round(F.col("billed_revenue") - F.col("booked_revenue"), 2)
    both = both.withColumn("gap", gap)
    return both.withColumn("gap_pct", F.coalesce(percent("gap", "booked_revenue"), F.lit(0.0)))


def booked_vs_billed_long(recon: DataFrame) -> DataFrame:
    """Q56: the two revenue columns as rows."""
    long = recon.unpivot("month", ["booked_revenue", "billed_revenue"], "source", "revenue")
    names = {"booked_revenue": "Booked", "billed_revenue": "Billed"}
    return long.withColumn("source", lookup("source", names))


def reconciliation_totals(recon: DataFrame) -> DataFrame:
    """Q56: one row over all months."""
    out = recon.agg(
        money_sum("booked_revenue").alias("booked_revenue"),
        F.sum("orders").alias("orders"),
        money_sum("billed_revenue").alias("billed_revenue"),
        F.sum("invoices").alias("invoices"),
    )
    out = out.withColumn("gap", F.round(F.col("billed_revenue") - F.col("booked_revenue"), 2))
    return out.withColumn("gap_pct", percent("gap", "booked_revenue"))


# -- account and day reports -------------------------------------------------------

def filter_accounts(
    accounts: DataFrame, owners: Sequence[str] | None = None, types: Sequence[str] | None = None
) -> DataFrame:
    return accounts.filter(in_list("owner_name", owners) & in_list("account_type", types))


def account_totals(accounts: DataFrame) -> DataFrame:
    """Q57: revenue, orders, accounts and average order value of the selection."""
    out = accounts.agg(
        money_sum("revenue").alias("revenue"),
        F.sum("order_count").alias("orders"),
        F.count(F.lit(1)).alias("accounts"),
    )
    return out.withColumn("avg_order_value", F.coalesce(ratio("revenue", "orders"), F.lit(0.0)))


def top_accounts(accounts: DataFrame, n: int = 10) -> DataFrame:
    """Q57: largest accounts by revenue."""
    return accounts.orderBy(F.col("revenue").desc(), "account_id").limit(n).select(
        "customer_name", "account_type", "owner_name", "revenue", "order_count"
    )


def revenue_by_type(accounts: DataFrame) -> DataFrame:
    """Q57: revenue per account type; untyped accounts are left out."""
    typed = accounts.filter("account_type IS NOT NULL")
    return typed.groupBy("account_type").agg(money_sum("revenue").alias("revenue"))


def top_products(products: DataFrame, n: int = 8) -> DataFrame:
    """Q44: largest products by revenue."""
    return products.orderBy(F.col("revenue").desc(), "product_name", "sku").limit(n)


def top_states(states: DataFrame, n: int = 15) -> DataFrame:
    """Q57: largest states by revenue."""
    return states.orderBy(F.col("revenue").desc(), "state").limit(n)


def day_of_week_average(daily: DataFrame) -> DataFrame:
    """Q59: mean daily revenue per weekday."""
    out = daily.groupBy("day_of_week").agg(F.avg("revenue").alias("revenue"))
    return out.withColumn("day_name", lookup("day_of_week", DAY_ABBREVIATIONS))
