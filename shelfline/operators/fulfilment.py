"""Shipping reports over one fact: shipments (several may share an order)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import half_up, lookup, money_sum, percent, ratio, zero_if_null
from shelfline.functions.dates import days_before, month_floor, month_start, shift_months
from shelfline.functions.windows import rolling_mean

# Display names of carrier codes.
CARRIER_NAMES = {
    "ups_walleted": "UPS",
    "ups": "UPS Direct",
    "stamps_com": "Stamps.com",
    "fedex": "FedEx",
    "globalpost": "GlobalPost",
}
SHIPPED, PENDING = "shipped", "pending"


def month_to_date_stats(shipments: DataFrame, as_of: date) -> DataFrame:
    """Q27: this month, last month and today in one row.

    One pass: shipments fold to their order per window first, so the three distinct
    order counts become plain sums of flags.
    """
    this_month, last_month = month_floor(as_of), shift_months(month_floor(as_of), -1)
    day = F.col("order_date")
    window = shipments.filter(day >= F.lit(last_month))
    now = day >= F.lit(this_month)
    before = day < F.lit(this_month)
    today = day == F.lit(as_of)
    shipped = F.col("fulfillment_status") == SHIPPED
    pending = F.col("fulfillment_status") == PENDING
    per_order = window.groupBy("order_id").agg(
        *[F.bool_or(w).alias(n) for n, w in (("now", now), ("before", before), ("today", today))],
        F.count_if(now).alias("rows_now"),
        F.count_if(now & shipped).alias("shipped_now"),
        F.count_if(now & pending).alias("pending_now"),
        F.count_if(today & shipped).alias("shipped_today"),
        money_sum(F.when(now, F.col("order_total"))).alias("revenue_now"),
        money_sum(F.when(before, F.col("order_total"))).alias("revenue_before"),
        money_sum(F.when(now, F.col("shipment_cost"))).alias("cost_now"),
        money_sum(F.when(before, F.col("shipment_cost"))).alias("cost_before"),
        F.sum(F.when(now & shipped, F.col("days_to_ship"))).alias("ship_days"),
        F.count(F.when(now & shipped, F.col("days_to_ship"))).alias("ship_known"),
    )
    orders = lambda flag: F.count_if(F.col(flag) & F.col("order_id").isNotNull())
    total = lambda c: zero_if_null(F.sum(c))
    return per_order.agg(
        orders("now").alias("orders_this_month"),
        money_sum("revenue_now").alias("revenue_this_month"),
        money_sum("cost_now").alias("shipping_this_month"),
        total("shipped_now").alias("shipped_this_month"),
        total("pending_now").alias("pending_this_month"),
        percent(F.sum("shipped_now"), F.sum("rows_now"), 1).alias("fulfillment_rate"),
        ratio(F.sum("ship_days"), F.sum("ship_known"), 1).alias("avg_days_to_ship"),
        orders("before").alias("orders_last_month"),
        money_sum("revenue_before").alias("revenue_last_month"),
        money_sum("cost_before").alias("shipping_last_month"),
        orders("today").alias("orders_today"),
        total("shipped_today").alias("shipped_today"),
    )


def daily_fulfilment(shipments: DataFrame) -> DataFrame:
    """Q28: distinct orders, shipped rows and shipped share per day."""
    shipped = F.count_if(F.col("fulfillment_status") == SHIPPED)
    out = shipments.groupBy("order_date").agg(
        F.countDistinct("order_id").alias("orders_placed"),
        shipped.alias("orders_shipped"),
        F.count(F.lit(1)).alias("shipment_rows"),
    )
    return out.select(
        "order_date", "orders_placed", "orders_shipped",
        percent("orders_shipped", "shipment_rows", 1).alias("fulfillment_rate"),
    )


def recent_days(daily: DataFrame, n: int = 90) -> DataFrame:
    """Q28: the latest ``n`` days with a 7-day mean of orders (full windows only)."""
    latest = daily.orderBy(F.col("order_date").desc()).limit(n)
    return latest.withColumn("ma7", rolling_mean("orders_placed", "order_date", 7))


def carrier_months(shipments: DataFrame) -> DataFrame:
    """Q29: orders and mean cost per month and carrier."""
    return shipments.groupBy(
        month_start("order_date").alias("order_month"),
        F.coalesce("shipment_carrier", "order_carrier").alias("carrier_code"),
    ).agg(
        F.countDistinct("order_id").alias("order_count"),
        half_up(F.avg("shipment_cost"), 4).alias("avg_shipping_cost"),
    )


def recent_carrier_months(carriers: DataFrame, as_of: date, months: int = 3) -> DataFrame:
    """Q29: this month and the ``months`` before it."""
    return carriers.filter(F.col("order_month") >= F.lit(shift_months(month_floor(as_of), -months)))


def carrier_name(code: str | Column) -> Column:
    """Known display name, else the code in title case."""
    c = F.col(code) if isinstance(code, str) else code
    return lookup(c, CARRIER_NAMES, F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))


def current_carrier_mix(carriers: DataFrame) -> DataFrame:
    """Q29: carriers of the latest month with display names."""
    latest = carriers.agg(F.max("order_month").alias("m")).select("m").scalar()
    kept = carriers.filter((F.col("order_month") == latest) & F.col("carrier_code").isNotNull())
    return kept.withColumn("carrier_display", carrier_name("carrier_code"))


def state_distribution(shipments: DataFrame) -> DataFrame:
    """Q30: distinct orders per country and state."""
    return shipments.groupBy("ship_country", "ship_state").agg(
        F.countDistinct("order_id").alias("order_count")
    )


def top_ship_states(states: DataFrame, country: str = "US", n: int = 20) -> DataFrame:
    """Q30: states of one country with the most orders."""
    kept = states.filter(F.col("ship_country") == country)
    return kept.orderBy(F.col("order_count").desc(), "ship_state").limit(n)


def recent_orders(shipments: DataFrame, as_of: date, days: int = 7, n: int = 25) -> DataFrame:
    """Q31: newest shipments of the last week; any known carrier, else N/A."""
    kept = shipments.filter(F.col("order_date") >= F.lit(days_before(as_of, days)))
    newest = kept.orderBy(
        F.col("order_date").desc(), F.col("order_id").desc(), F.col("tracking_number").desc()
    ).limit(n)
    return newest.select(
        "order_number", "order_date", "fulfillment_status", "order_total",
        F.coalesce("shipment_carrier", "order_carrier", F.lit("N/A")).alias("carrier"),
        "ship_state", "tracking_number",
    )


def status_breakdown(stats: DataFrame) -> DataFrame:
    """Q32: shipped, pending and what is left of the orders, if above zero.

    Orders are distinct while shipped and pending count shipments, so the remainder
    called cancelled mixes two grains, as given.
    """
    rest = F.col("orders_this_month") - F.col("shipped_this_month") - F.col("pending_this_month")
    wide = stats.select(
        F.col("shipped_this_month").alias("Shipped"),
        F.col("pending_this_month").alias("Pending"),
        rest.alias("Cancelled"),
    )
    return wide.unpivot([], ["Shipped", "Pending", "Cancelled"], "status", "count").filter("count > 0")


def order_delta(stats: DataFrame) -> DataFrame:
    """Q32: change in orders against last month."""
    delta = F.col("orders_this_month") - F.col("orders_last_month")
    base = F.greatest("orders_last_month", F.lit(1))
    return stats.select(
        delta.alias("order_delta"), percent(delta, base, 1).alias("order_delta_pct")
    )
