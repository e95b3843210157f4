"""Operator inputs the plan modules share, and the fixed reference dates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.operators import inventory as inv
from shelfline.sources import footers, roles
from shelfline.sources.roles import Tables

AS_OF = date(2001, 8, 1)
EVENTS_AS_OF = date(2024, 1, 31)
DAYS = 90
WEEKS = 12
WINDOW_START = AS_OF - timedelta(days=DAYS)
TREND_START = AS_OF - timedelta(days=7 * WEEKS)
SALES_START = date(2000, 8, 1)
#: Days before the last shipment in which the last sale is looked for first.
LOOK_BACK = 35


def sold_lines(t: Tables, since: date | None = None, with_account: bool = True) -> DataFrame:
    return inv.product_sales(roles.sell_through(t, since, with_account))


def latest_sale(t: Tables) -> date | None:
    """Date of the last sale: one row, read from the line items alone when the plan is
    built, so that windows that end there reach the scan as literals.

    File statistics tell the last shipping date, though not whether it was a sale: the
    sales of the ``LOOK_BACK`` days before it are read, and all only if there are none."""
    shipped = footers.greatest(t.spark, f"{t.folder}/lineitem.parquet", "l_shipdate")
    hint = [shipped.date() - timedelta(days=LOOK_BACK)] if shipped else []
    for since in [*hint, None]:
        last = sold_lines(t, since, with_account=False).agg(F.max("sale_date")).first()[0]
        if last is not None:
            break
    return last


def items(t: Tables) -> DataFrame:
    return inv.current_items(roles.item(t))


def order_totals(t: Tables) -> DataFrame:
    orders = roles.b2b_order_line(t, WINDOW_START)
    return inv.distributor_order_totals(orders, roles.sku_map(t), AS_OF, DAYS)


def depletion(t: Tables) -> DataFrame:
    return inv.distributor_depletion(sold_lines(t, WINDOW_START), items(t), AS_OF, DAYS)


def health(t: Tables, trend_weeks: int | None = None) -> DataFrame:
    return inv.inventory_health(
        roles.b2b_order_line(t, WINDOW_START),
        roles.sku_map(t),
        sold_lines(t, WINDOW_START),
        items(t),
        roles.distributor(t),
        AS_OF,
        DAYS,
        roles.b2b_order_line(t, WINDOW_START, with_customer=False),
        trend_weeks,
    )


def weekly(t: Tables) -> DataFrame:
    return inv.weekly_orders_and_depletion(
        roles.b2b_order_line(t, TREND_START),
        roles.sku_map(t),
        sold_lines(t, TREND_START),
        items(t),
        AS_OF,
        WEEKS,
    )


def family_weeks(t: Tables) -> DataFrame:
    return inv.weekly_family_depletion(sold_lines(t, TREND_START), items(t), AS_OF, WEEKS)


def distributor_weeks(t: Tables) -> DataFrame:
    return inv.distributor_weekly_trend(
        sold_lines(t, TREND_START), items(t), roles.distributor(t), AS_OF, WEEKS
    )


def products(t: Tables) -> DataFrame:
    return inv.product_depletion(
        sold_lines(t, WINDOW_START), items(t), roles.distributor(t), AS_OF, DAYS
    )


def states(t: Tables) -> DataFrame:
    return inv.state_depletion(
        sold_lines(t, WINDOW_START), items(t), roles.distributor_state(t), AS_OF, DAYS
    )


def woi(t: Tables) -> DataFrame:
    return inv.weeks_of_inventory_by_sku(
        roles.b2b_order_line(t, WINDOW_START),
        roles.sku_map(t),
        sold_lines(t, WINDOW_START, with_account=False),
        items(t),
        roles.distributor(t),
        AS_OF,
        DAYS,
    )
