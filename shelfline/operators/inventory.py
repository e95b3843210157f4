"""Orders shipped to distributors against what distributors sell through.

``as_of`` stands for "today": windows end there and rows after it are ignored.
Units are individual bottles, cans or shots; case quantities are multiplied out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.columns import (
    ADJUSTMENT_ITEM_PATTERN,
    DEFAULT_UNITS_PER_CASE,
    PLACEHOLDER_ITEM,
    UOM_EACH,
    clip,
    day_range,
    distinct_list,
    in_list,
    lookup,
    money_sum,
    order_key,
    percent,
    ratio,
    zero_if_null,
)
from shelfline.functions.dates import days_before, period_start, sunday_week
from shelfline.functions.joins import grand_total, members_of, top_groups
from shelfline.functions.windows import lagged, latest_per_key, rolling_mean

# Thresholds, family case sizes and category order.
DISTRIBUTOR_TYPES = ["Distributor", "Distribution Center"]
DEAD_STATUSES = ["Draft", "Cancelled"]
OVERSTOCK_RATIO = 1.3
UNDERSTOCK_RATIO = 0.7
HIGH_VELOCITY = 60
MEDIUM_VELOCITY = 18
FAMILY_CASE_SIZE = {"Cans": 24, "Bottles": 6, "Shots": 36, "Other": 6}
CATEGORY_ORDER = {
    "2mg 750ml Bottle": 10,
    "5mg 750ml Bottle": 11,
    "10mg 750ml Bottle": 12,
    "10mg 16oz Seltzer": 20,
    "5mg 12oz Seltzer": 21,
    "5mg 2oz Shot": 30,
    "10mg 2oz Shot": 31,
}
CATEGORY_SHORT_NAMES = {
    "2mg 750ml Bottle": "2mg Bottle",
    "5mg 750ml Bottle": "5mg Bottle",
    "10mg 750ml Bottle": "10mg Bottle",
    "10mg 16oz Seltzer": "10mg Seltzer",
    "5mg 12oz Seltzer": "5mg Seltzer",
    "5mg 2oz Shot": "5mg Shot",
    "10mg 2oz Shot": "10mg Shot",
}


# -- inputs -------------------------------------------------------------------

def to_units(qty: Column, uom: Column, units_per_case: Column) -> Column:
    """Q01: each-quantities count as they are; cases, and any other or missing
    unit of measure, are multiplied by the case size (6 when unknown)."""
    cases = qty * F.coalesce(units_per_case, F.lit(DEFAULT_UNITS_PER_CASE))
    return F.when(uom == UOM_EACH, qty).otherwise(cases)


def current_items(items: DataFrame) -> DataFrame:
    """Newest version of every item, with a castable case size and its family."""
    known = items.filter(F.col("supplier_item").isNotNull())
    newest = latest_per_key(known, ["supplier_item"], ["extracted_at", "units", "desc"])
    units = F.col("units").try_cast("bigint")
    return newest.select(
        F.col("supplier_item").alias("item_code"),
        F.col("desc").alias("item_desc"),
        "brand_desc",
        "category",
        units.alias("units_per_case"),
        product_family(F.col("desc"), units).alias("product_family"),
    )


def product_family(desc: Column, units: Column) -> Column:
    """Ordered pattern rules; in the first one the case size only qualifies the
    second alternative."""
    return (
        F.when(desc.like("%Seltzer%") | (desc.like("%oz") & (units == 24)), "Cans")
        .when(desc.like("%750%") | desc.like("%ml"), "Bottles")
        .when(desc.like("%Shot%") | desc.like("%2 oz%"), "Shots")
        .otherwise("Other")
    )


def parse_sell_through(raw: DataFrame, since: date | None = None) -> DataFrame:
    """Text sell-through as typed lines; unparsable quantities and dates become NULL.

    Parsing per row hides the date from the scan, so this belongs in the job that
    loads the facts. ``yyyyMMdd`` text sorts like the date: ``since`` is applied to
    the text, where the scan can use it.
    """
    if since is not None:
        raw = raw.filter(F.col("invoice_date") >= since.strftime("%Y%m%d"))
    return raw.select(
        *(c for c in ("dist_code", "item_code", "acct_code", "uom") if c in raw.columns),
        F.col("qty").try_cast("bigint").alias("qty"),
        F.try_to_date("invoice_date", "yyyyMMdd").alias("sale_date"),
    )


def product_sales(typed: DataFrame) -> DataFrame:
    """Positive, dated sales of real products."""
    item = F.col("item_code")
    product = ~item.like(ADJUSTMENT_ITEM_PATTERN) & (item != PLACEHOLDER_ITEM)
    return typed.filter((F.col("qty") > 0) & product & F.col("sale_date").isNotNull())


def sell_through_lines(raw: DataFrame, since: date | None = None) -> DataFrame:
    """Both steps for a text source."""
    return product_sales(parse_sell_through(raw, since))


def trailing(lines: DataFrame, day: str, as_of: date, days: int) -> DataFrame:
    return lines.filter(day_range(day, days_before(as_of, days), as_of))


def line_count(lines: DataFrame) -> Column:
    """Number of lines in a group of rows: rows of a summary say how many they stand for."""
    return F.sum("line_count") if "line_count" in lines.columns else F.count(F.lit(1))


def depletion_by(
    lines: DataFrame,
    items: DataFrame,
    keys: Sequence,
    windows: Mapping[str, Column] | None = None,
    empty_windows: bool = True,
) -> DataFrame:
    """Sell-through pre-aggregated to ``keys`` x item, then converted to ``units``.

    Lines collapse before the item look-up, so a best-seller that owns a third of the
    lines reaches the join as at most one row per key. ``windows`` adds the units of
    the lines that meet each condition, from the same pass: 0 where there is none, or
    NULL if not ``empty_windows``. ``lines`` may be a daily summary of them.
    """
    return in_units(sums_by(lines, keys, windows), items, list(windows or {}), empty_windows)


def sums_by(lines: DataFrame, keys: Sequence, windows: Mapping[str, Column] | None = None) -> DataFrame:
    """The first half of ``depletion_by``: boxed and single quantities per ``keys`` x item."""
    each = F.col("uom") == UOM_EACH
    conditions = {"units": None, **(windows or {})}

    def summed(condition: Column | None, own: Column) -> Column:
        wanted = own if condition is None else condition & own
        return F.sum(F.when(wanted, F.col("qty")))

    return lines.groupBy(*keys, "item_code").agg(
        *[summed(w, ~F.coalesce(each, F.lit(False))).alias(f"_{n}_boxed") for n, w in conditions.items()],
        *[summed(w, F.coalesce(each, F.lit(False))).alias(f"_{n}_each") for n, w in conditions.items()],
        line_count(lines).alias("lines"),
        F.min("sale_date").alias("first_sale"),
        F.max("sale_date").alias("last_sale"),
    )


def in_units(sums: DataFrame, items: DataFrame, windows: Sequence[str] = (), empty_windows: bool = True) -> DataFrame:
    """The second half: the item look-up, and ``units`` for the two kinds of quantity."""
    conditions = ["units", *windows]
    size = F.coalesce("units_per_case", F.lit(DEFAULT_UNITS_PER_CASE))
    joined = sums.join(items, "item_code", "left")
    units = {
        n: zero_if_null(f"_{n}_boxed") * size + zero_if_null(f"_{n}_each") for n in conditions
    }
    if not empty_windows:
        some = {n: F.coalesce(f"_{n}_boxed", f"_{n}_each").isNotNull() for n in windows}
        units |= {n: F.when(some[n], units[n]) for n in some}
    spent = [f"_{n}_{part}" for n in conditions for part in ("boxed", "each")]
    return joined.withColumns(units).drop(*spent)


def units_by_measure(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Q01 as a report: lines, quantity and units per unit of measure."""
    summed = lines.groupBy("uom", "item_code").agg(
        line_count(lines).alias("lines"), F.sum("qty").alias("qty")
    )
    joined = summed.join(items, "item_code", "left")
    units = to_units(F.col("qty"), F.col("uom"), F.col("units_per_case"))
    return joined.groupBy("uom").agg(
        F.sum("lines").alias("lines"), F.sum("qty").alias("qty"), F.sum(units).alias("units")
    )


# -- orders -------------------------------------------------------------------

def sellable_pricebook() -> Column:
    """No price book, or one that is neither for samples nor a suggestion."""
    name = F.lower(F.col("pricebook_name"))
    return name.isNull() | (~name.like("%sample%") & ~name.like("%suggested%"))


def _distributor_orders(orders: DataFrame, sku_map: DataFrame, as_of: date, days: int) -> DataFrame:
    """Order lines in the window with the pack factor of their SKU.

    A SKU listed several times in the map repeats its lines; summing the map per
    SKU first gives the same totals through a one-to-one join.
    """
    factor = sku_map.groupBy("sf_sku").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.sum(F.coalesce("pack_size", F.lit(1))).alias("_pack"),
    )
    wanted = orders.filter(
        F.col("account_type").isin(DISTRIBUTOR_TYPES)
        & ~F.col("order_status").isin(DEAD_STATUSES)
        & day_range("order_date", days_before(as_of, days), as_of)
        & sellable_pricebook()
    )
    joined = wanted.join(factor, F.col("sku") == F.col("sf_sku"), "left")
    qty = F.col("quantity").cast("bigint")
    copies = F.coalesce("_copies", F.lit(1))
    return joined.select(
        "order_id",
        "account_id",
        F.col("customer_name").alias("distributor_name"),
        "sku",
        "order_date",
        (qty * copies).alias("cases"),
        (qty * F.coalesce("_pack", F.lit(1))).alias("units"),
        (F.col("line_total_price").cast("double") * copies).alias("value"),
    )


def _order_measures(with_last: bool = True) -> list[Column]:
    measures = [
        F.sum("cases").alias("qty_ordered_cases"),
        F.sum("units").alias("qty_ordered"),
        money_sum("value").alias("order_value"),
        F.countDistinct("order_id").alias("order_count"),
    ]
    return measures + ([F.max("order_date").alias("last_order_date")] if with_last else [])


def distributor_order_totals(
    orders: DataFrame, sku_map: DataFrame, as_of: date, lookback_days: int = 90
) -> DataFrame:
    """Q02: what was shipped to each distributor account in the window."""
    lines = _distributor_orders(orders, sku_map, as_of, lookback_days)
    return lines.groupBy("account_id", "distributor_name").agg(*_order_measures())


def all_channel_revenue(orders: DataFrame, as_of: date, lookback_days: int = 90) -> DataFrame:
    """Q03: one total over every channel; only drafts are left out, and the SKU map
    is not joined, so nothing is counted twice."""
    wanted = orders.filter(
        (F.col("order_status") != "Draft")
        & day_range("order_date", days_before(as_of, lookback_days), as_of)
        & sellable_pricebook()
    )
    return wanted.agg(money_sum("line_total_price").alias("total_revenue"))


# -- sell-through by distributor ----------------------------------------------

def trend_slots(as_of: date, weeks: int) -> dict[str, Column]:
    """A condition on ``sale_date`` for every Sunday week of the trend window, in order."""
    start = days_before(as_of, weeks * 7)
    first = start - timedelta(days=start.isoweekday() % 7)
    starts = [first + timedelta(days=7 * i) for i in range((as_of - first).days // 7 + 1)]
    return {
        f"week_{i}": day_range("sale_date", max(day, start), min(day + timedelta(days=6), as_of))
        for i, day in enumerate(starts)
    }


def distributor_depletion(
    lines: DataFrame, items: DataFrame, as_of: date, lookback_days: int = 90, trend_weeks: int | None = None
) -> DataFrame:
    """Q04: units, distinct stores, lines and weekly rate per distributor code.

    ``trend_weeks`` adds ``weekly_units``, the units of each week of a trend window
    inside the look-back (NULL without a sale), from the same pass."""
    slots = trend_slots(as_of, trend_weeks) if trend_weeks else {}
    window = trailing(lines, "sale_date", as_of, max(lookback_days, (trend_weeks or 0) * 7))
    grain = depletion_by(window, items, ["dist_code", "acct_code"], slots, empty_windows=False)
    weekly = [F.array(*[F.sum(w) for w in slots]).alias("weekly_units")] if slots else []
    return (
        grain.groupBy(F.col("dist_code").alias("distributor_code"))
        .agg(
            F.sum("units").alias("qty_depleted"),
            F.countDistinct("acct_code").alias("stores_reached"),
            F.sum("lines").alias("transaction_count"),
            *weekly,
        )
        .withColumn("weekly_depletion_rate", F.col("qty_depleted") / F.lit(lookback_days / 7.0))
    )


def _reconciled(
    order_totals: DataFrame, distributors: DataFrame, depletion: DataFrame, trend_weeks: int = 0
) -> DataFrame:
    """Order accounts with the sell-through of every distributor below them, plus
    distributors no order account covers. ``trend_weeks``: entries of ``weekly_units``
    of the sell-through to add up as well.

    A distributor belongs to an account through its own id or its parent's id; both
    become one equi key. The full join lets one pass serve both halves, so the order
    and sell-through facts are read once.
    """
    ids = F.array_distinct(F.array_compact(F.array("sf_account_id", "parent_sf_account_id")))
    keyed = distributors.filter(~F.col("is_parent_rollup")).select(
        F.col("distributor_code").alias("code"),
        F.col("distributor_name").alias("code_name"),
        "total_retailers",
        F.posexplode_outer(ids).alias("id_pos", "match_id"),
    )
    ordered = order_totals.drop("last_order_date").withColumn("has_orders", F.lit(True))
    joined = ordered.join(keyed, F.col("account_id") == F.col("match_id"), "full")
    joined = joined.withColumn("has_orders", F.coalesce("has_orders", F.lit(False)))

    # Accounts without a code get a key of their own, so they spread out.
    uncoded = F.when(F.col("code").isNull(), F.coalesce("account_id", "distributor_name"))
    code_key = Window.partitionBy("code", uncoded)
    joined = joined.withColumn("covered", F.max("has_orders").over(code_key))

    sold = depletion.withColumnRenamed("distributor_code", "sold_code")
    rows = joined.join(sold, F.col("code") == F.col("sold_code"), "left")
    orphan = (
        ~F.col("covered")
        & (F.coalesce("id_pos", F.lit(0)) == 0)
        & F.col("sold_code").isNotNull()
    )
    rows = rows.filter(F.col("has_orders") | orphan)
    orders_of = lambda c: F.coalesce(F.max(c), F.lit(0)).alias(c)
    weekly = []
    if trend_weeks:
        sums = [F.sum(F.get("weekly_units", F.lit(i))) for i in range(trend_weeks)]
        weekly = [F.array(*sums).alias("weekly_units")]
    return rows.groupBy(
        "has_orders",
        F.when(F.col("has_orders"), F.col("account_id")).otherwise(F.col("code")).alias("account_id"),
        F.when(F.col("has_orders"), F.col("distributor_name"))
        .otherwise(F.col("code_name"))
        .alias("distributor_name"),
    ).agg(
        orders_of("qty_ordered_cases"),
        orders_of("qty_ordered"),
        orders_of("order_value"),
        orders_of("order_count"),
        F.when(F.count("code") > 0, distinct_list("code")).alias("vip_codes"),
        F.sum("qty_depleted").alias("total_qty_depleted"),
        F.sum("stores_reached").alias("unique_stores"),
        F.sum("transaction_count").alias("depletion_transactions"),
        F.max("total_retailers").alias("total_retailers"),
        (F.count("code") > 0).alias("has_vip_match"),
        *weekly,
    )


def _with_rate(rolled: DataFrame, lookback_days: int) -> DataFrame:
    rate = F.col("total_qty_depleted") / F.lit(lookback_days / 7.0)
    return rolled.withColumn("weekly_depletion_rate", rate)


def parent_rollup(
    order_totals: DataFrame, distributors: DataFrame, depletion: DataFrame, lookback_days: int = 90
) -> DataFrame:
    """Q05: child sell-through rolled up onto the accounts that place orders."""
    rolled = _reconciled(order_totals, distributors, depletion).filter("has_orders")
    return _with_rate(rolled, lookback_days).drop("has_orders")


def sell_through_only(
    order_totals: DataFrame, distributors: DataFrame, depletion: DataFrame, lookback_days: int = 90
) -> DataFrame:
    """Q06: distributors that sold but whose accounts ordered nothing."""
    rolled = _reconciled(order_totals, distributors, depletion).filter("NOT has_orders")
    return _with_rate(rolled, lookback_days).drop("has_orders")


def stock_status(
    ordered: Column, depleted: Column, no_depletion: str, no_orders: str, nothing: str = "No Data"
) -> Column:
    """Ordered ladder over the order / sell-through ratio."""
    sold = F.coalesce(depleted, F.lit(0))
    share = F.try_divide(ordered.cast("double"), depleted.cast("double"))
    return (
        F.when((sold == 0) & (ordered > 0), no_depletion)
        .when((ordered == 0) & (sold > 0), no_orders)
        .when((sold > 0) & (share > OVERSTOCK_RATIO), "Overstock")
        .when((sold > 0) & (share < UNDERSTOCK_RATIO), "Understock")
        .when(sold > 0, "Balanced")
        .otherwise(nothing)
    )


def inventory_health(
    orders: DataFrame,
    sku_map: DataFrame,
    lines: DataFrame,
    items: DataFrame,
    distributors: DataFrame,
    as_of: date,
    lookback_days: int = 90,
    revenue_lines: DataFrame | None = None,
    trend_weeks: int | None = None,
) -> DataFrame:
    """Q07: order / sell-through ratio, weeks of inventory and status per account.

    The revenue total needs no customer: ``revenue_lines`` are the order lines
    without that join (default: ``orders``). ``trend_weeks``, at most the look-back,
    adds ``weekly_units`` of the account's distributors."""
    if trend_weeks and trend_weeks * 7 > lookback_days:
        raise ValueError("the trend is longer than the look-back")
    totals = distributor_order_totals(orders, sku_map, as_of, lookback_days)
    depletion = distributor_depletion(lines, items, as_of, lookback_days, trend_weeks)
    revenue = all_channel_revenue(orders if revenue_lines is None else revenue_lines, as_of, lookback_days)
    slots = len(trend_slots(as_of, trend_weeks)) if trend_weeks else 0
    combined = _with_rate(_reconciled(totals, distributors, depletion, slots), lookback_days)
    sold = F.col("total_qty_depleted")
    delta = F.col("qty_ordered") - zero_if_null(sold)
    return combined.select(
        F.col("account_id").alias("distributor_code"),
        "distributor_name",
        F.col("account_id").alias("sfdc_distributor_account_id"),
        zero_if_null("total_retailers").alias("total_retailers"),
        F.col("qty_ordered").alias("total_qty_ordered"),
        F.col("order_value").alias("total_order_value"),
        F.col("order_count").alias("total_orders"),
        revenue.select("total_revenue").scalar().alias("all_channel_revenue"),
        zero_if_null(sold).alias("total_qty_depleted"),
        zero_if_null("unique_stores").alias("unique_stores"),
        zero_if_null("depletion_transactions").alias("depletion_transactions"),
        F.coalesce("weekly_depletion_rate", F.lit(0.0)).alias("weekly_depletion_rate"),
        "has_vip_match",
        "vip_codes",
        F.when(sold > 0, ratio("qty_ordered", sold, 2)).alias("order_depletion_ratio"),
        F.when(
            F.col("weekly_depletion_rate") > 0, ratio(delta, "weekly_depletion_rate", 1)
        ).alias("weeks_of_inventory"),
        stock_status(F.col("qty_ordered"), sold, "No Depletion Data", "No Recent Orders").alias(
            "inventory_status"
        ),
        *(["weekly_units"] if slots else []),
    )


def distributor_list(distributors: DataFrame) -> DataFrame:
    """Filter values: real distributors with a code."""
    real = distributors.filter(F.col("distributor_code").isNotNull() & ~F.col("is_parent_rollup"))
    return real.select(
        "distributor_code", "distributor_name", "sf_account_id", "total_retailers"
    ).distinct()


# -- products, states, weeks ---------------------------------------------------

def velocity_tier(weekly_rate: Column, suffix: str = "") -> Column:
    return (
        F.when(weekly_rate >= HIGH_VELOCITY, "High" + suffix)
        .when(weekly_rate >= MEDIUM_VELOCITY, "Medium" + suffix)
        .otherwise("Low" + suffix)
    )


def product_depletion(
    lines: DataFrame,
    items: DataFrame,
    distributors: DataFrame,
    as_of: date,
    lookback_days: int = 90,
    codes: Sequence[str] | None = None,
    exclude_rollups: bool = False,
) -> DataFrame:
    """Q08: sell-through per distributor and item with a velocity tier."""
    window = trailing(lines, "sale_date", as_of, lookback_days).filter(in_list("dist_code", codes))
    grain = depletion_by(window, items, ["dist_code", "acct_code"])
    # One grain row per store, so counting rows counts distinct stores.
    per_item = grain.groupBy("dist_code", "item_code", "item_desc", "brand_desc").agg(
        F.sum("units").alias("qty_depleted"),
        F.count("acct_code").alias("stores_reached"),
        F.sum("lines").alias("transaction_count"),
    )
    dim = distributors.filter(~F.col("is_parent_rollup")) if exclude_rollups else distributors
    named = per_item.join(dim, F.col("dist_code") == F.col("distributor_code"))
    rate = F.col("qty_depleted") / F.lit(lookback_days / 7.0)
    return named.select(
        "distributor_code",
        "distributor_name",
        "item_code",
        F.coalesce("item_desc", "item_code").alias("product_name"),
        F.col("brand_desc").alias("brand"),
        "qty_depleted",
        "stores_reached",
        "transaction_count",
        F.round(rate, 1).alias("weekly_depletion_rate"),
        velocity_tier(rate, " Velocity").alias("velocity_status"),
    )


def state_depletion(
    lines: DataFrame, items: DataFrame, states: DataFrame, as_of: date, lookback_days: int = 90
) -> DataFrame:
    """Q09: sell-through and points of distribution per state.

    Doors and points are distinct per distributor and then added up, so
    ``avg_pods_per_dist`` is points per door.
    """
    grain = depletion_by(
        trailing(lines, "sale_date", as_of, lookback_days), items, ["dist_code", "acct_code"]
    )
    per_distributor = grain.groupBy("dist_code").agg(
        F.sum("units").alias("qty"),
        F.countDistinct("acct_code").alias("doors"),
        F.count("acct_code").alias("pods"),
    )
    located = per_distributor.join(
        states.filter(F.length("state") == 2), F.col("dist_code") == F.col("distributor_id")
    )
    out = located.groupBy("state").agg(
        F.countDistinct("dist_code").alias("distributor_count"),
        F.sum("qty").alias("total_depleted"),
        F.sum("doors").alias("total_doors"),
        F.sum("pods").alias("total_pods"),
    )
    return out.withColumns(
        {
            "avg_pods_per_dist": ratio("total_pods", "total_doors", 1),
            "weekly_rate": F.round(F.col("total_depleted") / F.lit(lookback_days / 7.0), 0),
        }
    )


def weekly_orders_and_depletion(
    orders: DataFrame,
    sku_map: DataFrame,
    lines: DataFrame,
    items: DataFrame,
    as_of: date,
    lookback_weeks: int = 12,
) -> DataFrame:
    """Q10: two weekly series (Sunday weeks) side by side, zero-filled."""
    days = lookback_weeks * 7
    ordered = (
        _distributor_orders(orders, sku_map, as_of, days)
        .groupBy(sunday_week("order_date").alias("week_start"))
        .agg(*_order_measures(with_last=False))
    )
    grain = depletion_by(
        trailing(lines, "sale_date", as_of, days),
        items,
        [sunday_week("sale_date").alias("week_start"), "acct_code"],
    )
    depleted = grain.groupBy("week_start").agg(
        F.sum("units").alias("qty_depleted"), F.countDistinct("acct_code").alias("stores_reached")
    )
    both = ordered.join(depleted, "week_start", "full").filter(F.col("week_start").isNotNull())
    return both.select(
        "week_start",
        zero_if_null("qty_ordered").alias("qty_ordered"),
        F.coalesce("order_value", F.lit(0.0)).alias("order_value"),
        zero_if_null("order_count").alias("order_count"),
        zero_if_null("qty_depleted").alias("qty_depleted"),
        zero_if_null("stores_reached").alias("stores_reached"),
    )


def weekly_family_depletion(
    lines: DataFrame, items: DataFrame, as_of: date, lookback_weeks: int = 12
) -> DataFrame:
    """Q11: weekly sell-through per product family."""
    grain = depletion_by(
        trailing(lines, "sale_date", as_of, lookback_weeks * 7),
        items,
        [sunday_week("sale_date").alias("week_start"), "acct_code"],
    )
    family = F.coalesce("product_family", F.lit("Other")).alias("product_family")
    return grain.groupBy("week_start", family).agg(
        F.sum("units").alias("qty_depleted"), F.countDistinct("acct_code").alias("stores_reached")
    )


def distributor_weekly_trend(
    lines: DataFrame, items: DataFrame, distributors: DataFrame, as_of: date, lookback_weeks: int = 12
) -> DataFrame:
    """Q12: weekly sell-through per distributor with a 4-week mean and 4-week lag."""
    grain = depletion_by(
        trailing(lines, "sale_date", as_of, lookback_weeks * 7),
        items,
        ["dist_code", sunday_week("sale_date").alias("week_start"), "acct_code"],
    )
    by_week = ["dist_code", "week_start"]
    volumes = grain.groupBy(*by_week, "item_code").agg(F.sum("units").alias("units"))
    volumes = volumes.groupBy(*by_week).agg(F.sum("units").alias("qty_depleted"), F.count("item_code").alias("skus_sold"))
    reached = grain.groupBy(*by_week, "acct_code").agg(F.lit(1).alias("one"))
    reached = reached.groupBy(*by_week).agg(F.count("acct_code").alias("stores_reached"))
    weekly = volumes.join(reached, by_week)
    real = distributors.filter(~F.col("is_parent_rollup"))
    named = weekly.join(real, F.col("dist_code") == F.col("distributor_code"))
    by = ["distributor_code"]
    return named.select(
        "distributor_code",
        "distributor_name",
        "week_start",
        "qty_depleted",
        "stores_reached",
        "skus_sold",
        rolling_mean("qty_depleted", "week_start", 4, 1, by).alias("ma_4wk"),
        lagged("qty_depleted", 4, "week_start", by).alias("qty_4wk_ago"),
    )


# -- weeks of inventory by SKU -------------------------------------------------

def _account_owner(distributors: DataFrame) -> DataFrame:
    """Account id -> the parent account that owns it. A parent owns itself."""
    real = distributors.filter(~F.col("is_parent_rollup"))
    parent = F.coalesce("parent_sf_account_id", "sf_account_id")
    children = real.select(F.col("sf_account_id").alias("account"), parent.alias("owner"))
    parents = real.select(parent.alias("account"), parent.alias("owner"))
    both = children.unionByName(parents).filter(F.col("account").isNotNull())
    is_self = F.max(F.when(F.col("account") == F.col("owner"), F.col("owner")))
    return both.groupBy("account").agg(F.coalesce(is_self, F.min("owner")).alias("owner"))


def weeks_of_inventory_by_sku(
    orders: DataFrame,
    sku_map: DataFrame,
    lines: DataFrame,
    items: DataFrame,
    distributors: DataFrame,
    as_of: date,
    lookback_days: int = 90,
    distributor_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Q13: orders against sell-through per parent distributor and SKU.

    ``distributor_id`` is the owning account where one is mapped, else the
    distributor code (then ``parent_account_id`` is NULL).
    """
    owners = _account_owner(distributors)
    per_account = (
        _distributor_orders(orders, sku_map, as_of, lookback_days)
        .groupBy("account_id", F.col("sku").alias("item"))
        .agg(
            F.min("distributor_name").alias("account_name"),
            F.sum("cases").alias("cases"),
            F.sum("units").alias("units"),
            money_sum("value").alias("value"),
            F.max("order_date").alias("last_order_date"),
        )
    )
    owner = F.coalesce("owner", "account_id")
    ordered = (
        per_account.join(owners, F.col("account_id") == F.col("account"), "left")
        .groupBy(owner.alias("distributor_id"), "item")
        .agg(
            F.min("account_name").alias("parent_account_name"),
            F.sum("cases").alias("qty_ordered_cases"),
            F.sum("units").alias("qty_ordered"),
            money_sum("value").alias("order_value"),
            F.max("last_order_date").alias("last_order_date"),
        )
    )
    per_code = depletion_by(trailing(lines, "sale_date", as_of, lookback_days), items, ["dist_code"])
    real = distributors.filter(~F.col("is_parent_rollup"))
    parent = F.coalesce("parent_sf_account_id", "sf_account_id")
    depleted = (
        per_code.join(real, F.col("dist_code") == F.col("distributor_code"))
        .groupBy(F.coalesce(parent, F.col("dist_code")).alias("distributor_id"), F.col("item_code").alias("item"))
        .agg(
            F.min("distributor_name").alias("code_name"),
            F.max(parent).alias("mapped_parent"),
            F.sum("units").alias("qty_depleted"),
            F.count(F.lit(1)).alias("dc_count"),
            F.max("last_sale").alias("last_depletion_date"),
        )
    )
    both = ordered.join(depleted, ["distributor_id", "item"], "full")
    both = both.filter(in_list("distributor_id", distributor_ids))
    described = both.join(
        items.select(F.col("item_code").alias("item"), "item_desc", "category"), "item", "left"
    )
    bought, sold = zero_if_null("qty_ordered"), zero_if_null("qty_depleted")
    rate = sold / F.lit(lookback_days / 7.0)
    delta = (bought - sold).cast("double")
    return described.select(
        "distributor_id",
        F.coalesce("code_name", "parent_account_name").alias("distributor_name"),
        F.when(F.col("qty_ordered").isNotNull(), F.col("distributor_id"))
        .otherwise(F.col("mapped_parent"))
        .alias("parent_account_id"),
        "parent_account_name",
        F.col("item").alias("vip_item_code"),
        F.coalesce("item_desc", "item").alias("product_name"),
        F.col("category").alias("product_category"),
        zero_if_null("qty_ordered_cases").alias("qty_ordered_cases"),
        bought.alias("qty_ordered"),
        F.coalesce("order_value", F.lit(0.0)).alias("order_value"),
        sold.alias("qty_depleted"),
        rate.alias("weekly_depletion_rate"),
        F.when(sold > 0, ratio(delta, rate, 1)).alias("weeks_of_inventory"),
        stock_status(bought, sold, "No Depletion", "No Orders").alias("inventory_status"),
        velocity_tier(rate).alias("velocity_tier"),
        F.when(sold > 0, ratio(bought, sold, 2)).alias("order_depletion_ratio"),
        delta.alias("implied_inventory_delta"),
        zero_if_null("dc_count").alias("dc_count"),
        "last_order_date",
        "last_depletion_date",
    )


# -- reports over the frames above ---------------------------------------------

def period_totals(
    lines: DataFrame, day: str, value: str, as_of: date, periods: Sequence[str]
) -> DataFrame:
    """Q18: one row per named period ending at ``as_of``; one pass over the facts.

    The weekly rate divides by the period's days; ``trend_weeks`` is the matching
    trend length, never under four weeks.
    """
    starts = {p: period_start(as_of, p) for p in periods}
    window = lines.filter(day_range(day, min(starts.values()), as_of))
    aggregates = []
    for period, start in starts.items():
        inside = F.col(day) >= F.lit(start)
        aggregates += [
            F.count_if(inside).alias(f"n_{period}"),
            F.sum(F.when(inside, F.col(value))).alias(f"v_{period}"),
        ]
    rows = [
        F.struct(
            F.lit(p).alias("period"),
            F.lit(starts[p]).alias("start_date"),
            F.lit((as_of - starts[p]).days).alias("lookback_days"),
            F.lit(max((as_of - starts[p]).days // 7, 4)).alias("trend_weeks"),
            F.col(f"n_{p}").alias("lines"),
            zero_if_null(f"v_{p}").alias("total"),
        )
        for p in periods
    ]
    long = window.agg(*aggregates).select(F.inline(F.array(*rows)))
    return long.withColumn("weekly_rate", ratio("total", F.col("lookback_days") / F.lit(7.0)))


def case_conversion(family_weeks: DataFrame) -> DataFrame:
    """Q19: units per family in cases, and the blended divisor for mixed totals."""
    totals = family_weeks.groupBy("product_family").agg(F.sum("qty_depleted").alias("units"))
    size = lookup("product_family", FAMILY_CASE_SIZE, F.lit(6))
    cased = totals.withColumns({"case_size": size, "cases": F.col("units") / size})
    everything = Window.partitionBy()
    blended = ratio(F.sum("units").over(everything), F.sum("cases").over(everything))
    return cased.withColumn("blended_divisor", F.coalesce(blended, F.lit(6.0)))


def health_summary(
    health: DataFrame, understock_weeks: float = 4, overstock_weeks: float = 12
) -> DataFrame:
    """Q20: counts by weeks of inventory, mean weeks and the total ratio."""
    weeks = F.col("weeks_of_inventory")
    sold = F.col("total_qty_depleted") > 0
    out = health.agg(
        F.count(F.lit(1)).alias("distributors"),
        F.max("all_channel_revenue").alias("all_channel_revenue"),
        money_sum("total_order_value").alias("total_order_value"),
        F.sum("total_qty_ordered").alias("total_qty_ordered"),
        F.sum("total_qty_depleted").alias("total_qty_depleted"),
        F.count_if(sold).alias("with_depletion"),
        F.count_if(sold & (weeks > overstock_weeks)).alias("overstock_count"),
        F.count_if(sold & (weeks < understock_weeks)).alias("understock_count"),
        F.count_if(sold & weeks.between(understock_weeks, overstock_weeks)).alias("balanced_count"),
        F.count_if(~F.coalesce(sold, F.lit(False))).alias("no_depletion_count"),
        F.avg(F.when(sold & (weeks > 0), weeks)).alias("avg_weeks"),
    )
    base = F.greatest("with_depletion", F.lit(1))
    return out.withColumns(
        {
            "overstock_pct": F.round(F.lit(100.0) * F.col("overstock_count") / base, 1),
            "understock_pct": F.round(F.lit(100.0) * F.col("understock_count") / base, 1),
            "order_depletion_ratio": F.coalesce(
                ratio("total_qty_ordered", "total_qty_depleted", 2), F.lit(0.0)
            ),
        }
    )


def extreme_stock(stock: DataFrame, ties: Sequence[str], n: int = 10) -> DataFrame:
    """Q21: the ``n`` most overstocked and most understocked rows by weeks."""
    known = stock.filter(F.col("weeks_of_inventory").isNotNull())
    weeks = F.col("weeks_of_inventory")
    over = known.filter(F.col("inventory_status") == "Overstock").orderBy(weeks.desc(), *ties).limit(n)
    under = known.filter(F.col("inventory_status") == "Understock").orderBy(weeks, *ties).limit(n)
    return over.unionByName(under)


def sku_label() -> Column:
    """Short label of a SKU at a distributor."""
    return F.concat(
        F.substring("product_name", 1, 25), F.lit(" @ "), F.substring("distributor_name", 1, 20)
    )


def top_products(products: DataFrame, n: int = 15) -> DataFrame:
    """Q22: best-selling products over all distributors."""
    totals = products.groupBy("product_name").agg(
        F.sum("qty_depleted").alias("qty_depleted"),
        F.sum("stores_reached").alias("stores_reached"),
        F.sum("transaction_count").alias("transaction_count"),
    )
    return totals.orderBy(F.col("qty_depleted").desc(), "product_name").limit(n)


def velocity_mix(products: DataFrame) -> DataFrame:
    """Q22: number of distributor x item rows per velocity tier."""
    return products.groupBy("velocity_status").agg(F.count(F.lit(1)).alias("rows"))


def state_share(states: DataFrame) -> DataFrame:
    """Q23: points per door and the state's share of all sell-through."""
    total = grand_total(states, F.sum("total_depleted"))
    doors = F.when(F.col("total_doors") == 0, 1).otherwise(F.col("total_doors"))
    return states.withColumns(
        {
            "avg_pods": ratio("total_pods", doors),
            "depletion_share_pct": percent("total_depleted", total),
        }
    )


def state_coverage(states: DataFrame) -> DataFrame:
    """Q23: one row of coverage totals with the leading state's share."""
    rank = F.struct("total_depleted", "state")
    out = states.agg(
        F.count(F.lit(1)).alias("states"),
        F.sum("total_depleted").alias("total_depleted"),
        F.sum("total_doors").alias("total_doors"),
        F.sum("total_pods").alias("total_pods"),
        F.max_by("state", rank).alias("top_state"),
        F.max("total_depleted").alias("_top"),
    )
    share = F.coalesce(percent("_top", "total_depleted"), F.lit(0.0))
    return out.withColumn("top_state_pct", share).drop("_top")


def weeks_heat_map(woi: DataFrame, n: int = 15, limit: int = 52) -> DataFrame:
    """Q24: mean weeks per distributor and category for the ``n`` largest accounts.

    Discontinued, unknown and implausible rows are left out; empty cells are 0.
    """
    usable = woi.filter(
        ~F.coalesce(F.col("product_category").contains("25mg"), F.lit(False))
        & F.col("weeks_of_inventory").between(-limit, limit)
    )
    cells = usable.groupBy("distributor_name", "product_category").agg(
        F.avg("weeks_of_inventory").alias("weeks"), money_sum("order_value").alias("value")
    )
    cells = cells.filter(F.col("product_category").isNotNull())
    largest = top_groups(cells, "distributor_name", money_sum("value"), n)
    grid = (
        members_of(cells, largest, "distributor_name")
        .groupBy("distributor_name")
        .pivot("product_category", list(CATEGORY_ORDER))
        .agg(F.first("weeks"))
    )
    return grid.select(
        "distributor_name",
        *[
            clip(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), float(-limit), float(limit)).alias(short)
            for c, short in CATEGORY_SHORT_NAMES.items()
        ],
    )


def weeks_detail(
    woi: DataFrame,
    distributors: Sequence[str] | None = None,
    statuses: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Q25: filtered detail in distributor, product-family, product order."""
    kept = woi.filter(
        in_list("distributor_name", distributors)
        & in_list("inventory_status", statuses)
        & in_list("product_category", categories)
    )
    position = lookup("product_category", CATEGORY_ORDER, F.lit(99))
    return kept.orderBy("distributor_name", position, "product_name").select(
        "distributor_name",
        "product_name",
        "product_category",
        "qty_ordered",
        "qty_depleted",
        "weekly_depletion_rate",
        "weeks_of_inventory",
        "inventory_status",
        "velocity_tier",
        "dc_count",
    )


def family_share(family_weeks: DataFrame) -> DataFrame:
    """Q26: sell-through per family, in cases, with its share."""
    totals = family_weeks.groupBy("product_family").agg(F.sum("qty_depleted").alias("qty_depleted"))
    everything = F.sum("qty_depleted").over(Window.partitionBy())
    size = lookup("product_family", FAMILY_CASE_SIZE, F.lit(6))
    return totals.withColumns(
        {
            "cases": F.col("qty_depleted") / size,
            "share_pct": percent("qty_depleted", everything, 1),
        }
    )


def smoothed_weeks(weeks: DataFrame) -> DataFrame:
    """Q26: 4-week means of ordered and depleted units, from the second week on."""
    return weeks.withColumns(
        {
            "orders_ma": rolling_mean("qty_ordered", "week_start", 4, 2),
            "depletion_ma": rolling_mean("qty_depleted", "week_start", 4, 2),
        }
    )


def urgency_order(urgency: str = "reorder_urgency") -> Column:
    """Sort key of the reorder table."""
    return order_key(urgency, ["CRITICAL", "HIGH", "MEDIUM", "LOW", "N/A"])
