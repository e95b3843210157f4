"""Product hierarchy and SKU drill-down over daily or weekly SKU sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import first_match, in_list, money_sum
from shelfline.functions.joins import members_of, top_groups
from shelfline.operators.forecasting import numbered

# Ordered substring rules on the lower-cased product name. The first
# hit wins, so a 12oz product is a "Shot" ('2oz' is inside '12oz') and cranberry is
# "Berry"; the specific-first tables below avoid that.
FAMILY_RULES = [
    (["shot", "2oz", "2 oz"], "Shots"),
    (["750ml", "750 ml", "bottle"], "Bottles"),
    (["12oz", "12 oz"], "12oz Seltzers"),
    (["16oz", "16 oz"], "16oz Seltzers"),
    (["seltzer"], "Seltzers"),
]
POTENCY_RULES = [
    (["25mg"], "25mg"),
    (["10mg"], "10mg"),
    (["5mg"], "5mg"),
    (["2mg"], "2mg"),
]
FLAVOR_RULES = [
    (["berry"], "Berry"),
    (["citrus"], "Citrus"),
    (["tropical"], "Tropical"),
    (["spicy lime"], "Spicy Lime"),
    (["spicylime"], "Spicy Lime"),
    (["lemonade"], "Lemonade"),
    (["cherry"], "Cherry"),
    (["cranberry"], "Cranberry"),
    (["crnbry"], "Cranberry"),
    (["variety"], "Variety Pack"),
    (["original"], "Original"),
]
# The same rules with "12oz" before "2oz" and "cranberry" before "berry".
SPECIFIC_FIRST_FAMILY_RULES = [
    (["12oz", "12 oz"], "12oz Seltzers"),
    (["16oz", "16 oz"], "16oz Seltzers"),
    (["shot", "2oz", "2 oz"], "Shots"),
    (["750ml", "750 ml", "bottle"], "Bottles"),
    (["seltzer"], "Seltzers"),
]
SPECIFIC_FIRST_FLAVOR_RULES = [
    (["cranberry", "crnbry"], "Cranberry"),
    (["berry"], "Berry"),
    (["citrus"], "Citrus"),
    (["tropical"], "Tropical"),
    (["spicy lime", "spicylime"], "Spicy Lime"),
    (["lemonade"], "Lemonade"),
    (["cherry"], "Cherry"),
    (["variety"], "Variety Pack"),
    (["original"], "Original"),
]
LEVELS = ["family", "potency", "flavor", "product_name"]


def with_hierarchy(
    df: DataFrame,
    name: str = "product_name",
    family_rules=FAMILY_RULES,
    flavor_rules=FLAVOR_RULES,
) -> DataFrame:
    """Q52: family, potency and flavour of a product name."""
    text = F.lower(F.col(name))
    return df.withColumns(
        {
            "family": first_match(text, family_rules, "Other"),
            "potency": first_match(text, POTENCY_RULES, "Unknown"),
            "flavor": first_match(text, flavor_rules, "Unknown"),
        }
    )


def drill(
    sales: DataFrame, family: str | None = None, potency: str | None = None, flavor: str | None = None
) -> DataFrame:
    """Cascading selection; each level narrows the one above."""
    one = lambda v: None if v is None else [v]
    return sales.filter(
        in_list("family", one(family)) & in_list("potency", one(potency)) & in_list("flavor", one(flavor))
    )


def drill_level(family: str | None, potency: str | None, flavor: str | None) -> str:
    """Column the charts group by: the first level that is not fixed yet."""
    if flavor is not None:
        return "product_name"
    if potency is not None:
        return "flavor"
    return "potency" if family is not None else "family"


def sku_totals(sales: DataFrame) -> DataFrame:
    """Revenue, units, SKUs and families of a selection."""
    return sales.agg(
        money_sum("revenue").alias("revenue"),
        F.sum("units").alias("units"),
        F.countDistinct("sku").alias("skus"),
        F.countDistinct("family").alias("families"),
    )


def hierarchy_rollup(sales: DataFrame) -> DataFrame:
    """Q58: revenue, units and SKUs at every level of the hierarchy at once.

    Collapsed to one row per SKU first, so the rollup expands a small frame.
    ``level`` counts the levels that are set (0 = grand total).
    """
    per_sku = sales.groupBy(*LEVELS, "sku").agg(
        money_sum("revenue").alias("revenue"), F.sum("units").alias("units")
    )
    out = per_sku.rollup(*LEVELS).agg(
        money_sum("revenue").alias("revenue"),
        F.sum("units").alias("units"),
        F.countDistinct("sku").alias("skus"),
        F.bit_count(F.grouping_id()).alias("_open"),
    )
    return out.withColumn("level", F.lit(len(LEVELS)) - F.col("_open")).drop("_open")


def top_group_series(sales: DataFrame, group: str, metric: str = "revenue", n: int = 8) -> DataFrame:
    """Q58: time series of the ``n`` groups with the largest total."""
    total = money_sum(metric) if metric == "revenue" else F.sum(metric)
    series = sales.groupBy("order_date", group).agg(total.alias(metric))
    return members_of(series, top_groups(series, group, total, n), group)


def largest_groups(sales: DataFrame, group: str, n: int = 10) -> DataFrame:
    """Q58: the ``n`` groups with the largest revenue."""
    totals = sales.groupBy(group).agg(
        money_sum("revenue").alias("revenue"), F.sum("units").alias("units")
    )
    return totals.orderBy(F.col("revenue").desc(), group).limit(n)


def sku_comparison(sales: DataFrame, names: Sequence[str] | None = None, n: int = 3) -> DataFrame:
    """Q60: totals, active days and per-day means of the chosen products (default:
    the ``n`` with the largest revenue)."""
    if names:
        chosen = sales.filter(F.col("product_name").isin(list(names)))
    else:
        leaders = top_groups(sales, "product_name", money_sum("revenue"), n)
        chosen = members_of(sales, leaders, "product_name")
    out = chosen.groupBy("product_name", "family", "potency", "flavor").agg(
        money_sum("revenue").alias("revenue"),
        F.sum("units").alias("units"),
        F.countDistinct("order_date").alias("days_with_sales"),
    )
    days = F.col("days_with_sales")
    return out.withColumns(
        {"avg_daily_rev": F.col("revenue") / days, "avg_daily_units": F.col("units") / days}
    )


def ranked_skus(sales: DataFrame, n: int = 50) -> DataFrame:
    """Q60: the ``n`` best SKUs by revenue with their rank."""
    totals = sales.groupBy("sku", "product_name", "family", "potency", "flavor").agg(
        money_sum("revenue").alias("revenue"),
        F.sum("units").alias("units"),
        F.sum("order_count").alias("order_count"),
    )
    best = totals.orderBy(F.col("revenue").desc(), "sku", "product_name").limit(n)
    return numbered(best, F.col("revenue").desc(), "sku", "product_name")
