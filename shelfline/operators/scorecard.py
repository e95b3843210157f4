"""Marketing scorecard: live weekly figures, a manual sheet, and their roll-up."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.columns import abbreviated_count, day_range, money_sum, money_text
from shelfline.functions.dates import monday_week
from shelfline.functions.windows import latest_per_key, running_total


@dataclass(frozen=True)
class Metric:
    """A scorecard line. ``roll`` makes the current value from the weekly ones:
    ``max`` (cumulative series), ``sum`` or ``latest``. ``series`` metrics count
    scheduled weeks only."""

    key: str
    name: str
    owner: str
    target: float
    format: str
    source: str
    roll: str
    series: bool = False


# Sheet layout, bands, channel codes and the default audience patterns.
SHEET_FIXED = ["METRIC", "OWNER", "TARGET", "Current Total", "% TO TARGET"]
GREEN_FROM, YELLOW_FROM = 80, 50
WEB_CHANNEL = "shopify"
WEB_PAID = ["paid", "partially_refunded"]
EXACT_COUNT = r'(?i)content="[^"]*?([\d,]+)\s+followers?\s+on\s+LinkedIn'
SHORT_COUNT = r"(?i)([\d,.]+[KMB]?)\s+Followers"


# -- live figures --------------------------------------------------------------------

def weekly_retail_revenue(orders: DataFrame, start: date, end: date) -> DataFrame:
    """Q61: retail revenue per Monday week, drafts left out."""
    kept = orders.filter((F.col("order_status") != "Draft") & day_range("order_date", start, end))
    return kept.groupBy(monday_week("order_date").alias("week_start")).agg(
        money_sum("line_total_price").alias("revenue")
    )


def weekly_web_revenue(orders: DataFrame, start: date, end: date) -> DataFrame:
    """Q61: paid web revenue per Monday week."""
    kept = orders.filter(
        (F.col("channel") == WEB_CHANNEL)
        & F.col("financial_status").isin(WEB_PAID)
        & day_range("order_date", start, end)
    )
    return kept.groupBy(monday_week("order_date").alias("week_start")).agg(
        money_sum("subtotal").alias("revenue")
    )


def cumulative_weeks(weeks: DataFrame) -> DataFrame:
    """Q64: running total over the weeks of a quarter."""
    total = F.round(running_total("revenue", "week_start"), 2)
    return weeks.select("week_start", total.alias("cumulative_revenue"))


def follower_counts(pages: DataFrame, exact_pattern: str = EXACT_COUNT, short_pattern: str = SHORT_COUNT) -> DataFrame:
    """Q66: audience counts in page texts, exact and abbreviated; NULL without a match.
    The first group of each pattern is the count."""
    exact = F.regexp_extract("html", exact_pattern, 1)
    short = F.regexp_extract("html", short_pattern, 1)
    return pages.select(
        "page_id",
        "url",
        F.replace(exact, F.lit(",")).try_cast("bigint").alias("exact_count"),
        abbreviated_count(short).alias("abbreviated_count"),
    )


# -- the sheet -------------------------------------------------------------------------

def metric_key(label: str | Column, metrics: Sequence[Metric]) -> Column:
    """First metric whose name contains the label or is contained in it.

    A blank label matches nothing. The registry is a short list, so the match is one
    CASE expression instead of a join.
    """
    text = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    chain = None
    for m in metrics:
        name = m.name.lower()
        hit = (text != "") & (text.contains(name) | F.lit(name).contains(text))
        chain = F.when(hit, m.key) if chain is None else chain.when(hit, m.key)
    return chain


def header_date(header: str, year: int) -> date | None:
    """``M/D`` column header as a date; None for other headers and impossible days."""
    found = re.match(r"(\d{1,2})/(\d{1,2})", header.strip())
    try:
        return date(year, int(found[1]), int(found[2])) if found else None
    except ValueError:
        return None


def matched_rows(sheet: DataFrame, metrics: Sequence[Metric], position: str | None = None) -> DataFrame:
    """Sheet rows with their metric key; of several rows for one key the last counts."""
    keyed = sheet.withColumns(
        {
            "key": metric_key(sheet.columns[0], metrics),
            "_position": F.col(position) if position else F.monotonically_increasing_id(),
        }
    )
    return latest_per_key(keyed.filter("key IS NOT NULL"), ["key"], ["_position"]).drop("_position")


def sheet_values(
    sheet: DataFrame, year: int, metrics: Sequence[Metric], position: str | None = None
) -> DataFrame:
    """Q63: wide sheet to (key, week, value); blank, ``0`` and non-numeric cells drop."""
    dates = {c: header_date(c, year) for c in sheet.columns[len(SHEET_FIXED):]}
    weeks = {c: d for c, d in dates.items() if d is not None}
    rows = matched_rows(sheet, metrics, position)
    long = rows.select("key", *[F.col(f"`{c}`").alias(d.isoformat()) for c, d in weeks.items()]).unpivot(
        "key", [d.isoformat() for d in weeks.values()], "week", "text"
    )
    text = F.trim(F.regexp_replace("text", r"[$,]", ""))
    kept = long.filter((text != "") & (text != "0"))
    values = kept.select("key", F.col("week").cast("date").alias("week"), text.try_cast("double").alias("value"))
    return values.filter("value IS NOT NULL")


def sheet_totals(
    sheet: DataFrame, metrics: Sequence[Metric], position: str | None = None
) -> DataFrame:
    """Q63: the sheet's own total per metric."""
    rows = matched_rows(sheet, metrics, position)
    total = money_text(F.col(f"`{sheet.columns[3]}`"))
    return rows.select("key", total.alias("sheet_total")).filter("sheet_total IS NOT NULL")


# -- grid and scorecard ------------------------------------------------------------------

def current_week(schedule: Sequence[date], as_of: date) -> date:
    """Latest scheduled week not after ``as_of``, else the first."""
    past = [w for w in sorted(schedule) if w <= as_of]
    return past[-1] if past else min(schedule)


def registry_frame(spark: SparkSession, metrics: Sequence[Metric]) -> DataFrame:
    rows = [(m.key, m.name, m.owner, float(m.target), m.format, m.source, m.roll, m.series) for m in metrics]
    return spark.createDataFrame(
        rows,
        "key string, name string, owner string, target double, format string, source string, "
        "roll string, series boolean",
    )


def metric_grid(
    live: DataFrame,
    snapshots: DataFrame,
    sheet: DataFrame,
    schedule: Sequence[date],
    as_of: date,
    metrics: Sequence[Metric],
) -> DataFrame:
    """Q65: one value per metric and week, live before sheet.

    ``live`` has weekly values; ``snapshots`` one present value per metric, which
    counts for the current week when it is set and not zero.
    """
    week = current_week(schedule, as_of)
    present = snapshots.filter(F.col("value") != 0).select(
        "key", F.lit(week).alias("week"), F.col("value").cast("double").alias("live")
    )
    weekly = live.select("key", "week", F.col("value").cast("double").alias("live"))
    current = weekly.unionByName(present)
    written = sheet.select("key", "week", F.col("value").alias("written"))
    both = current.join(written, ["key", "week"], "full")
    series = [m.key for m in metrics if m.series]
    scheduled = F.col("week").isin(list(schedule)) | ~F.col("key").isin(series)
    return both.filter(scheduled).select("key", "week", F.coalesce("live", "written").alias("value"))


def band(pct: Column) -> Column:
    return F.when(pct >= GREEN_FROM, "green").when(pct >= YELLOW_FROM, "yellow").otherwise("red")


def metric_scorecard(
    registry: DataFrame, grid: DataFrame, totals: DataFrame, as_of: date
) -> DataFrame:
    """Q65: current value by each metric's roll rule, percent of target and band.

    Without a weekly value up to ``as_of`` the sheet's own total counts.
    """
    rolled = grid.filter(F.col("week") <= F.lit(as_of)).groupBy("key").agg(
        F.max("value").alias("_max"),
        F.sum("value").alias("_sum"),
        F.max_by("value", "week").alias("_latest"),
    )
    joined = registry.join(rolled, "key", "left").join(totals, "key", "left")
    by_rule = (
        F.when(F.col("roll") == "max", F.col("_max"))
        .when(F.col("roll") == "sum", F.col("_sum"))
        .otherwise(F.col("_latest"))
    )
    valued = joined.withColumn("value", F.coalesce(by_rule, "sheet_total"))
    pct = F.when(
        F.col("value").isNotNull() & (F.col("target") > 0), F.col("value") / F.col("target") * 100
    ).otherwise(0.0)
    return valued.select(
        "key", "name", "owner", "source", "target", "value",
        pct.alias("pct_to_target"), band(pct).alias("band"),
    )
