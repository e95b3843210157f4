"""Support-desk reports over tickets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import half_up, order_key, percent
from shelfline.functions.dates import (
    WEEKDAYS_MONDAY_FIRST,
    days_before,
    month_floor,
    month_label,
    month_start,
    shift_months,
)
from shelfline.functions.windows import rolling_mean

# Fixed values.
OPEN_STATUSES = ["open", "pending", "new"]
TAG_GROUPS = {
    "cs_reships": ["reship", "reshipment"],
    "protectly": ["protectly"],
    "address_changes": ["address_change", "wrongaddress"],
    "order_status": ["order_status"],
}
MIN_CSAT_TICKETS = 10


def _good() -> Column:
    return F.count_if(F.col("csat_score") == "good")


def _rated() -> Column:
    return F.count_if(F.col("csat_score").isin("good", "bad"))


def _csat() -> Column:
    """Good ratings over good and bad ones, as a fraction."""
    return F.try_divide(_good().cast("double"), _rated().cast("double"))


def ticket_stats(tickets: DataFrame, as_of: date) -> DataFrame:
    """Q33: the desk in one row."""
    every = F.count(F.lit(1))
    opened = lambda day: F.count_if(F.col("created_at").cast("date") == F.lit(day))
    return tickets.agg(
        every.alias("total_tickets"),
        F.count_if(F.col("status").isin(OPEN_STATUSES)).alias("backlog"),
        half_up(F.avg("resolution_minutes_business") / 60, 1).alias("avg_resolution_hours"),
        percent(F.count_if("resolved_same_day"), F.count_if("is_resolved"), 1).alias("same_day_pct"),
        percent(_good(), _rated(), 1).alias("csat_rate"),
        opened(as_of).alias("today_tickets"),
        opened(days_before(as_of, 1)).alias("yesterday_tickets"),
        percent(F.count_if("first_response_under_1hr"), every, 1).alias("fast_response_pct"),
    )


def daily_metrics(tickets: DataFrame) -> DataFrame:
    """Q34: tickets and satisfaction per day."""
    return tickets.groupBy("created_date").agg(
        F.count(F.lit(1)).alias("ticket_count"), _csat().alias("csat_rate")
    )


def recent_daily_metrics(daily: DataFrame, n: int = 90) -> DataFrame:
    """Q34: the latest ``n`` days with a 7-day mean and satisfaction in percent."""
    latest = daily.orderBy(F.col("created_date").desc()).limit(n)
    return latest.withColumns(
        {
            "ma7": rolling_mean("ticket_count", "created_date", 7),
            "csat_rate_pct": F.col("csat_rate") * 100,
        }
    )


def agent_months(tickets: DataFrame) -> DataFrame:
    """Q35: tickets and satisfaction per month and agent."""
    return tickets.groupBy(month_start("created_date").alias("created_month"), "agent_name").agg(
        F.count(F.lit(1)).alias("tickets_handled"), _csat().alias("csat_rate")
    )


def recent_months(months: DataFrame, as_of: date, n: int = 3) -> DataFrame:
    return months.filter(F.col("created_month") >= F.lit(shift_months(month_floor(as_of), -n)))


def _latest_month(months: DataFrame) -> DataFrame:
    latest = months.agg(F.max("created_month").alias("m")).select("m").scalar()
    return months.filter(F.col("created_month") == latest)


def busiest_agents(agents: DataFrame, n: int = 10) -> DataFrame:
    """Q35: agents with the most tickets in the latest month."""
    current = _latest_month(agents)
    return current.orderBy(F.col("tickets_handled").desc(), "agent_name").limit(n)


def best_rated_agents(agents: DataFrame, n: int = 5) -> DataFrame:
    """Q35: best satisfaction in the latest month among agents with enough tickets."""
    current = _latest_month(agents).filter(F.col("tickets_handled") >= MIN_CSAT_TICKETS)
    rated = current.filter("csat_rate IS NOT NULL")
    return rated.orderBy(F.col("csat_rate").desc(), "agent_name").limit(n)


def tag_months(tickets: DataFrame) -> DataFrame:
    """Tickets, mean resolution and satisfaction per month and tag."""
    return tickets.groupBy(month_start("created_date").alias("created_month"), "tag").agg(
        F.count(F.lit(1)).alias("ticket_count"),
        F.avg("resolution_minutes_business").alias("avg_resolution_minutes"),
        _csat().alias("csat_rate"),
    )


def tag_analysis(tags: DataFrame, as_of: date, months: int = 2, n: int = 15) -> DataFrame:
    """Q36: most used tags; means are unweighted means of the monthly means."""
    window = recent_months(tags, as_of, months)
    out = window.groupBy("tag").agg(
        F.sum("ticket_count").alias("total_tickets"),
        F.avg("avg_resolution_minutes").alias("avg_resolution"),
        F.avg("csat_rate").alias("avg_csat"),
    )
    return out.orderBy(F.col("total_tickets").desc(), "tag").limit(n)


def monthly_tag_counts(tags: DataFrame, as_of: date, names: Sequence[str]) -> DataFrame:
    """Tickets per month label and tag over twelve months."""
    window = tags.filter(
        F.col("tag").isin(list(names)) & (F.col("created_month") >= F.lit(shift_months(as_of, -12)))
    )
    return window.groupBy(month_label("created_month").alias("month"), "tag").agg(
        F.sum("ticket_count").alias("count")
    )


def monthly_tickets(daily: DataFrame, as_of: date) -> DataFrame:
    """Q38: tickets per month over twelve months."""
    window = daily.filter(F.col("created_date") >= F.lit(shift_months(as_of, -12)))
    return window.groupBy(month_label("created_date").alias("month")).agg(
        F.sum("ticket_count").alias("total_tickets")
    )


def tag_series(
    tags: DataFrame, daily: DataFrame, as_of: date, groups: Mapping[str, Sequence[str]] = TAG_GROUPS
) -> DataFrame:
    """Q37: one column per tag group on the spine of months with tickets, gaps 0."""
    names = sorted({tag for group in groups.values() for tag in group})
    counts = monthly_tag_counts(tags, as_of, names)
    sums = counts.groupBy("month").agg(
        *[F.sum(F.when(F.col("tag").isin(list(g)), F.col("count"))).alias(n) for n, g in groups.items()]
    )
    spine = monthly_tickets(daily, as_of)
    return spine.join(sums, "month", "left").na.fill(0, list(groups))


def hour_heat_map(tickets: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Q39: tickets per weekday (Monday first) and hour; hours without tickets are NULL."""
    window = tickets.filter(F.col("created_date") >= F.lit(days_before(as_of, days)))
    hours = list(range(24))
    wide = window.groupBy("created_day_of_week").pivot("created_hour", hours).agg(F.count(F.lit(1)))
    position = order_key("created_day_of_week", WEEKDAYS_MONDAY_FIRST)
    return wide.orderBy(position).select(
        "created_day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in hours]
    )

