"""Calendar helpers. Reference dates are plain Python dates, so every window
bound reaches the scan as a literal."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions.columns import col

# Day names by day-of-week number, 1 = Sunday.
DAY_ABBREVIATIONS = {1: "Sun", 2: "Mon", 3: "Tue", 4: "Wed", 5: "Thu", 6: "Fri", 7: "Sat"}
WEEKDAYS_MONDAY_FIRST = [
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
]
MONTH_ABBREVIATIONS = [
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]


# -- on the driver: bounds derived from as_of --------------------------------

def days_before(day: date, n: int) -> date:
    return day - timedelta(days=n)


def month_floor(day: date) -> date:
    return day.replace(day=1)


def shift_months(day: date, n: int) -> date:
    """Calendar shift, clamped to the last day of the target month."""
    index = day.year * 12 + day.month - 1 + n
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return date(year, month + 1, min(day.day, last))


def period_start(as_of: date, period: str) -> date:
    """First day of ``MTD`` / ``QTD`` / ``YTD`` or of a trailing ``<n>d`` window."""
    if period == "MTD":
        return month_floor(as_of)
    if period == "QTD":
        return date(as_of.year, 3 * ((as_of.month - 1) // 3) + 1, 1)
    if period == "YTD":
        return date(as_of.year, 1, 1)
    return days_before(as_of, int(period.rstrip("d")))


def trailing_months(as_of: date, n: int = 12) -> list[date]:
    """Month starts of the ``n`` months that end with the month of ``as_of``."""
    return [shift_months(month_floor(as_of), -i) for i in range(n - 1, -1, -1)]


def month_column(month: date) -> str:
    """Column name of a month in a wide sheet, e.g. ``feb_25``."""
    return f"{MONTH_ABBREVIATIONS[month.month - 1]}_{month.year % 100:02d}"


# -- on the cluster ----------------------------------------------------------

def sunday_week(c: str | Column) -> Column:
    """First day of a week that starts on Sunday."""
    return F.date_sub(col(c), F.dayofweek(col(c)) - 1)


def monday_week(c: str | Column) -> Column:
    return F.trunc(col(c), "week")


def month_start(c: str | Column) -> Column:
    return F.trunc(col(c), "month")


def quarter_start(c: str | Column) -> Column:
    return F.trunc(col(c), "quarter")


def month_label(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def quarter_label(c: str | Column) -> Column:
    return F.concat(F.year(col(c)), F.lit("-Q"), F.quarter(col(c)))


def month_index(c: str | Column) -> Column:
    """Months since year 0, so that differences count calendar boundaries."""
    return F.year(col(c)) * 12 + F.month(col(c)) - 1


def calendar_months_between(later: str | Column, earlier: str | Column) -> Column:
    return month_index(later) - month_index(earlier)


def local_timestamp(c: str | Column, tz: str) -> Column:
    """UTC instant as wall-clock time in ``tz``, whatever the session zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), col(c))


def local_date(c: str | Column, tz: str) -> Column:
    return local_timestamp(c, tz).cast("date")
