"""Stock-out risk, projections and the two forecasting models.

Every series operator takes ``by``: many series are forecast in parallel, and the
single series of a report is the case without group columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.columns import col, ratio
from shelfline.functions.windows import from_end, from_start, rolling_mean, series

# Stock-out model.
TREND_WEIGHT = 0.5
DEFAULT_VARIATION = 0.2
RISK_PER_WEEK = 8
TREND_RISK = 0.3
VARIATION_RISK = 0.5
MAX_VARIATION_RISK = 0.3
TARGET_WEEKS = 8
URGENCY_WEEKS = [(3, "CRITICAL"), (6, "HIGH"), (10, "MEDIUM")]

# Damped-trend model.
DAMPING = 0.92
REVERSION = 0.05
FLOOR_SHARE = 0.5
MAX_VARIATION = 0.25
NO_SIGNAL_VARIATION = 0.15
BANDS = {"80": (0.8, 0.8), "95": (1.2, 0.6)}

#: Weight of the newest value in exponential smoothing.
SMOOTHING = 0.3

# Day-of-week seasonal model.
SEASONAL_MIN_ROWS = 14
SEASONAL_TREND_WEIGHT = 0.3


def series_stats(
    df: DataFrame, order: str, value: str, by: Sequence[str] = (), carry: Sequence[str] = ()
) -> DataFrame:
    """Shape of each series: length, means of its ends, spread. ``carry`` columns are
    the same in all rows of a series."""
    numbered = df.withColumns({"_up": from_start(order, by), "_down": from_end(order, by)})
    v = F.col(value).cast("double")
    mean_where = lambda c: F.avg(F.when(c, v))
    return numbered.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        mean_where(F.col("_up") <= 4).alias("first4"),
        mean_where(F.col("_down") <= 4).alias("last4"),
        mean_where(F.col("_down").between(5, 8)).alias("previous4"),
        F.max(F.when(F.col("_down") == 1, v)).alias("last_value"),
        F.max(F.when(F.col("_down") == 4, v)).alias("fourth_last"),
        F.stddev_samp(v).alias("sd_samp"),
        F.stddev_pop(v).alias("sd_pop"),
        F.max(order).alias("last_time"),
        *[F.first(c).alias(c) for c in carry],
    )


# -- stock-out risk ------------------------------------------------------------

def trend_codes() -> Column:
    """Distributor codes whose series make up a health row's trend: those of its list,
    else the row's own code (the row key is an account id)."""
    listed = F.transform(F.split(F.coalesce("vip_codes", "distributor_code"), ","), lambda c: F.trim(c))
    return F.array_distinct(F.filter(listed, lambda c: c != ""))


def _series_of(health: DataFrame, trends: DataFrame, codes: Column) -> DataFrame:
    """``health`` with ``weekly_units``: the added-up weeks of each row's codes, in order.

    Every series is folded to one array before the join, so a row meets its codes, not
    their weeks, and no window over weeks is needed."""
    week = F.struct(F.col("week_start"), F.col("qty_depleted").alias("qty"))
    per_code = trends.groupBy(F.col("distributor_code").alias("_code")).agg(F.collect_list(week).alias("_weeks"))
    rows = health.select(F.struct(*health.columns).alias("_row"), F.explode_outer(codes).alias("_code"))
    joined = rows.join(per_code, "_code", "left").groupBy(F.col("_row.distributor_code").alias("_key")).agg(
        F.first("_row").alias("_row"), F.flatten(F.collect_list("_weeks")).alias("_weeks")
    )
    starts = F.array_sort(F.array_distinct(F.transform("_weeks", lambda w: w["week_start"])))
    nothing = F.lit(None).cast("double")
    added = lambda start: F.aggregate(
        F.filter("_weeks", lambda w: w["week_start"] == start),
        nothing,
        lambda total, w: F.coalesce(total + w["qty"], total, w["qty"].cast("double")),
    )
    return joined.select("_row.*", F.transform(starts, added).alias("weekly_units"))


def stockout_risk(
    health: DataFrame, trends: DataFrame | None, as_of: date, codes: Column | None = None
) -> DataFrame:
    """Q14: weeks to stock-out, risk score and reorder advice per health row.

    ``distributor_code`` names a row. The weekly series of its codes are added up:
    from ``trends``, or without them as ``weekly_units`` of ``health``, which come with
    the pass over the facts that makes it. Trend compares the last four weeks with the
    first four of the series when it has at least eight weeks; variation is the sample
    deviation over the mean.
    """
    if trends is not None:
        health = _series_of(health, trends, trend_codes() if codes is None else codes)
    whole = health.withColumn("_v", F.transform(F.array_compact("weekly_units"), lambda x: x.cast("double")))
    n = F.size("_v")
    mean_of = lambda a, size: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / size
    sized = whole.withColumn("n", n).withColumn("mean", F.when(F.col("n") > 0, mean_of(F.col("_v"), F.col("n"))))
    long = F.col("n") >= 4
    squares = F.aggregate("_v", F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean")))
    joined = sized.withColumns(
        {
            "first4": F.when(long, mean_of(F.slice("_v", 1, 4), F.lit(4.0))),
            "last4": F.when(long, mean_of(F.slice("_v", -4, 4), F.lit(4.0))),
            "sd_samp": F.when(F.col("n") > 1, F.sqrt(squares / (F.col("n") - 1))),
        }
    )

    seen = F.col("n") >= 4
    base = F.when(F.col("n") >= 8, F.col("first4")).otherwise(F.col("last4"))
    trend = F.when(seen & (base > 0), (F.col("last4") - base) / base).otherwise(0.0)
    variation = F.when(
        seen & (F.col("mean") > 0), F.col("sd_samp") / F.col("mean")
    ).otherwise(DEFAULT_VARIATION)
    rate = F.coalesce("weekly_depletion_rate", F.lit(0.0))
    ordered = F.coalesce("total_qty_ordered", F.lit(0))
    adjusted = F.when(rate > 0, rate * (1 + F.col("_trend") * TREND_WEIGHT)).otherwise(0.0)
    on_hand = F.col("weeks_of_inventory")
    weeks = F.when(
        (F.col("_rate") > 0) & (ordered > 0), ordered / F.col("_rate")
    ).when(on_hand > 0, on_hand)

    scored = joined.withColumns({"_trend": trend, "_cv": variation})
    scored = scored.withColumn("_rate", adjusted).withColumn("_weeks", weeks)
    left = F.col("_weeks")
    exposure = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - left * RISK_PER_WEEK))
    trend_factor = 1 + F.greatest(F.lit(0.0), F.col("_trend") * TREND_RISK)
    spread_factor = 1 + F.least(F.lit(MAX_VARIATION_RISK), F.col("_cv") * VARIATION_RISK)
    unknown = F.when(F.col("total_qty_depleted") > 0, 50.0).otherwise(0.0)
    score = F.when(
        left.isNotNull(), F.least(F.lit(100.0), exposure * trend_factor * spread_factor)
    ).otherwise(unknown)
    urgency = F.when(F.col("_rate") <= 0, "N/A")
    for limit, label in URGENCY_WEEKS:
        urgency = urgency.when(left < limit, label)
    wanted = F.col("_rate") * TARGET_WEEKS - ordered
    # A projection past the calendar's end has no date.
    days_left = F.floor(F.round(left * 7, 9))
    runs_out = F.when(days_left < 2_000_000, F.date_add(F.lit(as_of), days_left.cast("int")))
    return scored.select(
        "distributor_code",
        "distributor_name",
        on_hand.alias("current_inventory_weeks"),
        rate.alias("weekly_depletion_rate"),
        F.col("_rate").alias("adjusted_weekly_rate"),
        (F.col("_trend") * 100).alias("velocity_trend_pct"),
        F.col("_cv").alias("velocity_cv"),
        left.alias("weeks_until_stockout"),
        runs_out.alias("predicted_stockout_date"),
        score.alias("risk_score"),
        F.when(F.col("_rate") > 0, F.greatest(F.lit(0.0), wanted))
        .otherwise(0.0)
        .alias("reorder_qty_suggested"),
        urgency.otherwise("LOW").alias("reorder_urgency"),
        ordered.alias("qty_ordered_period"),
        F.coalesce("total_qty_depleted", F.lit(0)).alias("qty_depleted_period"),
    )


def stockout_timeline(risk: DataFrame, n: int = 15) -> DataFrame:
    """Q14: the rows with a predicted date, soonest first."""
    dated = risk.filter("predicted_stockout_date IS NOT NULL")
    return dated.orderBy("weeks_until_stockout", "distributor_code").limit(n)


def inventory_projection(risk: DataFrame, as_of: date, weeks: int = 12) -> DataFrame:
    """Q15: inventory per distributor and future week at the adjusted rate."""
    rate = F.coalesce("adjusted_weekly_rate", F.lit(0.0))
    start = F.coalesce("qty_ordered_period", F.lit(0))
    ahead = risk.select(
        "distributor_code",
        "distributor_name",
        F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week_number"),
        rate.alias("projected_depletion"),
        start.alias("_start"),
    )
    left = F.greatest(F.lit(0.0), F.col("_start") - F.col("week_number") * F.col("projected_depletion"))
    return ahead.select(
        "distributor_code",
        "distributor_name",
        F.date_add(F.lit(as_of), F.col("week_number") * 7).alias("forecast_week"),
        "week_number",
        "projected_depletion",
        left.alias("projected_inventory"),
        (left <= 0).alias("is_stockout"),
        F.col("projected_depletion").alias("weekly_depletion_rate"),
    )


def projection_by_week(projection: DataFrame) -> DataFrame:
    """Q15: total depletion and distributors out of stock per week."""
    return projection.groupBy("forecast_week").agg(
        F.sum("projected_depletion").alias("total_projected_depletion"),
        F.count_if("is_stockout").alias("distributors_in_stockout"),
    )


# -- damped trend ----------------------------------------------------------------

def damped_trend_forecast(
    df: DataFrame, order: str, value: str, by: Sequence[str] = (), weeks: int = 12
) -> DataFrame:
    """Q16: trend that fades by ``DAMPING`` a week while the level reverts to the mean.

    The week-by-week recursion has a closed form, so each horizon is an independent
    row: level(i) = mean + r^i (last - mean) + t d (r^i - d^i) / (r - d), r = 1 - reversion.
    """
    stats = series_stats(df, order, value, by).filter("n > 0")
    level = F.when(F.col("n") >= 4, F.col("last4")).otherwise(F.col("mean"))
    trend = (
        F.when(F.col("n") >= 8, (F.col("last4") - F.col("previous4")) / 4)
        .when(F.col("n") >= 4, (F.col("last_value") - F.col("fourth_last")) / 4)
        .otherwise(0.0)
    )
    spread = F.when(F.col("mean") > 0, F.col("sd_pop") / F.col("mean")).otherwise(NO_SIGNAL_VARIATION)
    prepared = stats.select(
        *by,
        "last_time",
        "mean",
        level.alias("level"),
        trend.alias("trend"),
        F.least(spread, F.lit(MAX_VARIATION)).alias("cv"),
        F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("step"),
    )
    keep = 1 - REVERSION
    i = F.col("step")
    reverting = F.pow(F.lit(keep), i)
    fading = F.pow(F.lit(DAMPING), i)
    path = (
        F.col("mean")
        + reverting * (F.col("level") - F.col("mean"))
        + F.col("trend") * DAMPING * (reverting - fading) / (keep - DAMPING)
    )
    floor = F.col("level") * FLOOR_SHARE
    out = prepared.withColumn("floor", floor).withColumn("forecast", F.greatest(path, F.col("floor")))
    doubt = F.col("cv") * (1 + 0.1 * F.sqrt(i)) * F.col("forecast")
    bands = []
    for name, (width, floor_share) in BANDS.items():
        low = F.greatest(F.col("forecast") - width * doubt, F.col("floor") * floor_share)
        bands += [
            low.alias(f"ci_{name}_lower"),
            (F.col("forecast") + width * doubt).alias(f"ci_{name}_upper"),
        ]
    return out.select(*by, "last_time", "step", "forecast", *bands)


def two_series_forecast(weeks: DataFrame, horizon: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Q17: sell-through and order-value forecasts on one Sunday calendar.

    Needs four weeks with both values, else four weeks with any activity; a shorter
    series yields no rows. All four model columns carry the damped-trend forecast.
    """
    both = F.col("qty_depleted").isNotNull() & F.col("order_value").isNotNull()
    active = (F.col("qty_depleted") > 0) | (F.col("order_value") > 0)
    whole = Window.partitionBy(*by)
    complete = F.count_if(both).over(whole)
    usable = weeks.withColumn("_ok", F.when(complete >= 4, both).otherwise(active)).filter("_ok")
    usable = usable.withColumn("_n", F.count(F.lit(1)).over(whole)).filter("_n >= 4")
    usable = usable.na.fill(0, ["qty_depleted", "order_value"])

    def named(prefix: str, value: str) -> DataFrame:
        fc = damped_trend_forecast(usable, "week_start", value, by, horizon)
        return fc.select(
            *by,
            "step",
            F.date_add("last_time", F.col("step") * 7).alias("week_start"),
            *[F.col("forecast").alias(f"{prefix}_{m}") for m in ("ensemble", "lr", "es", "mat")],
            *[F.col(c).alias(f"{prefix}_{c}") for c in fc.columns if c.startswith("ci_")],
        )

    depletion, orders = named("depletion", "qty_depleted"), named("orders", "order_value")
    joined = depletion.join(orders, [*by, "step", "week_start"], "full").drop("step")
    return joined.withColumn("is_forecast", F.lit(True))


def three_model_forecast(
    df: DataFrame, order: str, value: str, by: Sequence[str] = (), weeks: int = 12, smoothing: float = SMOOTHING
) -> DataFrame:
    """Q17: three models and their mean, per series of at least four rows.

    ``lr``: least squares line over the series. ``es``: simple exponential smoothing, a
    fold over the ordered values. ``mat``: mean of the last four rows, moved by their
    weekly change against the four before (from eight rows on). None is below zero. A
    series is folded to one array first; no model needs a window or a second pass."""
    point = F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("v"))
    folded = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(point)).alias("_p"))
    shaped = folded.withColumn("n", F.size("_p")).filter("n >= 4").withColumn("_v", F.transform("_p", lambda p: p["v"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    n = F.col("n").cast("double")
    centred = F.transform("_v", lambda x, i: x * (i - (F.col("n") - 1) / 2.0))
    smoothed = F.aggregate(
        F.slice("_v", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))),
        F.get("_v", F.lit(0)),
        lambda level, x: level * (1 - smoothing) + x * smoothing,
    )
    last4 = total(F.slice("_v", -4, 4)) / 4
    before4 = F.when(F.col("n") >= 8, total(F.slice("_v", F.col("n") - 7, F.lit(4))) / 4)
    fitted = shaped.select(
        *by,
        "n",
        F.array_max(F.transform("_p", lambda p: p["at"])).alias("last_time"),
        (total(F.col("_v")) / n).alias("mean"),
        (total(centred) * 12 / (n * (n * n - 1))).alias("slope"),
        smoothed.alias("_es"),
        last4.alias("_level"),
        F.coalesce((last4 - before4) / 4, F.lit(0.0)).alias("_drift"),
        F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("step"),
    )
    positive = lambda c: F.greatest(F.lit(0.0), c)
    line = F.col("mean") + F.col("slope") * ((F.col("n") - 1) / 2.0 + F.col("step"))
    models = fitted.select(
        *by,
        "last_time",
        "step",
        positive(line).alias("lr"),
        positive(F.col("_es")).alias("es"),
        positive(F.col("_level") + F.col("_drift") * F.col("step")).alias("mat"),
    )
    return models.withColumn("ensemble", (F.col("lr") + F.col("es") + F.col("mat")) / 3)


# -- day-of-week seasonality -------------------------------------------------------

def seasonal_forecast(daily: DataFrame, days: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Q53: last 7-row mean plus a damped 14-row slope, times a day-of-week factor.

    ``daily`` has one row per day (``order_date``, ``revenue``, ``day_of_week`` with
    1 = Sunday). Series under 14 rows yield nothing; factors default to 1.
    """
    ranked = daily.withColumns(
        {"_down": from_end("order_date", by), "_ma": rolling_mean("revenue", "order_date", 7, 1, by)}
    )
    v = F.col("revenue").cast("double")
    recent = F.col("_down") <= SEASONAL_MIN_ROWS
    base = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("overall"),
        F.max("order_date").alias("last_date"),
        F.max(F.when(F.col("_down") == 1, F.col("_ma"))).alias("last_ma"),
        F.regr_slope(F.when(recent, v), F.when(recent, -F.col("_down").cast("double"))).alias("slope"),
    )
    factors = daily.groupBy(*by, F.col("day_of_week").cast("int").alias("_dow")).agg(
        F.avg(v).alias("_dow_mean")
    )
    ahead = base.filter(F.col("n") >= SEASONAL_MIN_ROWS).select(
        *by, "overall", "last_date", "last_ma", "slope",
        F.explode(F.sequence(F.lit(1), F.lit(days))).alias("step"),
    )
    ahead = ahead.withColumn("order_date", F.date_add("last_date", F.col("step")))
    ahead = ahead.withColumn("_dow", F.dayofweek("order_date"))
    joined = ahead.join(factors, [*by, "_dow"], "left")
    factor = F.when(
        (F.col("overall") > 0) & F.col("_dow_mean").isNotNull(), F.col("_dow_mean") / F.col("overall")
    ).otherwise(1.0)
    level = F.col("last_ma") + F.col("slope") * F.col("step") * SEASONAL_TREND_WEIGHT
    return joined.select(
        *by, "order_date", F.greatest(F.lit(0.0), level * factor).alias("forecast_revenue")
    )


def forecast_summary(forecast: DataFrame, days: int = 30) -> DataFrame:
    """Q54: total, daily mean and 30-day run rate of a forecast."""
    total = forecast.agg(F.sum("forecast_revenue").alias("forecast_total"))
    per_day = ratio("forecast_total", F.lit(days))
    return total.select(
        "forecast_total", per_day.alias("daily_average"), (per_day * 30).alias("monthly_run_rate")
    )


def numbered(df: DataFrame, order: str | Column, *ties: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank column over an already limited, sorted result."""
    return df.withColumn("rank", F.row_number().over(series(by, col(order), *ties)))
