import math
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from shelfline.operators import forecasting as fc

SUNDAY = date(2024, 1, 7)
SERIES = "distributor_code string, week_start date, qty_depleted double"


def weeks(values, code="D1"):
    return [(code, SUNDAY + timedelta(weeks=i), float(v)) for i, v in enumerate(values)]


def recursion(y, horizon):
    n, mean = len(y), sum(y) / len(y)
    level = sum(y[-4:]) / 4 if n >= 4 else mean
    start = level
    if n >= 8:
        trend = (sum(y[-4:]) / 4 - sum(y[-8:-4]) / 4) / 4
    elif n >= 4:
        trend = (y[-1] - y[-4]) / 4
    else:
        trend = 0
    path = []
    for _ in range(horizon):
        trend *= 0.92
        level += trend + 0.05 * (mean - level)
        path.append(max(level, 0.5 * start))
    sd = math.sqrt(sum((v - mean) ** 2 for v in y) / n)
    cv = min(sd / mean if mean > 0 else 0.15, 0.25)
    return path, cv, start


def test_closed_form_equals_the_recursion(spark):
    rnd = random.Random(7)
    data, expected = [], {}
    for k, n in enumerate([1, 3, 4, 7, 8, 12, 12, 30]):
        y = [rnd.randint(0, 500) for _ in range(n)]
        if k == 6:
            y = [0] * n
        data += weeks(y, f"S{k}")
        expected[f"S{k}"] = recursion(y, 12)
    df = spark.createDataFrame(data, SERIES)
    out = fc.damped_trend_forecast(df, "week_start", "qty_depleted", ["distributor_code"]).collect()
    assert len(out) == 8 * 12
    for r in out:
        path, cv, start = expected[r["distributor_code"]]
        f, i = path[r["step"] - 1], r["step"]
        assert math.isclose(r["forecast"], f, rel_tol=1e-9, abs_tol=1e-6)
        doubt = cv * (1 + 0.1 * math.sqrt(i)) * f
        assert math.isclose(r["ci_80_lower"], max(f - 0.8 * doubt, 0.4 * start), rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(r["ci_95_upper"], f + 1.2 * doubt, rel_tol=1e-9, abs_tol=1e-6)


HEALTH = (
    "distributor_code string, distributor_name string, vip_codes string, weeks_of_inventory double, "
    "weekly_depletion_rate double, total_qty_ordered bigint, total_qty_depleted bigint"
)


def risk(spark, trend_values, **row):
    base = dict(code="A1", name="n", codes="D1, D2", weeks=None, rate=10.0, ordered=40, depleted=100)
    base.update(row)
    health = spark.createDataFrame(
        [(base["code"], base["name"], base["codes"], base["weeks"], base["rate"], base["ordered"], base["depleted"])],
        HEALTH,
    )
    trends = spark.createDataFrame(weeks(trend_values), SERIES)
    return fc.stockout_risk(health, trends, date(2024, 6, 1)).collect()[0]


def test_trend_needs_eight_weeks_and_variation_four(spark):
    three = risk(spark, [10, 20, 30])
    assert three["velocity_trend_pct"] == 0 and three["velocity_cv"] == 0.2
    seven = risk(spark, [10, 10, 10, 10, 10, 10, 80])
    assert seven["velocity_trend_pct"] == 0 and seven["velocity_cv"] != 0.2
    eight = risk(spark, [10, 10, 10, 10, 20, 20, 20, 20])
    assert eight["velocity_trend_pct"] == 100 and eight["adjusted_weekly_rate"] == 15
    assert math.isclose(eight["weeks_until_stockout"], 40 / 15)
    assert eight["reorder_urgency"] == "CRITICAL" and eight["reorder_qty_suggested"] == 80
    assert eight["predicted_stockout_date"] == date(2024, 6, 1) + timedelta(days=math.floor(40 / 15 * 7))
    assert eight["risk_score"] == 100


def test_risk_without_rate_or_orders(spark):
    none = risk(spark, [0, 0, 0], rate=0.0)
    assert none["reorder_urgency"] == "N/A" and none["risk_score"] == 50 and none["weeks_until_stockout"] is None
    idle = risk(spark, [0, 0, 0], rate=0.0, depleted=0)
    assert idle["risk_score"] == 0
    fallback = risk(spark, [5, 5, 5], ordered=0, weeks=5.0)
    assert fallback["weeks_until_stockout"] == 5.0 and fallback["reorder_urgency"] == "HIGH"


def test_projection_falls_and_stays_at_zero(spark):
    df = spark.createDataFrame(
        [("D1", "n", 30.0, 100), ("D2", "n", 0.0, 5)],
        "distributor_code string, distributor_name string, adjusted_weekly_rate double, qty_ordered_period bigint",
    )
    out = fc.inventory_projection(df, date(2024, 6, 1)).orderBy("distributor_code", "week_number").collect()
    assert [r["projected_inventory"] for r in out[:5]] == [70.0, 40.0, 10.0, 0.0, 0.0]
    assert [r["is_stockout"] for r in out[:4]] == [False, False, False, True]
    assert {r["projected_inventory"] for r in out[12:]} == {5.0}
    by_week = {r["forecast_week"]: r for r in fc.projection_by_week(fc.inventory_projection(df, date(2024, 6, 1))).collect()}
    assert by_week[date(2024, 6, 8)]["total_projected_depletion"] == 30.0
    assert by_week[date(2024, 6, 29)]["distributors_in_stockout"] == 1


def test_two_series_need_four_weeks(spark):
    schema = "week_start date, qty_depleted bigint, order_value double"
    short = [(SUNDAY + timedelta(weeks=i), 5, 1.0) for i in range(3)]
    assert fc.two_series_forecast(spark.createDataFrame(short, schema)).count() == 0
    data = short + [(SUNDAY + timedelta(weeks=3), 9, 2.0), (SUNDAY + timedelta(weeks=4), None, 3.0)]
    out = fc.two_series_forecast(spark.createDataFrame(data, schema)).orderBy("week_start").collect()
    assert len(out) == 12 and out[0]["week_start"] == SUNDAY + timedelta(weeks=4)
    assert out[0]["depletion_ensemble"] == out[0]["depletion_mat"]


def test_seasonal_forecast_matches_a_direct_computation(spark):
    first = date(2024, 1, 1)
    y = [100 + 3 * i + (40 if i % 7 == 5 else 0) for i in range(30)]
    rows = [(first + timedelta(days=i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "order_date date, revenue double").withColumn(
        "day_of_week", F.dayofweek("order_date")
    )
    out = fc.seasonal_forecast(df, 10).orderBy("order_date").collect()
    mean = sum(y) / len(y)
    xs, ys = list(range(14)), y[-14:]
    mx, my = sum(xs) / 14, sum(ys) / 14
    slope = sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / sum((a - mx) ** 2 for a in xs)
    last_ma = sum(y[-7:]) / 7
    for i, r in enumerate(out, start=1):
        day = first + timedelta(days=29 + i)
        same = [v for (d, v) in rows if d.weekday() == day.weekday()]
        factor = (sum(same) / len(same)) / mean
        assert r["order_date"] == day
        assert math.isclose(r["forecast_revenue"], max(0, (last_ma + slope * i * 0.3) * factor), rel_tol=1e-9)
    assert fc.seasonal_forecast(df.filter("order_date < DATE '2024-01-14'"), 10).count() == 0
