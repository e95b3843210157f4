from datetime import date, datetime, timedelta

import json

from pyspark.sql import functions as F

from shelfline.functions import dates
from shelfline.operators import products as prod
from shelfline.operators import sales

DAY = date(2024, 1, 10)


def documents(spark, data):
    rows = [(i, datetime(2024, 1, 10, 20), None if x is None else json.dumps(x)) for i, x in data]
    return spark.createDataFrame(rows, "id string, created_at timestamp, line_items string")


def test_json_items_gross_and_net(spark, rows):
    lime = {"title": "Lime", "sku": "L", "quantity": 2, "price": "10.00", "total_discount": "1.50"}
    data = [
        ("1", [lime, {"title": "Shipping Protection", "sku": "P", "quantity": 1, "price": "2"}]),
        ("2", [dict(lime, quantity=1, total_discount=None)]),
        ("3", []),
        ("4", None),
        ("5", [{"title": None, "sku": "N", "quantity": 1, "price": "5"}]),
        ("6", [{"title": "Zero", "sku": "Z", "quantity": 0, "price": "5"}]),
    ]
    docs = documents(spark, data)
    gross = rows(sales.web_products(docs, DAY, DAY), "product_name")
    assert set(gross) == {"Lime"}
    assert gross["Lime"]["revenue"] == 30.0 and gross["Lime"]["order_count"] == 2
    net = rows(sales.web_products(docs, DAY, DAY, net=True), "product_name")
    assert net["Lime"]["revenue"] == 28.5


def test_local_day_in_winter_and_summer(spark, rows):
    stamps = [datetime(2024, 1, 10, 6, 30), datetime(2024, 1, 10, 8, 30), datetime(2024, 7, 10, 6, 30), datetime(2024, 7, 10, 8, 30)]
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp")
    local = [r["d"] for r in rows(df.select(dates.local_date("t", "America/Los_Angeles").alias("d")))]
    assert local == [date(2024, 1, 9), date(2024, 1, 10), date(2024, 7, 9), date(2024, 7, 10)]


def test_both_week_anchors(spark, rows):
    days = [date(2024, 1, 6), date(2024, 1, 7), date(2024, 1, 8)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    out = rows(df.select(dates.sunday_week("d").alias("s"), dates.monday_week("d").alias("m")))
    assert [r["s"] for r in out] == [date(2023, 12, 31), date(2024, 1, 7), date(2024, 1, 7)]
    assert [r["m"] for r in out] == [date(2024, 1, 1), date(2024, 1, 1), date(2024, 1, 8)]


def test_credits_and_lost_credits(spark, rows):
    def line(amount, name, detail="SalesItemLineDetail"):
        return {"Amount": amount, "DetailType": detail, "SalesItemLineDetail": {"ItemAccountRef": {"name": name}}}

    memos = [
        (DAY, json.dumps([line("5.25", "Income:Refunds"), line("1.00", "Income:Sales")])),
        (DAY, json.dumps([line("2", "Income:Discounts"), line("x", "Income:Refunds"), line("9", "Income:Refunds", "SubTotal")])),
        (DAY + timedelta(days=1), json.dumps([line("3", "Income:Refunds")])),
    ]
    df = spark.createDataFrame(memos, "txn_date date, line string")
    credits = sales.credits_daily(df, DAY, DAY + timedelta(days=5))
    by_day = rows(credits, "credit_date")
    assert by_day[DAY]["credit_amount"] == 7.25
    daily = spark.createDataFrame([(DAY, 100.0)], "order_date date, revenue double")
    assert rows(sales.net_of_credits(daily, credits, "order_date", "credit_date"))[0]["revenue"] == 92.75
    lost = rows(sales.lost_credits(daily, credits, "order_date", "credit_date"))
    assert [(r["credit_date"], r["credit_amount"]) for r in lost] == [(DAY + timedelta(days=1), 3.0)]


def test_hierarchy_rules_and_their_specific_first_variant(spark, rows):
    names = ["12oz Seltzer", "16 oz", "750ml", "Shot", "Black Cherry", "Cranberry", "Spicy Lime 25mg", "5mg", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, product_name string")
    out = rows(prod.with_hierarchy(df), "i")
    family = [out[i]["family"] for i in range(9)]
    assert family == ["Shots", "16oz Seltzers", "Bottles", "Shots", "Other", "Other", "Other", "Other", "Other"]
    assert [out[i]["flavor"] for i in (4, 5, 6, 8)] == ["Cherry", "Berry", "Spicy Lime", "Unknown"]
    assert [out[i]["potency"] for i in (6, 7)] == ["25mg", "5mg"]
    fixed = rows(
        prod.with_hierarchy(
            df, family_rules=prod.SPECIFIC_FIRST_FAMILY_RULES, flavor_rules=prod.SPECIFIC_FIRST_FLAVOR_RULES
        ),
        "i",
    )
    assert fixed[0]["family"] == "12oz Seltzers" and fixed[5]["flavor"] == "Cranberry"


def test_month_over_month_clamps_and_rolls_the_year(spark, rows):
    def daily(values):
        return spark.createDataFrame(values, "order_date date, revenue double")

    march = daily([(date(2024, 2, 29), 10.0), (date(2024, 2, 1), 5.0), (date(2024, 3, 31), 30.0), (date(2024, 1, 31), 99.0)])
    out = rows(sales.same_day_month_over_month(march, date(2024, 3, 31)))[0]
    assert (out["current_month"], out["last_month"], out["mom_pct"]) == (30.0, 15.0, 100.0)
    january = daily([(date(2023, 12, 16), 9.0), (date(2023, 12, 15), 4.0), (date(2024, 1, 2), 2.0)])
    out = rows(sales.same_day_month_over_month(january, date(2024, 1, 15)))[0]
    assert (out["current_month"], out["last_month"], out["mom_pct"]) == (2.0, 4.0, -50.0)
    empty = rows(sales.same_day_month_over_month(january, date(2025, 6, 1)))[0]
    assert empty["mom_pct"] is None


def test_rollup_levels_add_up(tables, rows):
    from shelfline.plans.sales import _sku_sales

    out = rows(prod.hierarchy_rollup(_sku_sales(tables)).groupBy("level").agg(F.sum("units").alias("u")), "level")
    assert len(out) == 5 and len({r["u"] for r in out.values()}) == 1
