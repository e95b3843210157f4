from datetime import date, timedelta

from pyspark.sql import functions as F

from shelfline.operators import inventory as inv

RAW = "dist_code string, item_code string, acct_code string, uom string, qty string, invoice_date string"
ITEM = "supplier_item string, desc string, brand_desc string, units string, category string, extracted_at timestamp"
DIST = (
    "distributor_code string, distributor_name string, sf_account_id string, parent_sf_account_id string, "
    "is_parent_rollup boolean, total_retailers bigint"
)
LINE = (
    "order_id string, account_id string, customer_name string, account_type string, order_status string, "
    "pricebook_name string, sku string, quantity string, line_total_price double, order_date date"
)
TODAY = date(2024, 3, 31)


def ts(text):
    from datetime import datetime

    return datetime.fromisoformat(text)


def items(spark, extra=()):
    base = [("A", "Lime Seltzer", "b", "24", None, ts("2024-01-01T00:00:00"))]
    return inv.current_items(spark.createDataFrame(base + list(extra), ITEM))


def raw(spark, data):
    return spark.createDataFrame(data, RAW)


def order(spark, data):
    return spark.createDataFrame(data, LINE)


def test_units_of_measure_and_unusable_rows(spark, rows):
    data = [
        ("D1", "A", "S1", "C", "2", "20240301"),
        ("D1", "A", "S1", "B", "5", "20240301"),
        ("D1", "A", "S2", "X", "1", "20240301"),
        ("D1", "Z", "S2", None, "1", "20240301"),
        ("D1", "A", "S3", "C", "abc", "20240301"),
        ("D1", "A", "S3", "C", "-3", "20240301"),
        ("D1", "A", "S3", "C", "0", "20240301"),
        ("D1", "A", "S3", "C", "1", "20260231"),
        ("D1", "99Z1", "S3", "C", "1", "20240301"),
        ("D1", "XXXXXX", "S3", "C", "1", "20240301"),
    ]
    lines = inv.sell_through_lines(raw(spark, data))
    out = rows(inv.distributor_depletion(lines, items(spark), TODAY, 90))[0]
    assert out["qty_depleted"] == 2 * 24 + 5 + 24 + 6
    assert out["stores_reached"] == 2
    assert out["transaction_count"] == 4
    assert out["weekly_depletion_rate"] == out["qty_depleted"] / (90 / 7.0)


def test_newest_item_version_wins_and_ties_are_stable(spark, rows):
    same = ts("2024-02-01T00:00:00")
    extra = [
        ("A", "new", "b", "12", None, ts("2024-05-01T00:00:00")),
        ("T", "x", "b", "10", None, same),
        ("T", "y", "b", "11", None, same),
        ("N", "x", "b", "many", None, same),
        (None, "x", "b", "1", None, same),
    ]
    out = rows(items(spark, extra), "item_code")
    assert out["A"]["units_per_case"] == 12 and out["A"]["item_desc"] == "new"
    assert out["T"]["units_per_case"] == 11
    assert out["N"]["units_per_case"] is None
    assert None not in out


def test_a_sku_listed_twice_repeats_its_lines(spark, rows):
    data = [
        ("1", "A1", "Acme", "Distributor", "Activated", None, "K", "3", 10.0, TODAY),
        ("2", "A1", "Acme", "Distributor", "Activated", "Sample", "K", "3", 10.0, TODAY),
        ("3", "A1", "Acme", "Distributor", "Cancelled", None, "K", "3", 10.0, TODAY),
        ("4", "A1", "Acme", "Retailer", "Activated", None, "K", "3", 10.0, TODAY),
        ("5", "A1", "Acme", "Distributor", "Activated", None, "U", "4", 1.0, TODAY - timedelta(days=91)),
        ("6", "A1", "Acme", "Distributor", "Activated", "Standard", "U", "4", 1.0, TODAY - timedelta(days=90)),
    ]
    skus = spark.createDataFrame([("K", 6), ("K", 12)], "sf_sku string, pack_size bigint")
    out = rows(inv.distributor_order_totals(order(spark, data), skus, TODAY))[0]
    assert (out["qty_ordered_cases"], out["qty_ordered"]) == (3 * 2 + 4, 3 * 18 + 4)
    assert (out["order_value"], out["order_count"]) == (21.0, 2)
    revenue = rows(inv.all_channel_revenue(order(spark, data), TODAY))[0]
    # cancelled and retailer orders count, the SKU map does not multiply
    assert revenue["total_revenue"] == 31.0


ROLLUP = [
    ("D1", "one", "A1", "P1", False, 5),
    ("D2", "two", "A2", "P1", False, 6),
    ("D3", "three", "A3", None, False, 7),
    ("D4", "four", None, None, False, 8),
    ("D5", "five", "A5", "A5", False, 9),
    ("D6", "six", "A1", "P1", True, 9),
]


def depletion_frame(spark, data):
    return spark.createDataFrame(
        data,
        "distributor_code string, qty_depleted bigint, stores_reached bigint, transaction_count bigint, weekly_depletion_rate double",
    )


def totals_frame(spark, data):
    return spark.createDataFrame(
        [(a, a, q, q, float(q), 1, TODAY) for a, q in data],
        "account_id string, distributor_name string, qty_ordered_cases bigint, qty_ordered bigint, "
        "order_value double, order_count bigint, last_order_date date",
    )


def test_parent_rollup_and_sell_through_only(spark, rows):
    distributors = spark.createDataFrame(ROLLUP, DIST)
    sold = depletion_frame(spark, [(f"D{i}", 10 * i, 1, 1, 1.0) for i in range(1, 7)])
    totals = totals_frame(spark, [("P1", 100), ("A1", 50), ("A9", 5), ("A5", 7)])
    rolled = rows(inv.parent_rollup(totals, distributors, sold), "account_id")
    assert rolled["P1"]["vip_codes"] == "D1, D2" and rolled["P1"]["total_qty_depleted"] == 30
    assert rolled["A1"]["vip_codes"] == "D1" and rolled["A1"]["total_qty_depleted"] == 10
    # both ids on one distributor match once
    assert rolled["A5"]["total_qty_depleted"] == 50
    assert rolled["A9"]["has_vip_match"] is False and rolled["A9"]["vip_codes"] is None
    alone = rows(inv.sell_through_only(totals, distributors, sold), "account_id")
    assert set(alone) == {"D3", "D4"}
    assert alone["D4"]["qty_ordered"] == 0 and alone["D4"]["total_qty_depleted"] == 40


def test_status_ladder_edges(spark, rows):
    data = [(69, 100), (70, 100), (130, 100), (131, 100), (5, 0), (0, 5), (0, 0)]
    df = spark.createDataFrame(data, "o bigint, d bigint")
    status = inv.stock_status(F.col("o"), F.col("d"), "No Depletion Data", "No Recent Orders")
    out = [r["s"] for r in rows(df.select(status.alias("s")))]
    assert out == [
        "Understock", "Balanced", "Balanced", "Overstock", "No Depletion Data", "No Recent Orders", "No Data",
    ]


def test_family_rule_precedence(spark, rows):
    data = [("a Seltzer", 6), ("16 oz", 24), ("16 oz", 12), ("2 oz", 36), ("750 bottle", 6), ("70 ml", 6), (None, 6)]
    df = spark.createDataFrame(data, "desc string, units bigint")
    out = [r["f"] for r in rows(df.select(inv.product_family(F.col("desc"), F.col("units")).alias("f")))]
    assert out == ["Cans", "Cans", "Other", "Shots", "Bottles", "Bottles", "Other"]


def test_totals_agree_between_grains(tables, rows):
    from shelfline.plans import inputs

    by_code = rows(inputs.depletion(tables).agg(F.sum("qty_depleted").alias("q")))[0]["q"]
    by_product = rows(inputs.products(tables).agg(F.sum("qty_depleted").alias("q")))[0]["q"]
    by_state = rows(inputs.states(tables).agg(F.sum("total_depleted").alias("q")))[0]["q"]
    assert by_code == by_product == by_state


def test_hot_item_reaches_the_lookup_once_per_key(spark, rows):
    data = [("D1", "HOT", f"S{i % 7}", "C", "1", "20240301") for i in range(2000)]
    data += [("D2", f"I{i}", "S1", "B", "1", "20240301") for i in range(100)]
    lines = inv.sell_through_lines(raw(spark, data))
    grain = inv.depletion_by(lines, items(spark), ["dist_code"])
    assert grain.filter("item_code = 'HOT'").count() == 1
    out = rows(inv.distributor_depletion(lines, items(spark), TODAY), "distributor_code")
    assert out["D1"]["qty_depleted"] == 2000 * 6 and out["D1"]["stores_reached"] == 7


def test_heat_map_drops_discontinued_and_outliers(spark, rows):
    data = [
        ("a", "5mg 2oz Shot", 4.0, 10.0), ("a", "5mg 2oz Shot", 8.0, 10.0), ("a", "25mg 2oz Shot", 9.0, 99.0),
        ("b", "5mg 12oz Seltzer", 53.0, 500.0), ("b", "10mg 2oz Shot", None, 1.0), ("c", "2mg 750ml Bottle", -52.0, 1.0),
    ]
    df = spark.createDataFrame(
        data, "distributor_name string, product_category string, weeks_of_inventory double, order_value double"
    )
    out = rows(inv.weeks_heat_map(df), "distributor_name")
    assert set(out) == {"a", "c"}
    assert out["a"]["5mg Shot"] == 6.0 and out["a"]["5mg Seltzer"] == 0.0
    assert out["c"]["2mg Bottle"] == -52.0
