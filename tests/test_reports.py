from datetime import date, datetime

from pyspark.sql import functions as F

from shelfline.functions import columns as c
from shelfline.operators import accounts as acc
from shelfline.operators import quality as dq
from shelfline.operators import scorecard as sc
from shelfline.operators import trends as tr

TODAY = date(2024, 1, 31)
METRICS = [
    sc.Metric("store_revenue", "Store Revenue", "A", 100, "currency", "auto", "max", True),
    sc.Metric("web_revenue", "Web Revenue", "A", 100, "currency", "auto", "sum", True),
    sc.Metric("open_outlets", "Open Outlets", "A", 10, "number", "auto", "latest"),
    sc.Metric("newsletter_readers", "Newsletter Readers", "B", 10, "number", "auto", "latest"),
    sc.Metric("blog_articles", "Blog Articles", "B", 250, "number", "sheet", "latest"),
    sc.Metric("trade_fairs", "Trade Fairs", "C", 5, "number", "sheet", "sum"),
    sc.Metric("samples_sent", "Samples Sent", "C", 5, "number", "sheet", "sum"),
]


def test_sheet_parsing(spark):
    columns = [*sc.SHEET_FIXED, "1/1", "1/8", "13/40", "note", "position"]
    data = [
        ("Store Revenue (est)", "x", "1", "$1,234", "12%", "$1,234", "0", "7", "z", "1"),
        ("newsletter", "x", "1", "n/a", "", "12%", "0.0", "7", "z", "2"),
        ("", "x", "1", "5", "", "5", "5", "7", "z", "3"),
        ("Nothing we know", "x", "1", "5", "", "5", "5", "7", "z", "4"),
        ("Samples Sent", "x", "1", "5", "", "1", "2", "7", "z", "5"),
        ("SAMPLES SENT", "x", "1", "6", "", "3", "", "7", "z", "6"),
    ]
    sheet = spark.createDataFrame(data, ", ".join(f"`{x}` string" for x in columns))
    values = {(r["key"], r["week"]): r["value"] for r in sc.sheet_values(sheet, 2024, METRICS, position="position").collect()}
    assert values == {
        ("store_revenue", date(2024, 1, 1)): 1234.0,
        ("newsletter_readers", date(2024, 1, 8)): 0.0,
        ("samples_sent", date(2024, 1, 1)): 3.0,
    }
    totals = {r["key"]: r["sheet_total"] for r in sc.sheet_totals(sheet, METRICS, position="position").collect()}
    assert totals == {"store_revenue": 1234.0, "samples_sent": 6.0}


def test_grid_prefers_live_and_cards_follow_their_rule(spark):
    schedule = [date(2024, 1, 1), date(2024, 1, 8), date(2024, 1, 15)]
    pair = "key string, week date, value double"
    live = spark.createDataFrame(
        [("store_revenue", date(2024, 1, 1), 10.0), ("store_revenue", date(2023, 12, 25), 99.0)], pair
    )
    written = spark.createDataFrame(
        [("store_revenue", date(2024, 1, 1), 1.0), ("store_revenue", date(2024, 1, 8), 20.0),
         ("open_outlets", date(2024, 1, 3), 5.0), ("trade_fairs", date(2024, 1, 1), 2.0),
         ("trade_fairs", date(2024, 1, 8), 2.0), ("trade_fairs", date(2024, 2, 8), 50.0)],
        pair,
    )
    now = spark.createDataFrame([("open_outlets", 8.0), ("page_trackers", 0.0)], "key string, value double")
    as_of = date(2024, 1, 10)
    grid = sc.metric_grid(live, now, written, schedule, as_of, METRICS)
    cells = {(r["key"], r["week"]): r["value"] for r in grid.collect()}
    assert cells[("store_revenue", date(2024, 1, 1))] == 10.0
    assert ("store_revenue", date(2023, 12, 25)) not in cells
    assert cells[("open_outlets", date(2024, 1, 8))] == 8.0
    totals = spark.createDataFrame([("blog_articles", 200.0)], "key string, sheet_total double")
    card = {r["key"]: r for r in sc.metric_scorecard(sc.registry_frame(spark, METRICS), grid, totals, as_of).collect()}
    assert card["store_revenue"]["value"] == 20.0
    assert card["open_outlets"]["value"] == 8.0
    assert (card["trade_fairs"]["value"], card["trade_fairs"]["band"]) == (4.0, "green")
    assert card["blog_articles"]["value"] == 200.0
    assert card["web_revenue"]["value"] is None and card["web_revenue"]["band"] == "red"


def test_follower_counts(spark):
    data = [
        (0, '<meta content="Us: 1,234 followers on LinkedIn">'), (1, "77.5K Followers"), (2, "1.2M followers"),
        (3, "no count"), (4, "950 Followers"),
    ]
    df = spark.createDataFrame([(i, "u", h) for i, h in data], "page_id int, url string, html string")
    out = {r["page_id"]: (r["exact_count"], r["abbreviated_count"]) for r in sc.follower_counts(df).collect()}
    assert out == {0: (1234, 1234), 1: (None, 77500), 2: (None, 1200000), 3: (None, None), 4: (None, 950)}


DOOR = (
    "vip_id string, chain_name string, channel_type string, qty_last_30_days bigint, qty_previous_30_days bigint, "
    "qty_last_90_days bigint, qty_previous_90_days bigint"
)
MONTHS = [f"m{i}" for i in range(12)]


def test_scorecard_kpis(spark):
    doors = spark.createDataFrame(
        [("a", "x", "Off-Premise", 5, 0, 5, 0), ("b", "x", "On-Premise", 0, 4, 4, 10), ("c", "x", "Off-Premise", 3, 3, 9, 3),
         ("c", "x", "On-Premise", 0, 0, 0, 0), ("d", "y", "Off-Premise", 0, 0, 0, 7)],
        DOOR,
    )
    sku = lambda v, i, now, before: (v, "x", i, *[0] * 6, before, 0, 0, now, 0, 0)
    skus = spark.createDataFrame(
        [sku("a", "i1", 1, 0), sku("a", "i2", 2, 1), sku("a", "i2", 2, 1), sku("b", "i1", 1, 0)],
        "vip_id string, chain_name string, item_code string, " + ", ".join(f"{m} bigint" for m in MONTHS),
    )
    out = {r["kpi"]: (r["current"], r["prior"]) for r in acc.scorecard(doors, skus, MONTHS).collect()}
    assert out["Depletions"] == (18.0, 20.0)
    assert out["Accounts Buying"] == (3.0, 3.0)
    assert out["SKUs per Account"] == (1.5, 1.0)
    assert out["Velocity per Account"] == (6.0, 20 / 3)
    assert out["Off-Premise Buying %"] == (2 / 3 * 100, 2 / 3 * 100)
    assert out["Reorder Rate"] == (1 / 3 * 100, 1 / 3 * 100)
    universe = spark.createDataFrame(
        [(100.0, 0.0, 10, 0)],
        "l90d_volume double, prior_90d_volume double, l90d_active_doors bigint, prior_90d_active_doors bigint",
    )
    over = {r["kpi"]: (r["current"], r["prior"]) for r in acc.scorecard(doors, skus, MONTHS, universe).collect()}
    assert over["Depletions"] == (100.0, 20.0) and over["Velocity per Account"][0] == 10.0
    chain = {r["kpi"]: (r["current"], r["prior"]) for r in acc.scorecard(doors, skus, MONTHS, universe, "x").collect()}
    assert chain["Depletions"] == (18.0, 13.0)


def test_variance_without_a_prior(spark):
    df = spark.createDataFrame([("a", 5.0, 0.0), ("b", 0.0, 0.0), ("c", 5.0, 10.0)], "kpi string, current double, prior double")
    out = {r["kpi"]: r for r in acc.variance(df).collect()}
    assert (out["a"]["pct_label"], out["a"]["current_bar"], out["a"]["prior_bar"]) == ("New", 100.0, 0.0)
    assert out["b"]["pct_label"] == "—" and out["b"]["change_class"] == "neutral"
    assert (out["c"]["pct_change"], out["c"]["pct_class"], out["c"]["current_bar"]) == (-50.0, "neg", 50.0)


def test_symmetry_guard(spark):
    data = [("a", "5", None, False), ("b", "5", "0", False), ("c", "0", "0", False), ("d", "5", None, True),
            ("e", "text", None, False), ("f", "5", "text", False), ("g", "5", "2", None)]
    df = spark.createDataFrame(data, "name string, current string, prior string, allow_missing_prior boolean")
    assert {r["name"] for r in dq.symmetry_breaks(df).collect()} == {"a", "b", "f"}
    out = dq.all_checks_pass(df).collect()[0]
    assert (out["checks"], out["broken"], out["passed"]) == (7, 3, False)


def test_match_rate_and_duplicates(spark):
    accounts = spark.createDataFrame(
        [("One", "D1", "N"), ("Two", "D2", "N"), ("Three", "D3", "S"), ("Four", "D4", "S")],
        "account_name string, code string, state string",
    )
    mapping = spark.createDataFrame(
        [("D1", "A", None), ("D1", "B", None), ("D2", None, "P"), ("D3", None, None)],
        "code string, account_id string, parent_account_id string",
    )
    rates = {r["state"]: r["match_rate_pct"] for r in dq.match_rate(accounts, mapping, "state").collect()}
    assert rates == {"N": 100.0, "S": 0.0}
    assert {r["code"] for r in dq.unmatched_accounts(accounts, mapping).collect()} == {"D3", "D4"}
    names = spark.createDataFrame([("Acme, Inc.", "1"), ("  acme inc ", "2"), ("Beta", "3")], "n string, c string")
    out = dq.duplicate_groups(names, "n", "c").collect()
    assert [(r["name_key"], r["copies"]) for r in out] == [("acme inc", 2)]


def mentions(spark, data):
    rows = [(e, "brand", s, f"u{i}", "t", "s", datetime(2024, 1, d, 5)) for i, (e, s, d) in enumerate(data)]
    return spark.createDataFrame(
        rows,
        "entity_name string, entity_type string, source_engine string, url string, title string, snippet string, harvested_at timestamp",
    )


def test_growth_falls_back_to_the_count(spark):
    data = [("new", "google", 30)] * 3 + [("old", "google", 30)] * 4 + [("old", "bing", 10)] * 6 + [("old", "bing", 3)]
    shown = tr.growth_display(tr.trending(mentions(spark, data), TODAY, ["brand"]))
    out = {r["entity_name"]: r for r in shown.collect()}
    assert (out["new"]["growth_rate"], out["new"]["display_kind"], out["new"]["display_value"]) == (3.0, "mentions", 3.0)
    assert out["old"]["prior_avg_7d"] == 2.0 and out["old"]["growth_rate"] == 1.0
    assert out["old"]["display_kind"] == "percent"
    assert tr.headline_mover(mentions(spark, data), TODAY).collect()[0]["is_bootstrap"] is True


def test_first_frame_wins_per_key(spark):
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    two = spark.createDataFrame([("a", 2), ("c", 2)], "k string, v int")
    out = {r["k"]: r["v"] for r in tr.first_of_each([one, two], "k").collect()}
    assert out == {"a": 1, "b": 1, "c": 2}


def test_phrases_of_whole_texts(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([(long,), ("One, two! THREE",), ("single",), ("",)], "text string")
    out = tr.phrase_rows(df, "text")
    assert out.count() == 4999 + 4998 + 3
    assert {r["ngram"] for r in out.filter("ngram LIKE 'one%' OR ngram LIKE 'two%'").collect()} == {
        "one two", "two three", "one two three",
    }


def test_money_and_magnitude_texts(spark):
    df = spark.createDataFrame([("$1,234.5", "77.5K"), ("12%", "1,200"), ("x", "")], "m string, n string")
    out = df.select(c.money_text("m").alias("m"), c.abbreviated_count("n").alias("n")).collect()
    assert [r["m"] for r in out] == [1234.5, 12.0, None]
    assert [r["n"] for r in out] == [77500, 1200, None]


def test_quotients_below_a_tie_round_up(spark):
    df = spark.createDataFrame([(1393860.45, 6), (1.0, 0)], "a double, b int")
    out = df.select(c.ratio("a", "b", 2).alias("r")).collect()
    assert [r["r"] for r in out] == [232310.08, None]


def test_cent_sums_do_not_depend_on_order(spark):
    df = spark.range(20000).select(((F.col("id") % 97) / 100 + 0.01).alias("v"))
    total = lambda d: d.agg(c.money_sum("v").alias("s")).collect()[0]["s"]
    assert total(df.repartition(7)) == total(df.orderBy(F.col("v").desc())) == total(df.coalesce(1))
