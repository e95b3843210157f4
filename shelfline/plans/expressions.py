"""One small query per aggregate, window and scalar-function primitive."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.functions import columns as c
from shelfline.functions import dates as d
from shelfline.functions import windows as w
from shelfline.operators import accounts as acc
from shelfline.operators import inventory as inv
from shelfline.operators import products as prod
from shelfline.operators.forecasting import numbered
from shelfline.plans.accounts import OWNER
from shelfline.plans.inputs import sold_lines
from shelfline.plans.registry import query
from shelfline.plans.vocabulary import CENTS, MONTHLY, monthly, order_day
from shelfline.sources import roles

def whole_quantity():
    return F.col("l_quantity").cast("bigint")


# -- aggregates ------------------------------------------------------------------------

@query(
    "A01_grouped_aggregates",
    f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty,
  {CENTS.format('l_extendedprice')} AS revenue, avg(CAST(l_quantity AS BIGINT)) AS avg_qty, min(l_shipdate) AS first_ship,
  max(l_shipdate) AS last_ship, count(*) AS lines FROM lineitem GROUP BY 1, 2""",
    rounded=["avg_qty"],
)
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(whole_quantity()).alias("sum_qty"),
        c.money_sum("l_extendedprice").alias("revenue"),
        F.avg(whole_quantity()).alias("avg_qty"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.count(F.lit(1)).alias("lines"),
    )


@query(
    "A02_count_distinct",
    "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1",
)
def _(t):
    # Each count folds to its pairs first: no copy of every row per distinct column.
    parts = t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))
    orders = t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"))
    return parts.join(orders, "l_suppkey")


@query(
    "A03_count_distinct_pairs",
    """SELECT dist_code, count(DISTINCT acct_code || '|' || item_code) AS pods FROM sell_through_raw GROUP BY 1""",
)
def _(t):
    return roles.sell_through_raw(t).groupBy("dist_code").agg(
        F.countDistinct("acct_code", "item_code").alias("pods")
    )


@query(
    "A04_count_if",
    "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders",
)
def _(t):
    return t.orders.agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"),
        F.count_if(F.col("o_totalprice") > 200000).alias("large"),
    )


@query(
    "A05_sum_case",
    """SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS returned
FROM lineitem GROUP BY 1""",
)
def _(t):
    returned = F.when(F.col("l_returnflag") == "R", whole_quantity()).otherwise(0)
    return t.lineitem.groupBy("l_suppkey").agg(F.sum(returned).alias("returned"))


@query(
    "A06_avg_case",
    "SELECT event_type, avg(CASE WHEN value > 10 THEN value END) AS avg_large FROM events GROUP BY 1",
    rounded=["avg_large"],
)
def _(t):
    return t.events.groupBy("event_type").agg(
        F.avg(F.when(F.col("value") > 10, F.col("value"))).alias("avg_large")
    )


@query(
    "A07_guarded_ratio",
    """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS ratio
FROM orders GROUP BY 1""",
    rounded=["ratio"],
)
def _(t):
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.groupBy("o_custkey").agg(c.ratio(of("F"), of("O")).alias("ratio"))


@query(
    "A08_global_aggregate",
    f"SELECT count(*) AS orders, {CENTS.format('o_totalprice')} AS revenue, count(DISTINCT o_custkey) AS buyers FROM orders",
)
def _(t):
    return t.orders.agg(
        F.count(F.lit(1)).alias("orders"),
        c.money_sum("o_totalprice").alias("revenue"),
        F.countDistinct("o_custkey").alias("buyers"),
    )


@query(
    "A09_two_level",
    """SELECT n_name, CAST(sum(parts) AS BIGINT) AS parts, count(*) AS suppliers FROM (
  SELECT s_nationkey, l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
  JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
)
def _(t):
    per_supplier = t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))
    located = per_supplier.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    named = located.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(F.sum("parts").alias("parts"), F.count(F.lit(1)).alias("suppliers"))


@query(
    "A10_approx_quantile",
    "SELECT o_orderpriority, count(*) AS orders, quantile_disc(o_totalprice, 0.5) AS median, TRUE AS within_bound FROM orders GROUP BY 1",
)
def _(t):
    # An approximate median is right if its rank is off by at most 1 / accuracy of the group.
    accuracy = 100_000
    median = t.orders.groupBy("o_orderpriority").agg(F.percentile_approx("o_totalprice", 0.5, accuracy).alias("median"))
    below = t.orders.join(median, "o_orderpriority").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"),
        F.first("median").alias("median"),
        F.count_if(F.col("o_totalprice") < F.col("median")).alias("lower"),
        F.count_if(F.col("o_totalprice") <= F.col("median")).alias("up_to"),
    )
    slack = F.col("orders") / accuracy + 1
    middle = F.col("orders") / 2
    within = (F.col("lower") <= middle + slack) & (F.col("up_to") >= middle - slack)
    return below.select("o_orderpriority", "orders", "median", within.alias("within_bound"))


@query(
    "A11_string_agg_distinct",
    "SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ', ') AS segments FROM customer GROUP BY 1",
)
def _(t):
    return t.customer.groupBy("c_nationkey").agg(c.distinct_list("c_mktsegment").alias("segments"))


@query(
    "A12_group_by_expression",
    "SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, count(*) AS orders FROM orders GROUP BY 1",
)
def _(t):
    return t.orders.groupBy(d.quarter_label(order_day()).alias("quarter")).agg(F.count(F.lit(1)).alias("orders"))


@query("A13_distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def _(t):
    return t.customer.select("c_mktsegment", "c_nationkey").distinct()


@query(
    "A14_value_counts",
    "SELECT p_type, count(*) AS count, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1",
)
def _(t):
    return t.part.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("count"), F.countDistinct("p_brand").alias("brands")
    )


@query(
    "A15_named_predicates",
    """SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 5000) AS rich, count(*) FILTER (WHERE c_acctbal < 500) AS poor,
  count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1""",
)
def _(t):
    return t.customer.groupBy("c_nationkey").agg(
        F.count_if(F.col("c_acctbal") > 5000).alias("rich"),
        F.count_if(F.col("c_acctbal") < 500).alias("poor"),
        F.countDistinct("c_mktsegment").alias("segments"),
    )


@query(
    "A16_pivot",
    """SELECT event_type, count(*) FILTER (WHERE user_id % 3 = 0) AS g0, count(*) FILTER (WHERE user_id % 3 = 1) AS g1,
  count(*) FILTER (WHERE user_id % 3 = 2) AS g2 FROM events GROUP BY 1""",
)
def _(t):
    group = F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string"))
    wide = t.events.withColumn("g", group).groupBy("event_type").pivot("g", ["g0", "g1", "g2"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@query("A17_arg_max", OWNER)
def _(t):
    return acc.chain_owner(roles.door(t))


@query(
    "A18_standard_deviations",
    "SELECT event_type, stddev_samp(value) AS sample_sd, stddev_pop(value) AS population_sd FROM events GROUP BY 1",
    rounded=["sample_sd", "population_sd"],
)
def _(t):
    return t.events.groupBy("event_type").agg(
        F.stddev_samp("value").alias("sample_sd"), F.stddev_pop("value").alias("population_sd")
    )


@query(
    "A19_slope",
    "SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope FROM lineitem GROUP BY 1",
    rounded=["slope"],
    digits=4,
)
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"))


@query(
    "A20_end_means",
    f"""SELECT avg(orders) FILTER (WHERE up <= 4) AS first4, avg(orders) FILTER (WHERE down <= 4) AS last4
FROM (SELECT *, row_number() OVER (ORDER BY month) AS up, row_number() OVER (ORDER BY month DESC) AS down FROM ({MONTHLY}))""",
)
def _(t):
    numbered_months = monthly(t).withColumns({"up": w.from_start("month"), "down": w.from_end("month")})
    return numbered_months.agg(
        F.avg(F.when(F.col("up") <= 4, F.col("orders"))).alias("first4"),
        F.avg(F.when(F.col("down") <= 4, F.col("orders"))).alias("last4"),
    )


@query(
    "A21_sum_many_columns",
    f"""SELECT 'o_totalprice' AS col, {CENTS.format('o_totalprice')} AS total FROM orders
UNION ALL SELECT 'o_custkey', CAST(sum(o_custkey) AS DOUBLE) FROM orders""",
)
def _(t):
    sums = t.orders.agg(
        c.money_sum("o_totalprice").alias("o_totalprice"),
        F.sum("o_custkey").cast("double").alias("o_custkey"),
    )
    return sums.unpivot([], ["o_totalprice", "o_custkey"], "col", "total")


# -- windows ---------------------------------------------------------------------------------

@query(
    "W01_latest_per_key",
    "SELECT item_code, item_desc, brand_desc, category, units_per_case FROM item_now",
)
def _(t):
    return inv.current_items(roles.item(t)).drop("product_family")


@query(
    "W02_trailing_mean",
    f"SELECT month, avg(orders) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ma4 FROM ({MONTHLY})",
    rounded=["ma4"],
)
def _(t):
    return monthly(t).select("month", w.rolling_mean("orders", "month", 4, 1).alias("ma4"))


@query("W03_lag", f"SELECT month, lag(orders, 4) OVER (ORDER BY month) AS before FROM ({MONTHLY})")
def _(t):
    return monthly(t).select("month", w.lagged("orders", 4, "month").alias("before"))


def _rolling_sql(need: int) -> str:
    return f"""SELECT month, CASE WHEN count(orders) OVER w >= {need} THEN avg(orders) OVER w END AS ma7 FROM ({MONTHLY})
WINDOW w AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""


@query("W04_full_window_mean", _rolling_sql(7), rounded=["ma7"])
def _(t):
    return monthly(t).select("month", w.rolling_mean("orders", "month", 7).alias("ma7"))


@query("W05_min_periods_mean", _rolling_sql(2), rounded=["ma7"])
def _(t):
    return monthly(t).select("month", w.rolling_mean("orders", "month", 7, 2).alias("ma7"))


PRIORITY_MONTHS = """SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders
FROM orders GROUP BY 1, 2"""


def priority_months(t):
    return t.orders.groupBy("o_orderpriority", d.month_start(order_day()).alias("month")).agg(
        F.count(F.lit(1)).alias("orders")
    )


@query(
    "W06_running_total",
    f"""SELECT o_orderpriority, month, CAST(sum(orders) OVER (PARTITION BY o_orderpriority ORDER BY month
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM ({PRIORITY_MONTHS})""",
)
def _(t):
    total = w.running_total("orders", "month", ["o_orderpriority"])
    return priority_months(t).select("o_orderpriority", "month", total.alias("running"))


@query(
    "W07_rank_sorted",
    f"""SELECT *, CAST(row_number() OVER (ORDER BY revenue DESC, o_custkey) AS INTEGER) AS rank FROM (
  SELECT o_custkey, {CENTS.format('o_totalprice')} AS revenue FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)""",
)
def _(t):
    totals = t.orders.groupBy("o_custkey").agg(c.money_sum("o_totalprice").alias("revenue"))
    best = totals.orderBy(F.col("revenue").desc(), "o_custkey").limit(50)
    return numbered(best, F.col("revenue").desc(), "o_custkey")


@query(
    "W08_positions",
    f"""SELECT o_orderpriority, month, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) AS INTEGER) AS up,
  CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY month DESC) AS INTEGER) AS down FROM ({PRIORITY_MONTHS})""",
)
def _(t):
    by = ["o_orderpriority"]
    up, down = w.from_start("month", by), w.from_end("month", by)
    return priority_months(t).select("o_orderpriority", "month", up.alias("up"), down.alias("down"))


@query(
    "W09_share_of_parent",
    """SELECT *, customers / sum(customers) OVER (PARTITION BY c_nationkey) AS share FROM (
  SELECT c_nationkey, c_mktsegment, count(*) AS customers FROM customer GROUP BY 1, 2)""",
    rounded=["share"],
)
def _(t):
    counts = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    return counts.withColumn("share", w.share_of("customers", ["c_nationkey"]))


# -- scalar functions ----------------------------------------------------------------------------

@query("F01_casts", "SELECT supplier_item, TRY_CAST(units AS BIGINT) AS units, CAST(substr(supplier_item, 2) AS BIGINT) AS number FROM item")
def _(t):
    return roles.item(t).select(
        "supplier_item",
        F.col("units").try_cast("bigint").alias("units"),
        F.substring("supplier_item", 2, 20).cast("bigint").alias("number"),
    )


@query("F02_parse_date", "SELECT CAST(try_strptime(invoice_date, '%Y%m%d') AS DATE) AS day, count(*) AS lines FROM sell_through_raw GROUP BY 1")
def _(t):
    day = F.try_to_date("invoice_date", "yyyyMMdd").alias("day")
    return roles.sell_through_raw(t, with_account=False).groupBy(day).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "F03_truncate_dates",
    """SELECT o_orderkey, CAST(o_orderdate - to_days(CAST(dayofweek(o_orderdate) AS INTEGER)) AS DATE) AS sunday,
  CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        d.sunday_week(order_day()).alias("sunday"),
        d.monday_week(order_day()).alias("monday"),
        d.month_start(order_day()).alias("month"),
        d.quarter_start(order_day()).alias("quarter"),
    )


@query(
    "F04_shift_dates",
    """SELECT o_orderkey, CAST(o_orderdate - INTERVAL 30 DAY AS DATE) AS before, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month FROM orders""",
)
def _(t):
    return t.orders.select("o_orderkey", F.date_sub(order_day(), 30).alias("before"), F.add_months(order_day(), 1).alias("next_month"))


@query(
    "F05_month_difference",
    """SELECT l_orderkey, l_linenumber, CAST(datediff('month', o_orderdate, l_shipdate) AS INTEGER) AS months
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    months = d.calendar_months_between(F.col("l_shipdate").cast("date"), order_day())
    return joined.select("l_orderkey", "l_linenumber", months.alias("months"))


@query(
    "F06_local_dates",
    """SELECT event_id, CAST(ts AS DATE) AS utc_day, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS local_day,
  timezone('America/Los_Angeles', timezone('UTC', ts)) AS local_time FROM events""",
)
def _(t):
    zone = "America/Los_Angeles"
    return t.events.select(
        "event_id",
        F.col("ts").cast("date").alias("utc_day"),
        d.local_date("ts", zone).alias("local_day"),
        d.local_timestamp("ts", zone).alias("local_time"),
    )


@query("F07_day_of_week", "SELECT CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, count(*) AS orders FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.dayofweek(order_day()).alias("dow")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "F08_date_labels",
    """SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter FROM orders""",
)
def _(t):
    return t.orders.select(d.month_label(order_day()).alias("month"), d.quarter_label(order_day()).alias("quarter")).distinct()


@query(
    "F09_null_functions",
    "SELECT order_id, sku, coalesce(pricebook_name, 'none') AS book, nullif(account_type, 'Retailer') AS other_type, pricebook_name IS NULL AS no_book FROM b2b_order_line",
)
def _(t):
    return roles.b2b_order_line(t).select(
        "order_id", "sku",
        F.coalesce("pricebook_name", F.lit("none")).alias("book"),
        F.nullif(F.col("account_type"), F.lit("Retailer")).alias("other_type"),
        F.col("pricebook_name").isNull().alias("no_book"),
    )


@query(
    "F10_case_when",
    "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium' ELSE 'large' END AS size FROM orders",
)
def _(t):
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(price < 50000, "small").when(price < 200000, "medium").otherwise("large").alias("size"))


@query(
    "F11_rounding",
    "SELECT c_custkey, round(c_acctbal, 1) AS rounded, abs(c_acctbal - 5000) AS distance, greatest(c_acctbal, 0) AS floored, least(c_acctbal, 100) AS capped FROM customer",
)
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey", F.round(b, 1).alias("rounded"), F.abs(b - 5000).alias("distance"),
        F.greatest(b, F.lit(0.0)).alias("floored"), F.least(b, F.lit(100.0)).alias("capped"),
    )


@query(
    "F12_text_functions",
    "SELECT id, lower(shipping_state) AS low, upper(trim(shipping_state)) AS state, CAST(length(shipping_state) AS INTEGER) AS size, concat(id, '|', owner_id) AS pair FROM account",
)
def _(t):
    s = F.col("shipping_state")
    return roles.account(t).select(
        "id", F.lower(s).alias("low"), F.upper(F.trim(s)).alias("state"), F.length(s).alias("size"),
        F.concat(F.col("id"), F.lit("|"), F.col("owner_id")).alias("pair"),
    )


@query(
    "F13_substrings",
    """SELECT p_partkey, left(p_name, 4) AS head, replace(p_name, ' ', '_') AS joined, contains(p_name, 'bolt') AS is_bolt,
  upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS title FROM part""",
)
def _(t):
    name = F.col("p_name")
    return t.part.select(
        "p_partkey", F.substring(name, 1, 4).alias("head"), F.replace(name, F.lit(" "), F.lit("_")).alias("joined"),
        name.contains("bolt").alias("is_bolt"), F.initcap("p_type").alias("title"),
    )


@query("F14_regex_extract", r"SELECT page_id, regexp_extract(html, 'track\((\d+)\)', 1) AS tracked, regexp_extract(url, '//([^/?#]+)', 1) AS host FROM pages")
def _(t):
    return t.pages.select(
        "page_id",
        F.regexp_extract("html", r"track\((\d+)\)", 1).alias("tracked"),
        F.regexp_extract("url", r"//([^/?#]+)", 1).alias("host"),
    )


@query("F15_json_value", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "F16_json_array",
    """SELECT CAST(l_shipdate AS DATE) AS txn_date, count(*) AS credit_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
)
def _(t):
    from shelfline.operators.sales import CREDIT_SCHEMA

    memos = roles.credit_memo(t).withColumn("n", F.size(F.from_json("line", CREDIT_SCHEMA)))
    return memos.groupBy("txn_date").agg(F.sum("n").alias("credit_lines"))


@query("F17_pseudonym", "SELECT c_custkey, left(sha256(c_name), 12) AS pseudonym FROM customer")
def _(t):
    return t.customer.select("c_custkey", c.pseudonym("c_name", 12).alias("pseudonym"))


@query(
    "F18_log_and_root",
    "SELECT p_partkey, ln(1 + p_retailprice) AS log, sqrt(p_retailprice) AS root FROM part",
    rounded=["log", "root"],
)
def _(t):
    return t.part.select("p_partkey", F.log1p("p_retailprice").alias("log"), F.sqrt("p_retailprice").alias("root"))


@query(
    "F19_dictionary_lookup",
    "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'S' WHEN 'MEDIUM' THEN 'M' WHEN 'LARGE' THEN 'L' ELSE p_type END AS size_code FROM part",
)
def _(t):
    code = c.lookup("p_type", {"SMALL": "S", "MEDIUM": "M", "LARGE": "L"}, F.col("p_type"))
    return t.part.select("p_partkey", code.alias("size_code"))


@query(
    "F20_money_text",
    "SELECT o_orderkey, round(o_totalprice, 2) AS amount FROM orders",
)
def _(t):
    shown = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return t.orders.select("o_orderkey", c.money_text(shown).alias("amount"))


@query(
    "F21_magnitude_suffix",
    """SELECT p_partkey, CAST(CAST(p_size AS BIGINT) * CASE p_type WHEN 'SMALL' THEN 1000 WHEN 'LARGE' THEN 1000000 WHEN 'PROMO' THEN 1000000000 ELSE 1 END AS BIGINT) AS n FROM part""",
)
def _(t):
    suffix = c.lookup("p_type", {"SMALL": "K", "LARGE": "m", "PROMO": "B"}, F.lit(""))
    text = F.concat(F.col("p_size").cast("string"), suffix)
    return t.part.select("p_partkey", c.abbreviated_count(text).alias("n"))
