"""One small query per relational primitive: sources, filters, joins, sets, sorts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import columns as c
from shelfline.functions import dates as d
from shelfline.functions import joins as j
from shelfline.functions import windows as w
from shelfline.operators import accounts as acc
from shelfline.operators import inventory as inv
from shelfline.operators import scorecard as sc
from shelfline.plans import inputs
from shelfline.plans.accounts import SHEET_CTES, _sheet
from shelfline.plans.inputs import AS_OF
from shelfline.plans.registry import query
from shelfline.sources import files, footers, roles, storage

CENTS = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


def order_day():
    return F.col("o_orderdate").cast("date")


def monthly(t):
    """Orders and revenue per month: a bounded series for window primitives."""
    return t.orders.groupBy(d.month_start(order_day()).alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), c.money_sum("o_totalprice").alias("revenue")
    )


MONTHLY = f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders,
  {CENTS.format('o_totalprice')} AS revenue FROM orders GROUP BY 1"""


# -- sources and sinks ---------------------------------------------------------------

@query("S01_table_scan", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def _(t):
    return files.scan(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate"])


@query("S02_whole_mart_ordered_limit", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 90")
def _(t):
    return t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(90)


@query(
    "S03_parameterised_scan",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '2000-01-01'
  AND o_orderdate <= DATE '2000-12-31' AND o_orderstatus IN ('F', 'O')""",
)
def _(t):
    inside = c.day_range(order_day(), date(2000, 1, 1), date(2000, 12, 31))
    kept = t.orders.filter(inside & c.in_list("o_orderstatus", ["F", "O"]))
    return kept.select("o_orderkey", "o_totalprice")


SHEET_HEADERS = [f"{x.month}/{x.day}" for x in roles.SHEET_WEEKS]
WIDE_SHEET = """SELECT label AS "METRIC", 'TEAM' AS "OWNER", '100' AS "TARGET",
  CASE WHEN code = '2-HIGH' THEN 'n/a' ELSE '$' || format('{:,}', total * 100) END AS "Current Total", '12%' AS "% TO TARGET", """ + ", ".join(
    f"max(cell) FILTER (WHERE week = DATE '{x.isoformat()}') AS \"{h}\"" for x, h in zip(roles.SHEET_WEEKS, SHEET_HEADERS)
) + ", '$5' AS \"13/40\", lpad(CAST(position AS VARCHAR), 2, '0') AS position FROM sheet_cell GROUP BY code, label, total, position"


@query("S04_sheet_source", WIDE_SHEET)
def _(t):
    sheet = roles.metric_sheet(t)
    # Written with its columns in another order than they are asked for.
    path = files.write_csv(sheet.select(*(F.col(f"`{c}`") for c in sorted(sheet.columns))), storage.scratch_path(t.spark, "metric-sheet"))
    return files.read_sheet(t.spark, path, sheet.columns).na.fill("")


@query(
    "S05_html_source",
    "SELECT page_id, url, length(html) AS html_length FROM pages",
)
def _(t):
    return t.pages.select("page_id", "url", F.length("html").cast("bigint").alias("html_length"))


@query("S06_csv_sink", "SELECT n_nationkey, n_name, CAST(count(*) AS INTEGER) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(t):
    counts = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    counts = counts.groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).cast("int").alias("customers"))
    path = files.write_csv(counts, storage.scratch_path(t.spark, "export"))
    return t.spark.read.option("header", True).schema(counts.schema).csv(path)


@query("S07_empty_fallback", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())])
    present = files.scan_or_empty(t.spark, f"{t.folder}/orders.parquet", schema)
    absent = files.scan_or_empty(t.spark, f"{t.folder}/no_such_table.parquet", schema)
    return present.unionByName(absent)


@query(
    "S08_numeric_coercion",
    """SELECT supplier_item, TRY_CAST(units AS DOUBLE) AS units FROM item""",
)
def _(t):
    return files.as_numbers(roles.item(t).select("supplier_item", "units"), ["units"])


@query(
    "S09_data_through",
    f"WITH {SHEET_CTES} SELECT max(most_recent_order_date) AS fact_sheet_through, (SELECT max(sale_date) FROM sold) AS sales_through FROM sheet",
)
def _(t):
    return acc.data_through(_sheet(t), inputs.sold_lines(t, with_account=False))


@query(
    "S09_data_through_by_footers",
    """SELECT 'lineitem' AS fact, count(*) AS row_count, min(l_shipdate) AS first_moment, max(l_shipdate) AS last_moment FROM lineitem
       UNION ALL SELECT 'orders', count(*), min(o_orderdate), max(o_orderdate) FROM orders
       UNION ALL SELECT 'events', count(*), min(ts), max(ts) FROM events""",
)
def _(t):
    def through(table, column):
        found = footers.bounds(t.spark, f"{t.folder}/{table}.parquet", [column])
        return found.select(
            F.lit(table).alias("fact"), F.col("rows").alias("row_count"),
            F.col(f"{column}_min").alias("first_moment"), F.col(f"{column}_max").alias("last_moment"),
        )

    lines, orders = through("lineitem", "l_shipdate"), through("orders", "o_orderdate")
    return lines.unionByName(orders).unionByName(through("events", "ts"))


# -- projections and predicates --------------------------------------------------------

@query("P01_projection", "SELECT c_name AS customer, c_custkey AS id, c_mktsegment AS segment FROM customer")
def _(t):
    renamed = t.customer.withColumnsRenamed({"c_name": "customer", "c_custkey": "id", "c_mktsegment": "segment"})
    return renamed.select("customer", "id", "segment")


@query(
    "P02_range_and_equality",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 100000 AND o_orderpriority = '2-HIGH'""",
)
def _(t):
    wanted = (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") >= 100000)
    return t.orders.filter(wanted & (F.col("o_orderpriority") == "2-HIGH")).select("o_orderkey")


@query(
    "P03_in_list",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2)""",
)
def _(t):
    wanted = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2)
    return t.customer.filter(wanted).select("c_custkey", "c_mktsegment")


@query(
    "P04_like",
    """SELECT supplier_item, "desc" FROM item WHERE lower("desc") LIKE '%seltzer%' AND "desc" NOT LIKE '%ring%'""",
)
def _(t):
    desc = F.col("desc")
    return roles.item(t).filter(F.lower(desc).like("%seltzer%") & ~desc.like("%ring%")).select("supplier_item", "desc")


@query(
    "P05_null_tolerant",
    """SELECT order_id, sku, pricebook_name FROM b2b_order_line WHERE pricebook_name IS NULL
  OR (lower(pricebook_name) NOT LIKE '%sample%' AND lower(pricebook_name) NOT LIKE '%suggested%')""",
)
def _(t):
    return roles.b2b_order_line(t, with_customer=False).filter(inv.sellable_pricebook()).select("order_id", "sku", "pricebook_name")


@query(
    "P06_safe_cast_predicate",
    """SELECT dist_code, item_code, TRY_CAST(qty AS BIGINT) AS qty FROM sell_through_raw
WHERE TRY_CAST(qty AS BIGINT) > 0 AND try_strptime(invoice_date, '%Y%m%d') IS NOT NULL
  AND item_code NOT LIKE '99Z%' AND item_code <> 'XXXXXX'""",
)
def _(t):
    return inv.sell_through_lines(roles.sell_through_raw(t, with_account=False)).select("dist_code", "item_code", "qty")


@query(
    "P07_not_blank",
    "SELECT id, shipping_state FROM account WHERE shipping_state IS NOT NULL AND trim(shipping_state) <> ''",
)
def _(t):
    return roles.account(t).filter(c.not_blank("shipping_state")).select("id", "shipping_state")


@query(
    "P08_relative_dates",
    """SELECT count(*) FILTER (WHERE d BETWEEN DATE '2001-08-01' - 30 AND DATE '2001-08-01') AS last_30_days,
  count(*) FILTER (WHERE d BETWEEN DATE '2001-08-01' - 84 AND DATE '2001-08-01') AS last_12_weeks,
  count(*) FILTER (WHERE d >= DATE '2001-08-01') AS this_month,
  count(*) FILTER (WHERE d >= DATE '2001-07-01' AND d < DATE '2001-08-01') AS previous_month,
  count(*) FILTER (WHERE d >= DATE '2001-05-01') AS last_3_months
FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate >= DATE '2001-05-01')""",
)
def _(t):
    this_month = d.month_floor(AS_OF)
    start = d.shift_months(this_month, -3)
    since = lambda day: order_day() >= F.lit(day)
    return t.orders.filter(since(start)).agg(
        F.count_if(c.day_range(order_day(), d.days_before(AS_OF, 30), AS_OF)).alias("last_30_days"),
        F.count_if(c.day_range(order_day(), d.days_before(AS_OF, 84), AS_OF)).alias("last_12_weeks"),
        F.count_if(since(this_month)).alias("this_month"),
        F.count_if(since(d.shift_months(this_month, -1)) & (order_day() < F.lit(this_month))).alias("previous_month"),
        F.count_if(since(start)).alias("last_3_months"),
    )


@query(
    "P09_all_sentinel",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
)
def _(t):
    wanted = c.in_list("o_orderstatus", ["All", "F"]) & c.in_list("o_orderpriority", ["1-URGENT", "5-LOW"])
    return t.orders.filter(wanted).select("o_orderkey")


@query(
    "P10_cascading_filters",
    """SELECT vip_id, chain_name, state FROM door WHERE chain_code IN (
  SELECT chain_code FROM (SELECT chain_code, sf_owner_name, row_number() OVER (PARTITION BY chain_code
    ORDER BY count(*) DESC, sf_owner_name) AS rn FROM door WHERE sf_owner_name IS NOT NULL AND chain_code IS NOT NULL GROUP BY 1, 2)
  WHERE rn = 1 AND sf_owner_name = 'Owner 2') AND state IN ('AA', 'FA', 'KA')""",
)
def _(t):
    return acc.portfolio(roles.door(t), "Owner 2", None, ["AA", "FA", "KA"]).select("vip_id", "chain_name", "state")


@query(
    "P11_exclude_and_between",
    """SELECT p_partkey FROM part WHERE NOT contains(p_name, 'ring') AND p_size IS NOT NULL AND p_size BETWEEN 5 AND 40""",
)
def _(t):
    wanted = ~F.col("p_name").contains("ring") & F.col("p_size").isNotNull() & F.col("p_size").between(5, 40)
    return t.part.filter(wanted).select("p_partkey")


@query(
    "P12_having",
    "SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 500",
)
def _(t):
    sums = t.lineitem.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("units"))
    return sums.filter("units > 500")


@query(
    "P13_qualify",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""",
)
def _(t):
    rank = F.row_number().over(w.series(["o_custkey"], F.col("o_totalprice").desc(), "o_orderkey"))
    return t.orders.withColumn("rn", rank).filter("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


# -- joins -------------------------------------------------------------------------------

@query(
    "J01_left_lookup_default",
    """SELECT order_id, sku, coalesce(pack_size, 1) AS pack_size FROM b2b_order_line
  LEFT JOIN (SELECT * FROM sku_map WHERE pack_size > 10) ON sku = sf_sku""",
)
def _(t):
    known = roles.sku_map(t).filter("pack_size > 10")
    joined = roles.b2b_order_line(t, with_customer=False).join(known, F.col("sku") == F.col("sf_sku"), "left")
    return joined.select("order_id", "sku", F.coalesce("pack_size", F.lit(1)).cast("bigint").alias("pack_size"))


@query(
    "J02_inner",
    """SELECT l_orderkey, s_name, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t):
    located = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return t.lineitem.join(located, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_name", "n_name")


@query(
    "J03_inner_with_flag",
    """SELECT distributor_code, count(*) AS lines FROM sell_through_raw JOIN distributor
  ON dist_code = distributor_code AND NOT is_parent_rollup GROUP BY 1""",
)
def _(t):
    real = roles.distributor(t).filter("NOT is_parent_rollup")
    lines = roles.sell_through_raw(t, with_account=False).groupBy("dist_code").agg(F.count(F.lit(1)).alias("lines"))
    return lines.join(real, F.col("dist_code") == F.col("distributor_code")).select("distributor_code", "lines")


@query(
    "J04_or_left_join",
    """SELECT a.id, d.distributor_code FROM account a LEFT JOIN distributor d
  ON a.id = d.sf_account_id OR a.id = d.parent_sf_account_id""",
)
def _(t):
    ids = j.any_id(roles.distributor(t), ["sf_account_id", "parent_sf_account_id"])
    joined = roles.account(t).join(ids, F.col("id") == F.col("match_id"), "left")
    return joined.select("id", "distributor_code")


@query(
    "J05_or_semi_join",
    """SELECT DISTINCT d.distributor_code FROM account a JOIN distributor d
  ON a.id = d.sf_account_id OR a.id = d.parent_sf_account_id WHERE a.shipping_state IS NOT NULL""",
)
def _(t):
    shipping = roles.account(t).filter("shipping_state IS NOT NULL").select("id").distinct()
    ids = j.any_id(roles.distributor(t), ["sf_account_id", "parent_sf_account_id"])
    hits = ids.join(shipping, F.col("match_id") == F.col("id"), "left_semi")
    return hits.select("distributor_code").distinct()


@query(
    "J06_anti_left_null",
    """SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01')
  ON c_custkey = o_custkey WHERE o_custkey IS NULL""",
)
def _(t):
    recent = t.orders.filter(order_day() >= F.lit(date(2001, 1, 1))).select("o_custkey").distinct()
    return t.customer.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "J07_not_in",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)",
)
def _(t):
    sold = t.lineitem.filter("l_discount > 0.08 AND l_partkey IS NOT NULL").select("l_partkey").distinct()
    return t.part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query(
    "J08_full_outer",
    f"""SELECT coalesce(a.month, b.month) AS month, coalesce(orders, 0) AS orders, coalesce(shipped, 0) AS shipped
FROM ({MONTHLY}) a FULL JOIN (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS shipped FROM lineitem GROUP BY 1) b
  ON a.month = b.month""",
)
def _(t):
    shipped = t.lineitem.groupBy(d.month_start(F.col("l_shipdate").cast("date")).alias("month")).agg(
        F.count(F.lit(1)).alias("shipped")
    )
    both = monthly(t).join(shipped, "month", "full")
    return both.select("month", c.zero_if_null("orders").alias("orders"), c.zero_if_null("shipped").alias("shipped"))


@query(
    "J09_attach_total",
    f"SELECT month, revenue, (SELECT {CENTS.format('o_totalprice')} FROM orders) AS total FROM ({MONTHLY})",
)
def _(t):
    total = j.grand_total(t.orders, c.money_sum("o_totalprice"))
    return monthly(t).select("month", "revenue", total.alias("total"))


@query(
    "J10_equi_and_band",
    """SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey
  AND abs(s.s_acctbal / 100 - c.c_acctbal / 100) < 1.00)""",
)
def _(t):
    # Nearest balance below and above per nation and bucket of 100, as in the duplicate
    # check: no comparison of all customers with all suppliers of a nation.
    theirs, own = F.col("s_acctbal") / 100, F.col("c_acctbal") / 100
    buckets = t.supplier.groupBy("s_nationkey", F.floor(theirs).alias("b")).agg(
        F.min(theirs).alias("low"), F.max(theirs).alias("high")
    )
    seen = buckets.select(
        F.col("s_nationkey").alias("c_nationkey"), "low", "high",
        F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("bucket"),
    )
    keyed = t.customer.select("c_custkey", "c_nationkey", own.alias("own"), F.floor(own).alias("bucket"))
    close = (F.abs(F.col("low") - F.col("own")) < 1) | (F.abs(F.col("high") - F.col("own")) < 1)
    same = F.floor("low") == F.col("bucket")
    hits = keyed.join(seen, ["c_nationkey", "bucket"]).filter(same | close)
    return hits.select("c_custkey").distinct()


@query(
    "J11_group_first_event",
    """SELECT o_orderkey, CAST(datediff('day', first_day, CAST(o_orderdate AS DATE)) AS INTEGER) AS days_since_first
FROM orders JOIN (SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS first_day FROM orders GROUP BY 1) ON o_custkey = k""",
)
def _(t):
    first = t.orders.groupBy("o_custkey").agg(F.min(order_day()).alias("first_day"))
    joined = t.orders.join(first, "o_custkey")
    return joined.select("o_orderkey", F.date_diff(order_day(), F.col("first_day")).alias("days_since_first"))


@query(
    "J12_unnest_json",
    "SELECT id, title, sku, quantity FROM web_line WHERE title IS NOT NULL",
)
def _(t):
    from shelfline.operators.sales import ITEM_SCHEMA

    rows = roles.web_order_items(t).select("id", F.inline(F.from_json("line_items", ITEM_SCHEMA)))
    kept = rows.filter("title IS NOT NULL AND title NOT LIKE '%Protection%'")
    return kept.select("id", "title", "sku", F.col("quantity").cast("bigint").alias("quantity"))


@query(
    "J13_spine_fill",
    """SELECT month, count(l_orderkey) AS returned FROM (
  SELECT CAST(unnest(range((SELECT date_trunc('month', min(l_shipdate)) FROM lineitem),
    (SELECT max(l_shipdate) FROM lineitem) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS month)
  LEFT JOIN lineitem ON date_trunc('month', l_shipdate) = month AND l_returnflag = 'R' GROUP BY 1""",
)
def _(t):
    month = d.month_start(F.col("l_shipdate").cast("date")).alias("month")
    ends = t.lineitem.select(month).agg(F.min("month").alias("first"), F.max("month").alias("last"))
    spine = ends.select(F.explode(j.month_spine(F.col("first"), F.col("last"))).alias("month"))
    counts = t.lineitem.filter("l_returnflag = 'R'").groupBy(month).agg(F.count(F.lit(1)).alias("returned"))
    return spine.join(counts, "month", "left").na.fill(0, ["returned"])


@query(
    "J14_left_merge_subtract",
    f"""SELECT month, round(revenue - coalesce(credit, 0), 2) AS net FROM ({MONTHLY}) LEFT JOIN (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, {CENTS.format('l_extendedprice')} AS credit FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY 1) ON month = m""",
)
def _(t):
    day = F.col("l_shipdate").cast("date")
    credits = t.lineitem.filter("l_returnflag = 'R'").groupBy(d.month_start(day).alias("month")).agg(c.money_sum("l_extendedprice").alias("credit"))
    joined = monthly(t).join(credits, "month", "left")
    return joined.select("month", F.round(F.col("revenue") - F.coalesce("credit", F.lit(0.0)), 2).alias("net"))


def _status_days(t, status):
    return t.orders.filter(F.col("o_orderstatus") == status).groupBy(
        order_day().alias("day"), F.dayofweek(order_day()).alias("dow")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "J15_outer_merge_composite",
    """SELECT coalesce(a.day, b.day) AS day, coalesce(a.dow, b.dow) AS dow, coalesce(a.n, 0) AS n_f, coalesce(b.n, 0) AS n_o
FROM (SELECT CAST(o_orderdate AS DATE) AS day, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, count(*) AS n FROM orders
    WHERE o_orderstatus = 'F' GROUP BY 1, 2) a
  FULL JOIN (SELECT CAST(o_orderdate AS DATE) AS day, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, count(*) AS n FROM orders
    WHERE o_orderstatus = 'O' GROUP BY 1, 2) b ON a.day = b.day AND a.dow = b.dow""",
)
def _(t):
    left = _status_days(t, "F").withColumnRenamed("n", "n_f")
    right = _status_days(t, "O").withColumnRenamed("n", "n_o")
    return left.join(right, ["day", "dow"], "full").na.fill(0, ["n_f", "n_o"])


@query(
    "J16_outer_merge_month",
    f"""SELECT coalesce(a.month, b.month) AS month, coalesce(revenue, 0) AS booked, coalesce(shipped, 0) AS shipped
FROM ({MONTHLY}) a FULL JOIN (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {CENTS.format('l_extendedprice')} AS shipped
  FROM lineitem GROUP BY 1) b ON a.month = b.month""",
)
def _(t):
    shipped = t.lineitem.groupBy(d.month_start(F.col("l_shipdate").cast("date")).alias("month")).agg(
        c.money_sum("l_extendedprice").alias("shipped")
    )
    both = monthly(t).select("month", F.col("revenue").alias("booked")).join(shipped, "month", "full")
    return both.na.fill(0.0, ["booked", "shipped"])


@query(
    "J17_substring_match",
    """SELECT DISTINCT position, label, CASE code WHEN '1-URGENT' THEN 'urgent_orders' WHEN '2-HIGH' THEN 'high_priority_orders'
  WHEN '4-NOT SPECIFIED' THEN 'unspecified_orders' WHEN 'F' THEN 'buying_doors' WHEN 'O' THEN 'open_orders'
  WHEN 'P' THEN 'retail_to_date' WHEN '0' THEN 'even_buyer_orders' WHEN '1' THEN 'even_buyer_orders' END AS key FROM sheet_cell""",
)
def _(t):
    sheet = roles.metric_sheet(t)
    return sheet.select(
        F.col("position").cast("bigint").alias("position"),
        F.col("METRIC").alias("label"),
        sc.metric_key("METRIC", roles.METRICS).alias("key"),
    )


@query(
    "J18_latest_not_after",
    """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders
WHERE o_orderdate <= DATE '2000-06-30' GROUP BY 1""",
)
def _(t):
    past = t.orders.filter(order_day() <= F.lit(date(2000, 6, 30)))
    return past.groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order")
    )


@query(
    "J19_semi_top_groups",
    f"""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1
  ORDER BY {CENTS.format('o_totalprice')} DESC, 1 LIMIT 10)""",
)
def _(t):
    best = j.top_groups(t.orders, "o_custkey", c.money_sum("o_totalprice"), 10)
    return j.members_of(t.orders, best, "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "J20_set_intersection",
    """SELECT count(*) AS both FROM (SELECT user_id FROM events WHERE event_type = 'purchase'
  INTERSECT SELECT user_id FROM events WHERE event_type = 'error')""",
)
def _(t):
    flags = t.events.groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "purchase").alias("bought"),
        F.bool_or(F.col("event_type") == "error").alias("failed"),
    )
    return flags.agg(F.count_if(F.col("bought") & F.col("failed")).alias("both"))


# -- sorts and limits -----------------------------------------------------------------------

@query("O01_multi_key_order", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer")
def _(t):
    return t.customer.orderBy("c_mktsegment", F.col("c_acctbal").desc(), "c_custkey").select(
        "c_mktsegment", "c_acctbal", "c_custkey"
    )


@query("O02_order_limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def _(t):
    return t.events.orderBy(F.col("value").desc(), "event_id").limit(50).select("event_id", "value")


@query(
    "O03_nlargest_nsmallest",
    """SELECT p_partkey, p_retailprice, 'largest' AS side FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)
UNION ALL SELECT p_partkey, p_retailprice, 'smallest' FROM (SELECT * FROM part ORDER BY p_retailprice, p_partkey LIMIT 10)""",
)
def _(t):
    price = F.col("p_retailprice")
    side = lambda df, name: df.limit(10).select("p_partkey", price, F.lit(name).alias("side"))
    largest = side(t.part.orderBy(price.desc(), "p_partkey"), "largest")
    return largest.unionByName(side(t.part.orderBy(price, "p_partkey"), "smallest"))


@query(
    "O04_custom_order",
    """SELECT *, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 99 END) AS INTEGER) AS place
FROM (SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1)""",
)
def _(t):
    counts = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
    position = c.order_key("o_orderstatus", ["P", "O", "F"])
    return counts.withColumn("place", F.row_number().over(w.series([], position)))


@query(
    "O05_top_groups_members",
    f"""SELECT l_partkey, count(*) AS lines FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1
  ORDER BY {CENTS.format('l_extendedprice')} DESC, 1 LIMIT 15) GROUP BY 1""",
)
def _(t):
    best = j.top_groups(t.lineitem, "l_partkey", c.money_sum("l_extendedprice"), 15)
    return j.members_of(t.lineitem, best, "l_partkey").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "O06_latest_period",
    """SELECT event_id FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events)""",
)
def _(t):
    day = F.col("ts").cast("date")
    latest = j.grand_total(t.events, F.max("ts")).cast("date")
    return t.events.filter(day == latest).select("event_id")


# -- sets and reshaping -----------------------------------------------------------------------

@query(
    "U01_union_all",
    "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier",
)
def _(t):
    customers = t.customer.selectExpr("c_name AS name", "c_nationkey AS nation")
    return customers.unionByName(t.supplier.selectExpr("s_nationkey AS nation", "s_name AS name"))


@query(
    "U02_concat_differing",
    "SELECT c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, NULL FROM supplier",
)
def _(t):
    customers = t.customer.selectExpr("c_name AS name", "c_mktsegment AS segment")
    return customers.unionByName(t.supplier.selectExpr("s_name AS name"), allowMissingColumns=True)


@query(
    "U04_wide_to_long",
    f"""SELECT month, 'orders' AS measure, CAST(orders AS DOUBLE) AS value FROM ({MONTHLY})
UNION ALL SELECT month, 'revenue', revenue FROM ({MONTHLY})""",
)
def _(t):
    wide = monthly(t).withColumn("orders", F.col("orders").cast("double"))
    return wide.unpivot("month", ["orders", "revenue"], "measure", "value")


@query(
    "U05_long_to_wide",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
  count(*) FILTER (WHERE o_orderstatus = 'X') AS "X" FROM orders GROUP BY 1""",
)
def _(t):
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "X"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@query(
    "U06_sheet_to_long",
    """SELECT DISTINCT label, week, cell FROM sheet_cell""",
)
def _(t):
    sheet = roles.metric_sheet(t)
    heads = {h: sc.header_date(h, 2001) for h in sheet.columns[len(sc.SHEET_FIXED):]}
    dated = {h: x for h, x in heads.items() if x is not None}
    named = sheet.select("METRIC", *[F.col(f"`{h}`").alias(x.isoformat()) for h, x in dated.items()])
    long = named.unpivot("METRIC", [x.isoformat() for x in dated.values()], "week", "cell")
    return long.select(F.col("METRIC").alias("label"), F.col("week").cast("date").alias("week"), "cell")


@query(
    "U07_dense_grid",
    """SELECT s.seg AS c_mktsegment, k.k AS nation, count(c_custkey) AS customers FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) s
  CROSS JOIN (SELECT CAST(unnest(range((SELECT min(n_nationkey) FROM nation), (SELECT max(n_nationkey) FROM nation) + 6)) AS INTEGER) AS k) k LEFT JOIN customer ON c_mktsegment = seg AND c_nationkey = k GROUP BY 1, 2""",
)
def _(t):
    counts = t.customer.groupBy("c_mktsegment", F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("customers")
    )
    # Five keys past the last nation: cells without any row.
    first, last = (j.grand_total(t.nation, end("n_nationkey")) for end in (F.min, F.max))
    nations = F.explode(F.sequence(first, last + 5)).alias("nation")
    spine = t.customer.select("c_mktsegment").distinct().select("c_mktsegment", nations)
    return spine.join(counts, ["c_mktsegment", "nation"], "left").na.fill(0, ["customers"])


@query(
    "U08_clip",
    "SELECT c_custkey, greatest(least(c_acctbal, 5000), 0) AS clipped FROM customer",
)
def _(t):
    return t.customer.select("c_custkey", c.clip("c_acctbal", 0.0, 5000.0).alias("clipped"))
