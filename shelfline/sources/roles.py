"""Adapters from the star-schema tables to the input roles of the operators.

Every role is a projection (plus the joins the role needs) with declared types;
operators only ever see roles, so a user with real sources swaps this module.
``since`` lets a caller push its date window into the fact scan.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.columns import lookup
from shelfline.operators.scorecard import Metric

S = "string"

# How the coded columns of the test tables play the roles.
PRODUCT_TEXT = {
    "STANDARD": "5mg 12oz Seltzer Spicy Lime",
    "MEDIUM": "10mg 16 oz",
    "LARGE": "5mg 750ml Bottle Citrus",
    "PROMO": "25mg 750ml Bottle Cranberry",
    "SMALL": "10mg 2oz Shot Variety",
    "ECONOMY": "Lemonade Original",
}
PRODUCT_CATEGORY = {
    "STANDARD": "5mg 12oz Seltzer",
    "MEDIUM": "10mg 16oz Seltzer",
    "LARGE": "5mg 750ml Bottle",
    "PROMO": "25mg 750ml Bottle",
    "SMALL": "10mg 2oz Shot",
    "ECONOMY": "Other",
}
ACCOUNT_TYPE = {
    "BUILDING": "Distributor",
    "MACHINERY": "Distribution Center",
    "FURNITURE": "Key Account",
    "HOUSEHOLD": "Retailer",
}
PRICEBOOK = {
    "1-URGENT": "Event Sample Book",
    "3-MEDIUM": "Suggested Retail",
    "4-NOT SPECIFIED": "Standard",
    "5-LOW": "Standard",
}
TICKET_STATUS = {
    "signup": "new", "view": "open", "click": "pending", "purchase": "solved", "error": "closed",
}
TICKET_TAGS = [
    "address_change", "wrongaddress", "order_status", "reship", "protectly", "reshipment",
    "billing", "refund",
]
SHIPMENT_STATUS = {
    "signup": "pending", "view": "shipped", "click": "shipped", "purchase": "shipped",
    "error": "cancelled",
}
CARRIERS = ["ups_walleted", "ups", "stamps_com", "fedex", "globalpost", "dhl_express"]
ENTITY_TYPE = {
    "signup": "brand", "view": "flavor", "click": "ingredient", "purchase": "category",
    "error": "brand",
}
ENGINES = ["google", "reddit", "youtube_noapi", "tiktok", "bing"]
WEB_START = date(1998, 6, 1)
LEGACY_END = date(1999, 1, 1)


# Declared schemas, so that a scan never infers one from the files.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
}


class Tables:
    """The parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")


def _nth(values: list[str], index: Column) -> Column:
    """Value at a zero-based position, NULL past the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _state(nation: str, region: str) -> Column:
    letter = lambda c: F.expr(f"char(65 + {c})")
    return F.concat(letter(nation), letter(region))


def _code(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast(S))


def _payload_number() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _on_or_after(df: DataFrame, column: str, since: date | None) -> DataFrame:
    return df if since is None else df.filter(F.col(column).cast("date") >= F.lit(since))


# -- dimensions --------------------------------------------------------------

def distributor(t: Tables) -> DataFrame:
    return t.supplier.select(
        _code("D", "s_suppkey").alias("distributor_code"),
        F.col("s_name").alias("distributor_name"),
        _code("A", "s_suppkey").alias("sf_account_id"),
        F.concat(F.lit("A"), (F.col("s_nationkey") + 100).cast(S)).alias("parent_sf_account_id"),
        (F.col("s_acctbal") < 1000).alias("is_parent_rollup"),
        F.greatest(F.floor("s_acctbal"), F.lit(0)).cast("bigint").alias("total_retailers"),
    )


def distributor_state(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        _code("D", "s_suppkey").alias("distributor_id"),
        _state("n_nationkey", "n_regionkey").alias("state"),
    )


def product_text() -> Column:
    return F.concat_ws(" ", "p_name", lookup("p_type", PRODUCT_TEXT))


def item(t: Tables) -> DataFrame:
    """Item master with two versions per item; some unit texts are not numbers."""
    key = _code("I", "p_partkey").alias("supplier_item")
    newest = t.part.select(
        key,
        product_text().alias("desc"),
        F.col("p_brand").alias("brand_desc"),
        F.when(F.col("p_size") > 45, "n/a").otherwise(F.col("p_size").cast(S)).alias("units"),
        lookup("p_type", PRODUCT_CATEGORY).alias("category"),
        F.lit("2001-06-01").cast("timestamp_ntz").alias("extracted_at"),
    )
    older = t.part.select(
        key,
        F.col("p_name").alias("desc"),
        F.col("p_brand").alias("brand_desc"),
        (F.col("p_size") + 1).cast(S).alias("units"),
        F.lit(None).cast(S).alias("category"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("extracted_at"),
    )
    return newest.unionByName(older)


def sku_map(t: Tables) -> DataFrame:
    return t.part.select(
        _code("I", "p_partkey").alias("sf_sku"), F.col("p_size").cast("bigint").alias("pack_size")
    )


def account(t: Tables) -> DataFrame:
    located = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    shown = F.concat(F.lit(" "), F.lower(_state("n_nationkey", "n_regionkey")))
    return located.select(
        _code("A", "c_custkey").alias("id"),
        _code("U", "c_nationkey").alias("owner_id"),
        F.when(F.col("c_acctbal") < 500, None)
        .when(F.col("c_acctbal") < 800, "  ")
        .otherwise(shown)
        .alias("shipping_state"),
    )


def user(t: Tables) -> DataFrame:
    return t.nation.select(_code("U", "n_nationkey").alias("id"), F.col("n_name").alias("name"))


# -- business-to-business orders ---------------------------------------------

def _order_status() -> Column:
    pending = F.col("o_orderstatus") == "P"
    return (
        F.when(pending & (F.col("o_orderpriority") == "5-LOW"), "Draft")
        .when(pending & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), "Cancelled")
        .otherwise("Activated")
    )


def _order_lines(t: Tables, since: date | None, with_customer: bool = True) -> DataFrame:
    orders = _on_or_after(t.orders, "o_orderdate", since)
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(t.customer, F.col("o_custkey") == F.col("c_custkey")) if with_customer else lines


def b2b_order_line(t: Tables, since: date | None = None, with_customer: bool = True) -> DataFrame:
    """Order lines; ``with_customer`` adds the customer's name and type at the price of
    a join. Every order has its customer, so both forms have the same lines."""
    customer = [F.col("c_name").alias("customer_name"), lookup("c_mktsegment", ACCOUNT_TYPE).alias("account_type")]
    return _order_lines(t, since, with_customer).select(
        F.col("o_orderkey").cast(S).alias("order_id"),
        _code("A", "o_custkey").alias("account_id"),
        *(customer if with_customer else []),
        _order_status().alias("order_status"),
        lookup("o_orderpriority", PRICEBOOK).alias("pricebook_name"),
        _code("I", "l_partkey").alias("sku"),
        F.col("l_quantity").cast("bigint").cast(S).alias("quantity"),
        F.col("l_extendedprice").alias("line_total_price"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )


def b2b_order_line_norm(t: Tables, since: date | None = None) -> DataFrame:
    lines = _order_lines(t, since)
    named = lines.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return named.select(
        F.col("o_orderkey").cast(S).alias("order_id"),
        _code("A", "o_custkey").alias("account_id"),
        F.col("c_name").alias("customer_name"),
        lookup("c_mktsegment", ACCOUNT_TYPE).alias("account_type"),
        _order_status().alias("order_status"),
        _code("I", "l_partkey").alias("product_code"),
        F.when(F.col("p_size") > 2, product_text()).alias("product_name"),
        F.col("l_extendedprice").alias("line_revenue"),
        F.col("l_quantity").cast("bigint").alias("units_qty"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )


def invoice(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.col("o_totalprice").alias("total_amt"),
    )


def credit_memo(t: Tables) -> DataFrame:
    """Returned lines as memos with a nested JSON line list."""
    account_name = (
        F.when(F.col("l_linestatus") == "F", "Income:Refunds")
        .when(F.col("l_linenumber") <= 3, "Income:Discounts")
        .otherwise("Income:Sales")
    )
    detail = F.when(F.col("l_linenumber") == 7, "SubTotalLineDetail").otherwise("SalesItemLineDetail")
    amount = F.when(F.col("l_tax") == 0.08, "n/a").otherwise(
        F.col("l_extendedprice").cast("decimal(18,2)").cast(S)
    )
    line = F.struct(
        amount.alias("Amount"),
        detail.alias("DetailType"),
        F.struct(F.struct(account_name.alias("name")).alias("ItemAccountRef")).alias(
            "SalesItemLineDetail"
        ),
    )
    return t.lineitem.filter(F.col("l_returnflag") == "R").select(
        F.col("l_shipdate").cast("date").alias("txn_date"), F.to_json(F.array(line)).alias("line")
    )


# -- sell-through ------------------------------------------------------------

def _sold(t: Tables, since: date | None, with_account: bool) -> DataFrame:
    lines = _on_or_after(t.lineitem, "l_shipdate", since)
    return lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")) if with_account else lines


def _sold_keys(with_account: bool) -> list[Column]:
    last_line = F.col("l_linenumber") == 7
    return [
        _code("D", "l_suppkey").alias("dist_code"),
        F.when(last_line & (F.col("l_tax") == 0), "99Z1")
        .when(last_line & (F.col("l_discount") == 0), "XXXXXX")
        .otherwise(_code("I", "l_partkey"))
        .alias("item_code"),
        *([_code("S", "o_custkey").alias("acct_code")] if with_account else []),
        F.when(F.col("l_returnflag") == "A", "C")
        .when(F.col("l_returnflag") == "N", "B")
        .when(F.col("l_linestatus") == "F", "X")
        .alias("uom"),
    ]


def sell_through_raw(t: Tables, since: date | None = None, with_account: bool = True) -> DataFrame:
    """Distributor sell-through as delivered: every field is text, some unusable.

    The outlet (``acct_code``) stands on the order: without it no join is needed.
    Every line has its order, so both forms have the same lines."""
    last_line = F.col("l_linenumber") == 7
    return _sold(t, since, with_account).select(
        *_sold_keys(with_account),
        F.when(last_line & (F.col("l_tax") == 0.08), "abc")
        .when(last_line & (F.col("l_tax") == 0.07), "-3")
        .otherwise(F.col("l_quantity").cast("bigint").cast(S))
        .alias("qty"),
        F.when(last_line & (F.col("l_tax") == 0.06), "20010231")
        .otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
        .alias("invoice_date"),
    )


def sell_through(t: Tables, since: date | None = None, with_account: bool = True) -> DataFrame:
    """The same facts loaded with types: what parsing the text yields, with the date
    as a column the scan can filter on."""
    last_line = F.col("l_linenumber") == 7
    return _sold(t, since, with_account).select(
        *_sold_keys(with_account),
        F.when(last_line & (F.col("l_tax") == 0.08), None)
        .when(last_line & (F.col("l_tax") == 0.07), -3)
        .otherwise(F.col("l_quantity").cast("bigint"))
        .alias("qty"),
        F.when(~(last_line & (F.col("l_tax") == 0.06)), F.col("l_shipdate").cast("date")).alias("sale_date"),
    )


def door(t: Tables) -> DataFrame:
    """Outlet attributes; outlets without a chain are independents."""
    located = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    chain = (F.col("c_nationkey") % 5).cast(S)
    in_chain = F.col("c_acctbal") >= 500
    return located.select(
        _code("S", "c_custkey").alias("vip_id"),
        F.col("c_name").alias("store_name"),
        F.concat(F.lit("City "), (F.col("c_custkey") % 97).cast(S)).alias("city"),
        _state("n_nationkey", "n_regionkey").alias("state"),
        F.when(in_chain, F.concat(F.substring("c_mktsegment", 1, 2), chain)).alias("chain_code"),
        F.when(in_chain, F.concat_ws(" ", "c_mktsegment", chain)).alias("chain_name"),
        F.lpad((F.col("c_custkey") % 100000).cast(S), 5, "0").alias("zip"),
        F.col("c_mktsegment").alias("class_of_trade_name"),
        F.when(F.col("c_custkey") % 3 == 0, "On-Premise").otherwise("Off-Premise").alias("channel_type"),
        _code("A", "c_custkey").alias("sf_account_id"),
        F.col("c_name").alias("sf_account_name"),
        F.when(
            F.col("c_custkey") % 11 != 0,
            F.concat(F.lit("Owner "), (F.col("c_custkey") % 6).cast(S)),
        ).alias("sf_owner_name"),
        F.when(F.col("c_acctbal") < 9000, F.col("c_nationkey") * 0.5 + 25).alias("google_latitude"),
        (F.col("c_nationkey") * 2.0 - 120).alias("google_longitude"),
    )


# -- web and legacy platform orders ------------------------------------------

def _placed_at() -> Column:
    hours = F.expr("make_dt_interval(0, cast(o_orderkey % 24 AS INT))")
    return F.col("o_orderdate") + hours


def _mail() -> Column:
    return F.concat(F.lit("cust"), F.col("o_custkey").cast(S), F.lit("@example.com"))


def _cents(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def web_order(t: Tables, since: date | None = None) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    price = F.col("o_totalprice")
    discount = F.floor(price / 10)
    refund = F.when(status == "O", F.floor(price / 20)).otherwise(0)
    address = F.struct(
        F.when(F.col("o_custkey") % 13 != 0, F.expr("concat(' ', char(97 + o_custkey % 25), 'x')"))
        .otherwise("")
        .alias("province_code"),
        F.when(F.col("o_custkey") % 10 == 0, "CA").otherwise("US").alias("country_code"),
    )
    return _on_or_after(t.orders, "o_orderdate", since).select(
        F.col("o_orderkey").cast(S).alias("id"),
        _placed_at().alias("created_at"),
        F.when(
            (status == "F") & (priority == "5-LOW"), _placed_at() + F.expr("interval 1 day")
        ).alias("cancelled_at"),
        F.when((status == "O") & (priority == "4-NOT SPECIFIED"), "  ").otherwise(_mail()).alias("email"),
        F.when(status == "F", "paid")
        .when(status == "O", "partially_refunded")
        .when(priority == "5-LOW", "pending")
        .otherwise("refunded")
        .alias("financial_status"),
        _cents(price).alias("total_price"),
        _cents(price).alias("total_line_items_price"),
        _cents(discount).alias("total_discounts"),
        _cents(_cents(price) - discount - refund).alias("current_subtotal_price"),
        F.to_json(address).alias("shipping_address"),
    )


def web_order_items(t: Tables, since: date | None = None) -> DataFrame:
    """Order documents with a JSON item array.

    One document per order line (plus a protection item), so that building the
    JSON needs no per-order collection; an order id may repeat.
    """
    orders = _on_or_after(t.orders, "o_orderdate", since)
    sold = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    discount = F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast(S)
    product = F.struct(
        F.when(F.col("p_size") > 2, product_text()).alias("title"),
        _code("I", "l_partkey").alias("sku"),
        F.col("l_quantity").cast("bigint").cast(S).alias("quantity"),
        _cents(F.col("p_retailprice")).cast(S).alias("price"),
        F.when(F.col("l_discount") > 0, discount).alias("total_discount"),
    )
    protection = F.struct(
        F.lit("Shipping Protection").alias("title"),
        F.lit("PROTECT").alias("sku"),
        F.lit("1").alias("quantity"),
        F.lit("1.98").alias("price"),
        F.lit(None).cast(S).alias("total_discount"),
    )
    items = F.to_json(F.array(product, protection))
    return sold.select(
        F.col("o_orderkey").cast(S).alias("id"),
        _placed_at().alias("created_at"),
        F.when(F.col("l_linenumber") == 7, "[]")
        .when((F.col("l_linenumber") == 6) & (F.col("l_tax") == 0.08), None)
        .otherwise(items)
        .alias("line_items"),
    )


def legacy_order(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    shift = (F.col("o_orderkey") % 4).cast("int") * F.lit(0.5).cast("decimal(3,1)")
    return t.orders.filter(F.col("o_orderdate").cast("date") < F.lit(LEGACY_END)).select(
        F.col("o_orderkey").cast(S).alias("order_id"),
        F.when(priority == "1-URGENT", F.concat(F.lit(" "), F.upper(_mail()), F.lit(" ")))
        .when((status == "O") & (priority == "4-NOT SPECIFIED"), "")
        .otherwise(_mail())
        .alias("billing_email"),
        F.when(status == "O", "refunded")
        .when((status == "P") & (priority == "5-LOW"), "failed")
        .otherwise("completed")
        .alias("status"),
        _placed_at().alias("date_created"),
        _cents(_cents(F.col("o_totalprice")) + shift).cast(S).alias("total"),
    )


def d2c_order(t: Tables, since: date | None = None) -> DataFrame:
    return _on_or_after(t.orders, "o_orderdate", since).select(
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").alias("subtotal"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "amazon").otherwise("shopify").alias("channel"),
        F.when(F.col("o_orderstatus") == "F", "paid")
        .when(F.col("o_orderstatus") == "O", "partially_refunded")
        .otherwise("pending")
        .alias("financial_status"),
    )


# -- events: shipments, tickets, mentions ------------------------------------

def _moved_back(days: Column | str) -> Column:
    return F.col("ts") - F.expr(f"make_dt_interval(cast({days} AS INT))")


def shipment(t: Tables) -> DataFrame:
    """One row per shipment; two shipments share an order id."""
    code = _nth(CARRIERS, (F.col("user_id") % 7).cast("int"))
    return t.events.select(
        F.expr("concat('O', cast(event_id div 2 AS STRING))").alias("order_id"),
        F.expr("concat('N', cast(event_id div 2 AS STRING))").alias("order_number"),
        lookup("event_type", SHIPMENT_STATUS).alias("fulfillment_status"),
        F.when(lookup("event_type", SHIPMENT_STATUS) == "shipped", code).alias("shipment_carrier"),
        code.alias("order_carrier"),
        F.expr("concat(char(65 + user_id % 25), 'S')").alias("ship_state"),
        F.when(F.col("user_id") % 10 == 0, "CA").otherwise("US").alias("ship_country"),
        F.concat(F.lit("T"), F.col("event_id").cast(S)).alias("tracking_number"),
        F.col("value").alias("order_total"),
        (_payload_number() / F.lit(10.0)).alias("shipment_cost"),
        (_payload_number() % 9).alias("days_to_ship"),
        _moved_back("user_id % 10 * 10").cast("date").alias("order_date"),
    )


def ticket(t: Tables) -> DataFrame:
    status = lookup("event_type", TICKET_STATUS)
    resolved = status.isin("solved", "closed")
    base = t.events.withColumn("created_at", _moved_back("user_id % 10 * 30"))
    return base.select(
        F.col("event_id").alias("ticket_id"),
        status.alias("status"),
        F.when(_payload_number() < 40, "good")
        .when(_payload_number() < 55, "bad")
        .otherwise("offered")
        .alias("csat_score"),
        F.when(resolved, F.col("value")).alias("resolution_minutes_business"),
        (resolved & (F.col("value") < 50)).alias("resolved_same_day"),
        resolved.alias("is_resolved"),
        (F.col("value") < 60).alias("first_response_under_1hr"),
        "created_at",
        F.col("created_at").cast("date").alias("created_date"),
        F.date_format("created_at", "EEEE").alias("created_day_of_week"),
        F.hour("created_at").alias("created_hour"),
        F.concat(F.lit("agent "), (F.col("user_id") % 12).cast(S)).alias("agent_name"),
        _nth(TICKET_TAGS, (F.col("user_id") % 8).cast("int")).alias("tag"),
    )


def mention(t: Tables) -> DataFrame:
    return t.events.select(
        F.concat_ws(" ", "event_type", (F.col("user_id") % 20).cast(S)).alias("entity_name"),
        lookup("event_type", ENTITY_TYPE).alias("entity_type"),
        _nth(ENGINES, (F.col("user_id") % 5).cast("int")).alias("source_engine"),
        F.concat(F.lit("https://example.org/m/"), F.col("event_id").cast(S)).alias("url"),
        F.col("ts").alias("harvested_at"),
    )


def text_mention(t: Tables) -> DataFrame:
    """Documents as harvested texts, spread over the four weeks before 2024-01-31."""
    age = F.expr("make_dt_interval(cast(doc_id % 28 AS INT))")
    return t.documents.select(
        F.col("lang").alias("entity_name"),
        F.col("source").alias("source_engine"),
        F.concat(F.lit("https://example.org/d/"), F.col("doc_id").cast(S)).alias("url"),
        F.concat_ws(" ", "source", F.col("doc_id").cast(S)).alias("title"),
        F.col("text").alias("snippet"),
        (F.lit("2024-01-31").cast("timestamp_ntz") - age).alias("harvested_at"),
    )


# -- sheets ---------------------------------------------------------

SHEET_WEEKS = [date(2001, 4, 2) + timedelta(weeks=i) for i in range(13)]
#: Codes of orders whose weekly counts the desk writes down, a metric each.
COUNTED_BY_HAND = {"O": "Open", "1-URGENT": "Urgent", "2-HIGH": "High Priority", "4-NOT SPECIFIED": "Unspecified", "0": "Even Buyer"}


def _desk_metric(i: int, label: str) -> Metric:
    """Counts of standing orders are levels, the others add up."""
    name = f"{label} Orders"
    roll = "latest" if label == "Open" else "sum"
    return Metric(name.lower().replace(" ", "_"), name, "DESK", 2_000.0 * (i + 1), "number", "sheet", roll)


METRICS = [
    *(_desk_metric(i, label) for i, label in enumerate(COUNTED_BY_HAND.values())),
    Metric("largest_tracker", "Largest Tracker", "PAGES", 250, "number", "auto", "latest"),
    Metric("web_week", "Web Week", "PAGES", 45_000_000, "currency", "auto", "sum", True),
    Metric("buying_doors", "Buying Doors", "DOORS", 900, "number", "auto", "latest"),
    Metric("retail_to_date", "Retail To Date", "DOORS", 350_000_000, "currency", "auto", "max", True),
]
# What the sheet's rows are called. Two name one metric, one is blank, one unknown.
SHEET_LABELS = {
    "1-URGENT": "Urgent Orders Spring",
    "2-HIGH": "High Priority",
    "3-MEDIUM": "",
    "4-NOT SPECIFIED": "Unspecified Orders",
    "5-LOW": "Unlisted Metric",
    "F": "Buying Doors",
    "O": "Open Orders",
    "P": "Retail To Date",
    "0": "Even Buyer Orders",
    "1": "even buyer orders (final)",
}


def metric_sheet(t: Tables) -> DataFrame:
    """Manual metric sheet: all text, one column per week, one row per label.

    Weekly order counts by priority, status and customer parity play the metrics;
    two labels mean the same metric, one is blank, one unknown, one header no date.
    The sheet is one quarter wide, as such sheets are: "Current Total" counts the
    orders of its thirteen weeks and no others.
    """
    codes = F.array("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 2).cast(S))
    day = F.col("o_orderdate").cast("date")
    first, last = SHEET_WEEKS[0], SHEET_WEEKS[-1] + timedelta(days=6)
    orders = t.orders.filter(day.between(F.lit(first), F.lit(last)))
    coded = orders.select(F.trunc(day, "week").alias("week"), F.explode(codes).alias("code"))
    money = lambda n: F.concat(F.lit("$"), F.format_number(n * 100, 0))
    count = lambda w: F.count_if(F.col("week") == F.lit(w))
    cell = lambda n: F.when(n % 5 == 0, "0").when(n % 7 == 0, "").otherwise(money(n))
    header = lambda w: f"{w.month}/{w.day}"
    rows = coded.groupBy("code").agg(
        F.count(F.lit(1)).alias("total"), *[count(w).alias(header(w)) for w in SHEET_WEEKS]
    )
    total = F.col("total")
    return rows.select(
        lookup("code", SHEET_LABELS).alias("METRIC"),
        F.lit("TEAM").alias("OWNER"),
        F.lit("100").alias("TARGET"),
        F.when(F.col("code") == "2-HIGH", "n/a").otherwise(money(total)).alias("Current Total"),
        F.lit("12%").alias("% TO TARGET"),
        *[cell(F.col(f"`{header(w)}`")).alias(header(w)) for w in SHEET_WEEKS],
        F.lit("$5").alias("13/40"),
        F.lpad(lookup("code", {c: i for i, c in enumerate(SHEET_LABELS)}).cast(S), 2, "0").alias("position"),
    )
