"""The input roles again, in SQL, for the check queries.

Written independently of ``sources.roles``: JSON roles are given as plain columns
here, so a check never depends on the JSON the Spark side builds and parses.
"""

TEXT = """CASE p_type WHEN 'STANDARD' THEN '5mg 12oz Seltzer Spicy Lime' WHEN 'MEDIUM' THEN '10mg 16 oz'
  WHEN 'LARGE' THEN '5mg 750ml Bottle Citrus' WHEN 'PROMO' THEN '25mg 750ml Bottle Cranberry'
  WHEN 'SMALL' THEN '10mg 2oz Shot Variety' WHEN 'ECONOMY' THEN 'Lemonade Original' END"""

ACCOUNT_TYPE = """CASE c_mktsegment WHEN 'BUILDING' THEN 'Distributor' WHEN 'MACHINERY' THEN 'Distribution Center'
  WHEN 'FURNITURE' THEN 'Key Account' WHEN 'HOUSEHOLD' THEN 'Retailer' END"""

ORDER_STATUS = """CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'Draft'
  WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'Cancelled' ELSE 'Activated' END"""

STATE = "chr(CAST(65 + n_nationkey AS INTEGER)) || chr(CAST(65 + n_regionkey AS INTEGER))"

PLACED = "o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))"

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

ROLE_SQL = {
    "distributor": """
SELECT 'D' || s_suppkey AS distributor_code, s_name AS distributor_name, 'A' || s_suppkey AS sf_account_id,
  'A' || (100 + s_nationkey) AS parent_sf_account_id, s_acctbal < 1000 AS is_parent_rollup,
  CAST(greatest(floor(s_acctbal), 0) AS BIGINT) AS total_retailers
FROM supplier""",
    "distributor_state": f"""
SELECT 'D' || s_suppkey AS distributor_id, {STATE} AS state
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "item": f"""
SELECT 'I' || p_partkey AS supplier_item, p_name || ' ' || {TEXT} AS "desc", p_brand AS brand_desc,
  CASE WHEN p_size > 45 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS units,
  CASE p_type WHEN 'STANDARD' THEN '5mg 12oz Seltzer' WHEN 'MEDIUM' THEN '10mg 16oz Seltzer'
    WHEN 'LARGE' THEN '5mg 750ml Bottle' WHEN 'PROMO' THEN '25mg 750ml Bottle'
    WHEN 'SMALL' THEN '10mg 2oz Shot' WHEN 'ECONOMY' THEN 'Other' END AS category,
  TIMESTAMP '2001-06-01' AS extracted_at
FROM part
UNION ALL
SELECT 'I' || p_partkey, p_name, p_brand, CAST(p_size + 1 AS VARCHAR), NULL, TIMESTAMP '2001-01-01'
FROM part""",
    "item_now": """
SELECT supplier_item AS item_code, "desc" AS item_desc, brand_desc, category, TRY_CAST(units AS BIGINT) AS units_per_case
FROM (SELECT *, row_number() OVER (PARTITION BY supplier_item ORDER BY extracted_at DESC) AS rn FROM item)
WHERE rn = 1""",
    "sku_map": """
SELECT 'I' || p_partkey AS sf_sku, CAST(p_size AS BIGINT) AS pack_size FROM part""",
    "account": f"""
SELECT 'A' || c_custkey AS id, 'U' || c_nationkey AS owner_id,
  CASE WHEN c_acctbal < 500 THEN NULL WHEN c_acctbal < 800 THEN '  ' ELSE ' ' || lower({STATE}) END AS shipping_state
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "app_user": """
SELECT 'U' || n_nationkey AS id, n_name AS name FROM nation""",
    "b2b_order_line": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'A' || o_custkey AS account_id, c_name AS customer_name,
  {ACCOUNT_TYPE} AS account_type, {ORDER_STATUS} AS order_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Event Sample Book' WHEN '3-MEDIUM' THEN 'Suggested Retail'
    WHEN '2-HIGH' THEN NULL ELSE 'Standard' END AS pricebook_name,
  'I' || l_partkey AS sku, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total_price, CAST(o_orderdate AS DATE) AS order_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "b2b_norm": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'A' || o_custkey AS account_id, c_name AS customer_name,
  {ACCOUNT_TYPE} AS account_type, {ORDER_STATUS} AS order_status, 'I' || l_partkey AS product_code,
  CASE WHEN p_size > 2 THEN p_name || ' ' || {TEXT} END AS product_name,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS line_revenue, CAST(l_quantity AS BIGINT) AS units_qty,
  CAST(o_orderdate AS DATE) AS order_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  LEFT JOIN part ON l_partkey = p_partkey""",
    "invoice": """
SELECT CAST(o_orderdate AS DATE) AS txn_date, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amt FROM orders""",
    "credit_line": """
SELECT CAST(l_shipdate AS DATE) AS txn_date,
  CASE WHEN l_linestatus = 'F' THEN 'Income:Refunds' WHEN l_linenumber <= 3 THEN 'Income:Discounts'
    ELSE 'Income:Sales' END AS account_name,
  CASE WHEN l_linenumber = 7 THEN 'SubTotalLineDetail' ELSE 'SalesItemLineDetail' END AS detail_type,
  CASE WHEN l_tax = 0.08 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount
FROM lineitem WHERE l_returnflag = 'R'""",
    "sell_through_raw": """
SELECT 'D' || l_suppkey AS dist_code,
  CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN '99Z1' WHEN l_linenumber = 7 AND l_discount = 0 THEN 'XXXXXX'
    ELSE 'I' || l_partkey END AS item_code,
  'S' || o_custkey AS acct_code,
  CASE WHEN l_returnflag = 'A' THEN 'C' WHEN l_returnflag = 'N' THEN 'B' WHEN l_linestatus = 'F' THEN 'X' END AS uom,
  CASE WHEN l_linenumber = 7 AND l_tax = 0.08 THEN 'abc' WHEN l_linenumber = 7 AND l_tax = 0.07 THEN '-3'
    ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty,
  CASE WHEN l_linenumber = 7 AND l_tax = 0.06 THEN '20010231'
    ELSE strftime(l_shipdate, '%Y%m%d') END AS invoice_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "sold": """
SELECT dist_code, s.item_code, acct_code, uom, TRY_CAST(qty AS BIGINT) AS qty, i.item_desc, i.brand_desc, i.category,
  CAST(try_strptime(invoice_date, '%Y%m%d') AS DATE) AS sale_date,
  TRY_CAST(qty AS BIGINT) * CASE WHEN uom = 'B' THEN 1 ELSE coalesce(i.units_per_case, 6) END AS units
FROM sell_through_raw s LEFT JOIN item_now i ON s.item_code = i.item_code
WHERE TRY_CAST(qty AS BIGINT) > 0 AND s.item_code NOT LIKE '99Z%' AND s.item_code <> 'XXXXXX'""",
    "door": f"""
SELECT 'S' || c_custkey AS vip_id, c_name AS store_name, 'City ' || (c_custkey % 97) AS city, {STATE} AS state,
  CASE WHEN c_acctbal >= 500 THEN substr(c_mktsegment, 1, 2) || (c_nationkey % 5) END AS chain_code,
  CASE WHEN c_acctbal >= 500 THEN c_mktsegment || ' ' || (c_nationkey % 5) END AS chain_name,
  lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip, c_mktsegment AS class_of_trade_name,
  CASE WHEN c_custkey % 3 = 0 THEN 'On-Premise' ELSE 'Off-Premise' END AS channel_type,
  'A' || c_custkey AS sf_account_id, c_name AS sf_account_name,
  CASE WHEN c_custkey % 11 <> 0 THEN 'Owner ' || (c_custkey % 6) END AS sf_owner_name,
  CASE WHEN c_acctbal < 9000 THEN c_nationkey * CAST(0.5 AS DOUBLE) + 25 END AS google_latitude,
  c_nationkey * CAST(2.0 AS DOUBLE) - 120 AS google_longitude
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "web_order": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id, {PLACED} AS created_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN {PLACED} + INTERVAL 1 DAY END AS cancelled_at,
  CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN '  '
    ELSE 'cust' || o_custkey || '@example.com' END AS email,
  CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'partially_refunded'
    WHEN o_orderpriority = '5-LOW' THEN 'pending' ELSE 'refunded' END AS financial_status,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total_price,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total_line_items_price,
  CAST(floor(o_totalprice / 10) AS DECIMAL(18,2)) AS total_discounts,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) - CAST(floor(o_totalprice / 10) AS DECIMAL(18,2))
    - CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice / 20) AS DECIMAL(18,2)) ELSE 0 END
    AS DECIMAL(18,2)) AS current_subtotal_price,
  CASE WHEN o_custkey % 13 <> 0 THEN ' ' || chr(CAST(97 + o_custkey % 25 AS INTEGER)) || 'x' ELSE '' END AS province_code,
  CASE WHEN o_custkey % 10 = 0 THEN 'CA' ELSE 'US' END AS country_code,
  CAST(timezone('America/Los_Angeles', timezone('UTC', {PLACED})) AS DATE) AS local_day
FROM orders""",
    "web_line": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id,
  CAST(timezone('America/Los_Angeles', timezone('UTC', {PLACED})) AS DATE) AS local_day,
  CASE WHEN p_size > 2 THEN p_name || ' ' || {TEXT} END AS title, 'I' || l_partkey AS sku,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
  CASE WHEN l_discount > 0 THEN CAST(floor(l_extendedprice * l_discount) AS DECIMAL(18,2)) ELSE 0 END AS total_discount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
WHERE l_linenumber <> 7 AND NOT (l_linenumber = 6 AND l_tax = 0.08)""",
    "legacy_order": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN ' ' || upper('cust' || o_custkey || '@example.com') || ' '
    WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN ''
    ELSE 'cust' || o_custkey || '@example.com' END AS billing_email,
  CASE WHEN o_orderstatus = 'O' THEN 'refunded' WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'failed'
    ELSE 'completed' END AS status,
  {PLACED} AS date_created,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(o_orderkey % 4 AS DECIMAL(18,2)) * CAST(0.5 AS DECIMAL(3,1))
    AS DECIMAL(18,2)) AS total
FROM orders WHERE o_orderdate < DATE '1999-01-01'""",
    "d2c_order": """
SELECT CAST(o_orderdate AS DATE) AS order_date, CAST(o_totalprice AS DECIMAL(18,2)) AS subtotal,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'amazon' ELSE 'shopify' END AS channel,
  CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'partially_refunded'
    ELSE 'pending' END AS financial_status
FROM orders""",
    "shipment": f"""
SELECT order_id, replace(order_id, 'O', 'N') AS order_number, fulfillment_status,
  CASE WHEN fulfillment_status = 'shipped' THEN order_carrier END AS shipment_carrier, order_carrier, ship_state,
  ship_country, tracking_number, order_total, shipment_cost, days_to_ship, order_date
FROM (SELECT 'O' || (event_id // 2) AS order_id,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'cancelled' ELSE 'shipped' END AS fulfillment_status,
  CASE user_id % 7 WHEN 0 THEN 'ups_walleted' WHEN 1 THEN 'ups' WHEN 2 THEN 'stamps_com' WHEN 3 THEN 'fedex'
    WHEN 4 THEN 'globalpost' WHEN 5 THEN 'dhl_express' END AS order_carrier,
  chr(CAST(65 + user_id % 25 AS INTEGER)) || 'S' AS ship_state,
  CASE WHEN user_id % 10 = 0 THEN 'CA' ELSE 'US' END AS ship_country, 'T' || event_id AS tracking_number,
  value AS order_total, {K} / CAST(10 AS DOUBLE) AS shipment_cost, {K} % 9 AS days_to_ship,
  CAST(ts - to_days(CAST(user_id % 10 * 10 AS INTEGER)) AS DATE) AS order_date
FROM events)""",
    "ticket": f"""
SELECT ticket_id, status, csat_score, CASE WHEN is_resolved THEN value END AS resolution_minutes_business,
  is_resolved AND value < 50 AS resolved_same_day, is_resolved, value < 60 AS first_response_under_1hr,
  created_at, CAST(created_at AS DATE) AS created_date, dayname(created_at) AS created_day_of_week,
  CAST(hour(created_at) AS INTEGER) AS created_hour, agent_name, tag
FROM (SELECT event_id AS ticket_id, value,
  CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'open' WHEN 'click' THEN 'pending'
    WHEN 'purchase' THEN 'solved' ELSE 'closed' END AS status,
  CASE WHEN {K} < 40 THEN 'good' WHEN {K} < 55 THEN 'bad' ELSE 'offered' END AS csat_score,
  event_type IN ('purchase', 'error') AS is_resolved,
  ts - to_days(CAST(user_id % 10 * 30 AS INTEGER)) AS created_at, 'agent ' || (user_id % 12) AS agent_name,
  CASE user_id % 8 WHEN 0 THEN 'address_change' WHEN 1 THEN 'wrongaddress' WHEN 2 THEN 'order_status'
    WHEN 3 THEN 'reship' WHEN 4 THEN 'protectly' WHEN 5 THEN 'reshipment' WHEN 6 THEN 'billing'
    ELSE 'refund' END AS tag
FROM events)""",
    "mention": """
SELECT event_type || ' ' || (user_id % 20) AS entity_name,
  CASE event_type WHEN 'signup' THEN 'brand' WHEN 'view' THEN 'flavor' WHEN 'click' THEN 'ingredient'
    WHEN 'purchase' THEN 'category' ELSE 'brand' END AS entity_type,
  CASE user_id % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'reddit' WHEN 2 THEN 'youtube_noapi' WHEN 3 THEN 'tiktok'
    ELSE 'bing' END AS source_engine,
  'https://example.org/m/' || event_id AS url, ts AS harvested_at
FROM events""",
    "text_mention": """
SELECT lang AS entity_name, source AS source_engine, 'https://example.org/d/' || doc_id AS url,
  source || ' ' || doc_id AS title, text AS snippet,
  TIMESTAMP '2024-01-31' - to_days(CAST(doc_id % 28 AS INTEGER)) AS harvested_at
FROM documents""",
    "sheet_cell": """
SELECT code, label, position, week, total,
  CASE WHEN n % 5 = 0 THEN '0' WHEN n % 7 = 0 THEN '' ELSE '$' || format('{:,}', n * 100) END AS cell
FROM (
  SELECT l.code, label, position, w.week, count(o.code) FILTER (WHERE o.week = w.week) AS n, count(o.code) AS total
  FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'F', 'O', 'P', '0', '1']) AS code,
      unnest(['Urgent Orders Spring', 'High Priority', '', 'Unspecified Orders', 'Unlisted Metric', 'Buying Doors',
        'Open Orders', 'Retail To Date', 'Even Buyer Orders', 'even buyer orders (final)']) AS label,
      unnest(range(0, 10)) AS position) l
    CROSS JOIN (SELECT CAST(unnest(range(DATE '2001-04-02', DATE '2001-07-02', INTERVAL 7 DAY)) AS DATE) AS week) w
    JOIN (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
        unnest([o_orderpriority, o_orderstatus, CAST(o_custkey % 2 AS VARCHAR)]) AS code
      FROM orders WHERE o_orderdate >= DATE '2001-04-02' AND o_orderdate < DATE '2001-07-02') o ON o.code = l.code
  GROUP BY ALL)""",
}
