"""Oracle-side twins of the business model in ``sources.domain``."""

from .registry import cte

cte("x_lines", """
SELECT l_orderkey AS order_id, l_linenumber AS line_seq, l_partkey AS product_id, l_suppkey AS seller_id,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS gross,
       CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))), 2) AS DECIMAL(12,2)) AS price,
       CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(12,2)), 2) AS DECIMAL(12,2)) AS freight,
       l_quantity AS quantity, l_returnflag AS return_flag, l_linestatus AS line_status,
       CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem""")
cte("x_orders", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
       CAST(o_orderdate AS DATE) AS purchase_date,
       CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym,
       CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_orderpriority AS payment_type,
       CAST(o_orderdate AS DATE) + CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 10
         WHEN '3-MEDIUM' THEN 20 WHEN '4-NOT SPECIFIED' THEN 30 WHEN '5-LOW' THEN 45 END AS INTEGER) AS promised_date
FROM orders""")
cte("x_geo", """
SELECT n_nationkey AS nation_id, n_name AS state, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey""")
cte("x_customers", """
SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, state, region
FROM customer JOIN x_geo ON c_nationkey = nation_id""")
cte("x_products", """
SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand,
       CAST(p_retailprice AS DECIMAL(12,2)) AS list_price FROM part""")
cte("x_sellers", """
SELECT s_suppkey AS seller_id, s_name AS seller_name, state AS seller_state, region AS seller_region
FROM supplier JOIN x_geo ON s_nationkey = nation_id""")
cte("x_summary", """
SELECT order_id, count(*) AS n_lines, count(DISTINCT seller_id) AS n_sellers, sum(price) AS items_value,
       sum(freight) AS freight_value, min(ship_date) AS first_ship, max(ship_date) AS last_ship
FROM x_lines GROUP BY order_id""")
cte("x_slines", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_seq ORDER BY ship_date DESC, product_id DESC, seller_id DESC,
  price DESC, freight DESC, line_status DESC, gross DESC, quantity DESC, return_flag DESC) AS rn FROM x_lines) WHERE rn = 1""")
cte("x_held", """
SELECT order_id, status, total, CASE status WHEN 'F' THEN 'delivered without delivery date' ELSE 'cancelled with delivery date' END AS reason FROM x_orders o
WHERE (status = 'F' AND NOT EXISTS (SELECT 1 FROM x_slines l WHERE l.order_id = o.order_id))
   OR (status = 'P' AND EXISTS (SELECT 1 FROM x_slines l WHERE l.order_id = o.order_id AND l.line_status = 'F'))""")
cte("x_morders", "SELECT * FROM x_orders WHERE order_id NOT IN (SELECT order_id FROM x_held)")
cte("x_mordel", """
SELECT o.*, s.n_lines, s.n_sellers, s.items_value, s.freight_value, s.first_ship, s.last_ship, CASE WHEN status = 'F' THEN last_ship END AS delivered_date
FROM x_morders o LEFT JOIN (SELECT order_id, count(*) AS n_lines, count(DISTINCT seller_id) AS n_sellers, sum(price) AS items_value, sum(freight) AS freight_value,
  min(ship_date) AS first_ship, max(ship_date) AS last_ship FROM x_slines GROUP BY order_id) s USING (order_id)""")
cte("x_vsales", """
SELECT l.*, o.customer_id, o.status, o.purchase_date, o.ym, o.total, o.payment_type, o.promised_date,
       c.state, c.region, p.category, p.brand, p.list_price, s.seller_name, s.seller_state, s.seller_region
FROM x_slines l JOIN x_morders o USING (order_id) JOIN x_customers c USING (customer_id)
JOIN x_products p USING (product_id) JOIN x_sellers s USING (seller_id)""")
cte("x_ordel", """
SELECT o.*, s.n_lines, s.n_sellers, s.items_value, s.freight_value, s.first_ship, s.last_ship,
       CASE WHEN status = 'F' THEN last_ship END AS delivered_date
FROM x_orders o LEFT JOIN x_summary s USING (order_id)""")
cte("x_vorders", """
SELECT d.*, CAST(delivered_date - purchase_date AS INTEGER) AS delivery_days,
       CAST(delivered_date - promised_date AS INTEGER) AS days_late, delivered_date <= promised_date AS on_time,
       c.state, c.region
FROM x_mordel d JOIN x_customers c USING (customer_id)""")
cte("x_reviews", """
SELECT user_id * 100 + day(ts) AS review_id, event_id - event_id % 3 AS order_id, event_id, ts AS review_ts,
       CAST(1 + least(4, floor(value / 20)) AS INTEGER) AS score, event_type <> 'view' AS has_comment
FROM events""")
cte("x_latest", """
SELECT order_id, event_id, review_id, review_ts, score, has_comment FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY review_ts DESC, event_id DESC) AS rn FROM x_reviews)
WHERE rn = 1""")
cte("x_vreviews", """
SELECT r.event_id, r.review_id, r.review_ts, r.score, r.has_comment, v.*
FROM x_latest r JOIN x_vorders v USING (order_id)""")
cte("x_readings", """
SELECT event_id AS reading_id, event_type AS tag, ts, epoch_us(ts) AS us, user_id AS station, value,
       CAST(round(value * 100) AS BIGINT) AS centi, CAST(json_extract(props, '$.k') AS INTEGER) AS k
FROM events""")
cte("x_ops", """
SELECT event_id AS op_id, user_id AS customer, ts, epoch_us(ts) AS us, CASE WHEN user_id % 10 = 0 AND k % 5 = 0 THEN 3 ELSE k END AS shop, k % 12 AS city, k % 7 AS device,
       k % 17 AS beneficiary, k % 5 AS category, CASE WHEN k % 9 = 0 THEN 'XX' ELSE 'MX' END AS ip_country,
       event_type = 'view' AS card_present,
       CASE event_type WHEN 'view' THEN 'pos' WHEN 'signup' THEN 'transfer' ELSE 'online' END AS channel,
       CAST(round(value * 100) AS BIGINT) AS amount, event_type = 'error' AND user_id % 10 = 0 AS is_fraud,
       event_type = 'click' AND user_id % 3 <> 0 AS is_complaint
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")
