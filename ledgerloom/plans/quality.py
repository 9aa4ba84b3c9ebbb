"""Quality, quarantine, reconciliation and cleaning queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import cities
from ..functions.money import dbl, ratio
from ..operators import quality as Q
from ..session import checkpoint_dir, literals
from ..sources import domain as D
from ..sources.tables import Tables
from .kpis import MONTH_COMPLETE
from .marts import balance, load_marts
from .registry import cte, query

S = lambda c: F.col(c).cast("string")

# Official category names; the second list is the library's own fallback (fixed values of the fixture).
OFFICIAL = [("ECONOMY", "economica"), ("SMALL", "pequena"), ("LARGE", "grande"), ("STANDARD", "comun")]
OWN = [("MEDIUM", "mediana")]
FRESH_DAYS = 7
CODES = ["af", "am", "as", "eu", "mi"]


@query("p01_staging_dedup", """
SELECT order_id, line_seq, product_id, CAST(price AS DOUBLE) AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id, line_seq ORDER BY ship_date DESC, product_id DESC, seller_id DESC, price DESC) AS rn FROM x_lines)
WHERE rn = 1""")
def _(t: Tables):
    return D.staged_lines(t).select("order_id", "line_seq", "product_id", dbl("price").alias("price"))


@query("p02_category_names", """
SELECT product_id, coalesce(o.label, w.label, 'no category') AS label FROM x_products
LEFT JOIN (VALUES ('ECONOMY', 'economica'), ('SMALL', 'pequena'), ('LARGE', 'grande'), ('STANDARD', 'comun')) o(category, label) USING (category)
LEFT JOIN (VALUES ('MEDIUM', 'mediana')) w(category, label) USING (category)""")
def _(t: Tables):
    official = t.rows("category string, official string", OFFICIAL)
    own = t.rows("category string, own string", OWN)
    return D.products(t).join(F.broadcast(official), "category", "left").join(F.broadcast(own), "category", "left").select(
        "product_id", F.coalesce("official", "own", F.lit("no category")).alias("label"))


CITY = "concat('villa ', translate(CAST(n_nationkey AS STRING), '0123456789', 'abcdefghij'), 'landia')"


def seller_cities(t: Tables):
    """Sellers with a city typed by hand: every kind of dirt the rules know."""
    g = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    s = t.supplier.join(g, F.col("s_nationkey") == F.col("n_nationkey"))
    city, state = F.expr(CITY), F.lower("r_name")
    code = F.substring(state, 1, 2)
    m = F.col("s_suppkey") % 11
    dirty = (
        F.when(m == 0, F.concat(city, F.lit("/"), code)).when(m == 1, F.concat(city, F.lit(" - "), code))
        .when(m == 2, F.concat(city, F.lit(", "), state)).when(m == 3, F.lit("04482255"))
        .when(m == 4, F.lit("ventas@shop.example")).when(m == 5, code).when(m == 6, F.concat(F.substring(city, 1, 7), F.substring(city, 9, 40)))
        .when(m == 7, F.concat(city, F.lit(" "), code)).when(m == 8, F.concat(city, F.lit(" (centro)")))
        .when(m == 9, state).otherwise(F.upper(city)))
    return s.select(F.col("s_suppkey").alias("seller_id"), dirty.alias("city"), F.concat(F.lit("Z"), F.col("n_nationkey")).alias("zip"), state.alias("state"))


def geolocation(t: Tables):
    g = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(g, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("Z"), F.col("n_nationkey")).alias("zip"), F.expr(CITY).alias("city"), F.lower("r_name").alias("state"))


cte("x_scity", """
SELECT s_suppkey AS seller_id, zip, state, CASE s_suppkey % 11 WHEN 0 THEN city || '/' || code WHEN 1 THEN city || ' - ' || code WHEN 2 THEN city || ', ' || state
  WHEN 3 THEN '04482255' WHEN 4 THEN 'ventas@shop.example' WHEN 5 THEN code WHEN 6 THEN substring(city, 1, 7) || substring(city, 9, 40)
  WHEN 7 THEN city || ' ' || code WHEN 8 THEN city || ' (centro)' WHEN 9 THEN state ELSE upper(city) END AS city
FROM (SELECT s_suppkey, 'Z' || n_nationkey AS zip, lower(r_name) AS state, substring(lower(r_name), 1, 2) AS code,
             'villa ' || translate(CAST(n_nationkey AS VARCHAR), '0123456789', 'abcdefghij') || 'landia' AS city
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
cte("x_geoloc", """
SELECT 'Z' || n_nationkey AS zip, lower(r_name) AS state, 'villa ' || translate(CAST(n_nationkey AS VARCHAR), '0123456789', 'abcdefghij') || 'landia' AS city
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("x_cut", """
SELECT *, trim(regexp_replace(trim(regexp_replace(lower(city), '(/|,| - |\\().*$', '')), '\\s+(af|am|as|eu|mi)$', '')) AS c1 FROM x_scity""")
cte("x_zipcity", """
SELECT zip, city AS zip_city FROM (SELECT zip, city, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, city) AS rn FROM x_geoloc GROUP BY zip, city) WHERE rn = 1""")
cte("x_judged", """
SELECT c.*, z.zip_city, (c.c1, c.state) IN (SELECT (city, state) FROM x_geoloc) AS known,
       regexp_full_match(c.c1, '[0-9]+') OR contains(c.c1, '@') OR c.c1 IN ('af','am','as','eu','mi') OR c.c1 = c.state AS junk
FROM x_cut c LEFT JOIN x_zipcity z USING (zip)""")
cte("x_cities", """
SELECT seller_id, city, CASE WHEN junk AND NOT known AND zip_city IS NOT NULL THEN zip_city
    WHEN NOT known AND jaro_winkler_similarity(c1, zip_city) >= 0.9 THEN zip_city ELSE c1 END AS city_clean,
  CASE WHEN junk AND NOT known AND zip_city IS NOT NULL THEN 'not a city' WHEN NOT known AND jaro_winkler_similarity(c1, zip_city) >= 0.9 THEN 'typo'
    WHEN c1 <> lower(city) THEN 'cut' ELSE 'kept' END AS rule
FROM x_judged""")


@query("p03_city_cut", "SELECT seller_id, c1 AS city_cut FROM x_cut")
def _(t: Tables):
    return seller_cities(t).select("seller_id", cities.cut("city", CODES).alias("city_cut"))


@query("p04_city_not_a_city", "SELECT seller_id, zip_city FROM x_judged WHERE junk AND NOT known")
def _(t: Tables):
    return cities.clean(seller_cities(t), geolocation(t), CODES).filter("rule = 'not a city'").select(
        "seller_id", F.col("city_clean").alias("zip_city"))


@query("p05_city_similar", "SELECT seller_id, city_clean FROM x_cities WHERE rule = 'typo'")
def _(t: Tables):
    return cities.clean(seller_cities(t), geolocation(t), CODES).filter("rule = 'typo'").select("seller_id", "city_clean")


@query("q06_seller_city_fixed", "SELECT rule, count(*) AS n FROM x_cities WHERE rule <> 'kept' GROUP BY rule")
def _(t: Tables):
    return cities.clean(seller_cities(t), geolocation(t), CODES).filter("rule <> 'kept'").groupBy("rule").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ checks
def order_facts(t: Tables):
    """One row per order with everything the order checks look at, from one pass over the lines."""
    seen = lambda s: F.min(F.when(F.col("line_status") == s, F.col("ship_date")))
    facts = D.lines(t).groupBy("order_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("price") + F.col("freight")).cast("decimal(14,2)").alias("lines_due"),
        F.min("ship_date").alias("first_ship"), F.max("ship_date").alias("last_ship"), seen("F").alias("first_delivered"), seen("O").alias("first_carrier"))
    o = D.orders(t).join(facts, "order_id", "left").withColumn("approved_date", F.date_add("purchase_date", (F.col("order_id") % 5).cast("int")))
    return payment_gap(o)


def payment_gap(o):
    """Adds due, differs and the cause of a payment that differs from price plus freight."""
    o = o.withColumn("due", F.coalesce("lines_due", F.lit(0)).cast("decimal(14,2)"))
    over = (F.col("total") - F.col("due")).cast("double") / F.when(F.col("due") > 0, dbl("due"))
    return o.withColumn("differs", F.abs(F.col("total") - F.col("due")) > 0.01).withColumn(
        "cause", F.when(F.col("n_lines").isNull(), "no items").when(over.between(0.05, 0.15), "interest").otherwise("unexplained"))


def line_facts(t: Tables):
    """Lines beside their order (left, so that orphans stay) with the raw date as text, made after the lines are sent."""
    raw = t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_seq"), "l_shipdate", "l_extendedprice")
    both = raw.join(D.orders(t).select("order_id", "purchase_date"), "order_id", "left")
    return both.withColumns({"raw_date": F.col("l_shipdate").cast("string"), "ship_date": F.col("l_shipdate").cast("date")}).drop("l_shipdate")


def products_facts(t: Tables):
    known = t.rows("category string, official string", OFFICIAL)
    return t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"), "p_size").join(F.broadcast(known), "category", "left")


def seller_facts(t: Tables):
    s = D.sellers(t).withColumn("zip", F.col("seller_id") % 20)
    n = s.groupBy("zip", "seller_region").agg(F.count("*").alias("n"))
    usual = n.groupBy("zip").agg(F.min_by("seller_region", F.struct(-F.col("n"), F.col("seller_region"))).alias("zip_region"))
    return s.join(usual, "zip")


def month_facts(t: Tables):
    m = D.orders(t).groupBy("ym").agg(F.count("*").alias("n"))
    return m.withColumn("usual", literals(m.agg(F.expr("percentile(n, 0.5)").alias("usual")))["usual"])


def bases(t: Tables) -> dict:
    reviews = D.reviews(t)
    return {
        "orders": lambda: order_facts(t),
        "lines": lambda: line_facts(t),
        "line keys": lambda: D.lines(t).groupBy("order_id", "line_seq").agg(F.count("*").alias("n")),
        "products": lambda: products_facts(t),
        "sellers": lambda: seller_facts(t),
        "months": lambda: month_facts(t),
        "reviewed orders": lambda: reviews.groupBy("order_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("scores")),
        "reviews": lambda: reviews.groupBy("review_id").agg(F.count_distinct("order_id").alias("n")),
    }


CHECKS = [
    Q.Check("q01", "quarantine", "orders", "status = 'F' AND last_ship IS NULL", "order_id"),
    Q.Check("q02", "quarantine", "orders", "status = 'P' AND first_delivered IS NOT NULL", "order_id"),
    Q.Check("q03", "guard", "lines", "ship_date < purchase_date", "concat_ws('-', order_id, line_seq)", "datediff(purchase_date, ship_date)"),
    Q.Check("q04", "guard", "lines", "try_to_timestamp(raw_date) IS NULL OR l_extendedprice < 0", "order_id"),
    Q.Check("q05a", "guard", "lines", "purchase_date IS NULL", "order_id"),
    Q.Check("q05b", "guard", "line keys", "n > 1", "concat_ws('-', order_id, line_seq)", "n"),
    Q.Check("q07", "fixed", "products", "official IS NULL", "product_id", "category"),
    Q.Check("q08", "warning", "orders", "first_ship < approved_date", "order_id", "datediff(approved_date, first_ship)"),
    Q.Check("q09", "warning", "reviewed orders", "n > 1", "order_id", "scores"),
    Q.Check("q10", "warning", "products", "category = 'PROMO' OR p_size <= 1", "product_id", "CASE WHEN category = 'PROMO' THEN 'no category' ELSE 'no weight' END"),
    Q.Check("q12", "warning", "sellers", "seller_region <> zip_region", "seller_id", "zip_region"),
    Q.Check("q13", "warning", "orders", "differs AND cause = 'unexplained'", "order_id"),
    Q.Check("q14", "warning", "orders", "first_delivered < first_carrier", "order_id"),
    Q.Check("q15", "warning", "months", f"n < usual * {MONTH_COMPLETE}", "ym", "n"),
    Q.Check("q16a", "warning", "orders", "status <> 'P' AND n_lines IS NULL", "order_id"),
    Q.Check("q16b", "warning", "orders", "payment_type = '4-NOT SPECIFIED'", "order_id"),
    Q.Check("q17", "informative", "orders", "differs AND cause = 'interest'", "order_id"),
    Q.Check("q18", "informative", "reviews", "n > 1", "review_id", "n"),
]
BY_ID = {c.id: c for c in CHECKS}


def flagged(t: Tables, check_id: str):
    c = BY_ID[check_id]
    return Q.flagged(c, bases(t)[c.base]())


SQL = {
    "q01": "SELECT CAST(order_id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail FROM x_ordel WHERE status = 'F' AND last_ship IS NULL",
    "q02": "SELECT CAST(order_id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail FROM x_orders WHERE status = 'P' AND order_id IN (SELECT order_id FROM x_lines WHERE line_status = 'F')",
    "q03": "SELECT order_id || '-' || line_seq AS row_key, CAST(purchase_date - ship_date AS VARCHAR) AS detail FROM x_lines JOIN x_orders USING (order_id) WHERE ship_date < purchase_date",
    "q04": "SELECT CAST(l_orderkey AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail FROM lineitem WHERE l_shipdate IS NULL OR l_extendedprice < 0",
    "q05a": "SELECT CAST(order_id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail FROM x_lines WHERE order_id NOT IN (SELECT order_id FROM x_orders)",
    "q05b": "SELECT order_id || '-' || line_seq AS row_key, CAST(count(*) AS VARCHAR) AS detail FROM x_lines GROUP BY order_id, line_seq HAVING count(*) > 1",
    "q07": "SELECT CAST(product_id AS VARCHAR) AS row_key, category AS detail FROM x_products WHERE category NOT IN ('ECONOMY', 'SMALL', 'LARGE', 'STANDARD')",
    "q08": "SELECT CAST(order_id AS VARCHAR) AS row_key, CAST(purchase_date + CAST(order_id % 5 AS INTEGER) - first_ship AS VARCHAR) AS detail FROM x_ordel WHERE first_ship < purchase_date + CAST(order_id % 5 AS INTEGER)",
    "q09": "SELECT CAST(order_id AS VARCHAR) AS row_key, CAST(count(DISTINCT score) AS VARCHAR) AS detail FROM x_reviews GROUP BY order_id HAVING count(*) > 1",
    "q10": "SELECT CAST(p_partkey AS VARCHAR) AS row_key, CASE WHEN p_type = 'PROMO' THEN 'no category' ELSE 'no weight' END AS detail FROM part WHERE p_type = 'PROMO' OR p_size <= 1",
    "q12": """SELECT CAST(seller_id AS VARCHAR) AS row_key, zip_region AS detail FROM x_sellers s JOIN (SELECT zip, seller_region AS zip_region FROM (
  SELECT zip, seller_region, row_number() OVER (PARTITION BY zip ORDER BY n DESC, seller_region) AS rn FROM (SELECT seller_id % 20 AS zip, seller_region, count(*) AS n FROM x_sellers GROUP BY 1, 2)) WHERE rn = 1) z
  ON z.zip = s.seller_id % 20 WHERE seller_region <> zip_region""",
    "q13": "SELECT CAST(order_id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail FROM x_gap WHERE cause = 'unexplained'",
    "q14": "SELECT CAST(order_id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail FROM x_lines GROUP BY order_id HAVING min(ship_date) FILTER (line_status = 'F') < min(ship_date) FILTER (line_status = 'O')",
    "q15": f"SELECT CAST(ym AS VARCHAR) AS row_key, CAST(n AS VARCHAR) AS detail FROM (SELECT ym, count(*) AS n FROM x_orders GROUP BY ym) WHERE n < (SELECT median(n) FROM (SELECT count(*) AS n FROM x_orders GROUP BY ym)) * {MONTH_COMPLETE}",
    "q16a": "SELECT CAST(order_id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail FROM x_ordel WHERE status <> 'P' AND n_lines IS NULL",
    "q16b": "SELECT CAST(order_id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail FROM x_orders WHERE payment_type = '4-NOT SPECIFIED'",
    "q17": "SELECT CAST(order_id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail FROM x_gap WHERE cause = 'interest'",
    "q18": "SELECT CAST(review_id AS VARCHAR) AS row_key, CAST(count(DISTINCT order_id) AS VARCHAR) AS detail FROM x_reviews GROUP BY review_id HAVING count(DISTINCT order_id) > 1",
}
cte("x_gap", """
SELECT *, CASE WHEN n_lines IS NULL THEN 'no items' WHEN (CAST(total AS DOUBLE) - CAST(due AS DOUBLE)) / nullif(CAST(due AS DOUBLE), 0) BETWEEN 0.05 AND 0.15 THEN 'interest' ELSE 'unexplained' END AS cause
FROM (SELECT *, coalesce(items_value + freight_value, 0) AS due FROM x_ordel) WHERE abs(total - due) > 0.01""")

TITLES = {
    "q01": "delivered_without_date", "q02": "cancelled_with_delivery", "q03": "shipped_before_purchase", "q04": "unreadable_or_negative",
    "q05a": "orphan_lines", "q05b": "duplicate_lines", "q07": "untranslated_category", "q08": "shipped_before_approval", "q09": "several_reviews",
    "q10": "incomplete_product", "q12": "seller_state_differs", "q13": "payment_unexplained", "q14": "delivered_before_carrier",
    "q15": "incomplete_months", "q16a": "active_without_items", "q16b": "payment_not_defined", "q17": "paid_interest", "q18": "shared_reviews"}
for _check in CHECKS:
    query(f"{_check.id}_{TITLES[_check.id]}", SQL[_check.id])(lambda t, c=_check.id: flagged(t, c))


@query("q08b_approval_lead", """
SELECT count(*) AS n, median(purchase_date + CAST(order_id % 5 AS INTEGER) - first_ship) AS median_days
FROM x_ordel WHERE first_ship < purchase_date + CAST(order_id % 5 AS INTEGER)""")
def _(t: Tables):
    # Days are few distinct whole numbers: count them first, then one small exact percentile.
    d = flagged(t, "q08").groupBy(F.col("detail").cast("int").alias("d")).agg(F.count("*").alias("k"))
    return d.agg(F.sum("k").alias("n"), F.expr("percentile(d, 0.5, k)").alias("median_days"))


@query("q11_shipped_early_months", """
SELECT CAST(year(ship_date) * 100 + month(ship_date) AS INTEGER) AS ship_ym, count(*) AS n, CAST(median(purchase_date - ship_date) AS DOUBLE) AS median_days
FROM x_lines JOIN x_orders USING (order_id) WHERE ship_date < purchase_date GROUP BY 1""")
def _(t: Tables):
    j = D.lines(t).join(D.orders(t).select("order_id", "purchase_date"), "order_id").filter("ship_date < purchase_date")
    g = j.groupBy(D.ym("ship_date").alias("ship_ym"), F.datediff("purchase_date", "ship_date").alias("d")).agg(F.count("*").alias("k"))
    return g.groupBy("ship_ym").agg(F.sum("k").alias("n"), F.expr("percentile(d, 0.5, k)").alias("median_days"))


@query("q13b_payment_causes", """
SELECT cause, count(*) AS n, CAST(sum(total) AS DOUBLE) AS paid, CAST(sum(due) AS DOUBLE) AS due FROM x_gap GROUP BY cause""")
def _(t: Tables):
    return order_facts(t).filter("differs").groupBy("cause").agg(F.count("*").alias("n"), dbl(F.sum("total")).alias("paid"), dbl(F.sum("due")).alias("due"))


@query("j04_orders_without_lines", """
SELECT order_id, status FROM x_orders WHERE order_id NOT IN (SELECT order_id FROM x_lines)""")
def _(t: Tables):
    return D.orders(t).join(D.lines(t).select("order_id"), "order_id", "left_anti").select("order_id", "status")


def marts(t: Tables):
    return load_marts(t, f"{checkpoint_dir(t.spark)}/out/marts-{uuid.uuid4().hex}")


@query("q19_quarantined_orders", "SELECT order_id, reason, CAST(total AS DOUBLE) AS total FROM x_held")
def _(t: Tables):
    return marts(t).get("quarantine_orders").select("order_id", "reason", dbl("total").alias("total"))


@query("j05_quarantine_cascade", """
SELECT 'lines ' || CASE WHEN order_id IN (SELECT order_id FROM x_held) THEN 'held' ELSE 'kept' END AS side, count(*) AS n, CAST(sum(price) AS DOUBLE) AS money FROM x_slines GROUP BY 1
UNION ALL SELECT 'reviews ' || CASE WHEN order_id IN (SELECT order_id FROM x_held) THEN 'held' ELSE 'kept' END, count(*), CAST(sum(score) AS DOUBLE) FROM x_latest WHERE order_id IN (SELECT order_id FROM x_orders) GROUP BY 1""")
def _(t: Tables):
    w = marts(t)
    n = lambda df, s, c: df.agg(F.count("*").alias("n"), dbl(F.sum(c)).alias("money")).select(F.lit(s).alias("side"), "n", "money")
    latest = D.latest_reviews(t)
    sides = [n(w.get("v_sales"), "lines kept", "price"), n(w.get("quarantine_lines"), "lines held", "price"),
             n(latest.join(w.get("v_orders").select("order_id"), "order_id"), "reviews kept", "score"),
             n(latest.join(w.get("quarantine_orders").select("order_id"), "order_id"), "reviews held", "score")]
    return reduce(DataFrame.unionByName, sides)


@query("q20_reconciliation", """
SELECT 'orders' AS fact, (SELECT count(*) FROM x_orders) AS n_staging, (SELECT count(*) FROM x_morders) AS n_marts, (SELECT count(*) FROM x_held) AS n_quarantine,
  CAST((SELECT sum(total) FROM x_orders) AS DOUBLE) AS m_staging, (SELECT sum(total) FROM x_orders) = (SELECT sum(total) FROM x_morders) + (SELECT sum(total) FROM x_held) AS balanced
UNION ALL SELECT 'lines', (SELECT count(*) FROM x_slines), (SELECT count(*) FROM x_vsales), (SELECT count(*) FROM x_slines WHERE order_id IN (SELECT order_id FROM x_held)),
  CAST((SELECT sum(price) FROM x_slines) AS DOUBLE), (SELECT sum(price) FROM x_slines) = (SELECT sum(price) FROM x_vsales) + (SELECT sum(price) FROM x_slines WHERE order_id IN (SELECT order_id FROM x_held))""")
def _(t: Tables):
    return balance(marts(t)).select("fact", "n_staging", "n_marts", "n_quarantine", dbl("m_staging").alias("m_staging"), "balanced")


@query("u02_difference", """
SELECT 'left' AS side, order_id, status FROM (SELECT order_id, status FROM x_orders EXCEPT ALL (SELECT order_id, status FROM x_morders UNION ALL SELECT order_id, status FROM x_held))""")
def _(t: Tables):
    w = marts(t)
    written = w.get("v_orders").select("order_id", "status").unionByName(w.get("quarantine_orders").select("order_id", "status"))
    return Q.difference(D.orders(t).select("order_id", "status"), written).select("side", "order_id", "status")


@query("q21_report", " UNION ALL ".join(
    f"SELECT '{c.id}' AS check_id, '{c.severity}' AS severity, count(*) AS n FROM ({SQL[c.id]})" for c in CHECKS))
def _(t: Tables):
    return Q.report(CHECKS, bases(t))


@query("q22_freshness", """
SELECT source, CAST(last_day AS VARCHAR) AS last_day, last_day >= max(last_day) OVER () - 7 AS is_fresh FROM (
  SELECT 'orders' AS source, max(purchase_date) AS last_day FROM x_orders UNION ALL SELECT 'lines', max(ship_date) FROM x_lines UNION ALL SELECT 'readings', CAST(max(ts) AS DATE) FROM events)""")
def _(t: Tables):
    last = lambda name, df, c: df.agg(F.max(F.col(c).cast("date")).alias("d")).select(F.lit(name).alias("source"), "d")
    u = last("orders", D.orders(t), "purchase_date").unionByName(last("lines", D.lines(t), "ship_date")).unionByName(last("readings", t.events, "ts"))
    # Today is the last day any source knows; a source a week behind it is late.
    today = literals(u.agg(F.max("d").alias("today")))["today"]
    return u.select("source", S("d").alias("last_day"), (F.col("d") >= F.date_sub(today, FRESH_DAYS)).alias("is_fresh"))


@query("p12_today", "SELECT CAST(greatest((SELECT max(purchase_date) FROM x_orders), (SELECT max(ship_date) FROM x_lines), (SELECT CAST(max(ts) AS DATE) FROM events)) AS VARCHAR) AS today")
def _(t: Tables):
    days = D.orders(t).select(F.max("purchase_date").alias("d")).unionByName(D.lines(t).select(F.max("ship_date").alias("d"))).unionByName(
        t.events.select(F.max(F.col("ts").cast("date")).alias("d")))
    return days.agg(F.max("d").cast("string").alias("today"))


@query("p13_row_rejects", """
SELECT order_id, line_seq, concat_ws('; ', CASE WHEN ship_date < purchase_date THEN 'shipped before the order' END,
   CASE WHEN quantity > 45 THEN 'quantity out of range' END, CASE WHEN freight = 0 AND line_status = 'O' THEN 'open without freight' END) AS reasons
FROM x_lines JOIN x_orders USING (order_id)
WHERE ship_date < purchase_date OR quantity > 45 OR (freight = 0 AND line_status = 'O')""")
def _(t: Tables):
    j = D.lines(t).join(D.orders(t).select("order_id", "purchase_date"), "order_id")
    out = Q.split_valid(j, {
        "shipped before the order": F.col("ship_date") < F.col("purchase_date"),
        "quantity out of range": F.col("quantity") > 45,
        "open without freight": (F.col("freight") == 0) & (F.col("line_status") == "O")})
    return out.filter(F.size("reasons") > 0).select("order_id", "line_seq", F.concat_ws("; ", "reasons").alias("reasons"))
