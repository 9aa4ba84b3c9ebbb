"""KPI queries: the wide datasets, the KPI engine and its cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dbl, ratio
from ..operators import kpi as K
from ..session import literals
from ..sources import domain as D
from ..sources.tables import Tables
from .registry import query

iso = lambda c: F.col(c).cast("string").alias(c)


@query("j01_wide_sales", """
SELECT order_id, line_seq, product_id, seller_id, customer_id, status, CAST(purchase_date AS VARCHAR) AS purchase_date, ym,
       CAST(price AS DOUBLE) AS price, CAST(freight AS DOUBLE) AS freight, state, region, category, brand, seller_region,
       CAST(ship_date AS VARCHAR) AS ship_date
FROM x_vsales""")
def _(t: Tables):
    return D.v_sales(t).select(
        "order_id", "line_seq", "product_id", "seller_id", "customer_id", "status", iso("purchase_date"), "ym",
        dbl("price").alias("price"), dbl("freight").alias("freight"), "state", "region", "category", "brand",
        "seller_region", iso("ship_date"))


@query("p08_order_columns", """
SELECT order_id, status, CAST(delivery_days AS DOUBLE) AS delivery_days, CAST(days_late AS DOUBLE) AS days_late,
       coalesce(CAST(on_time AS VARCHAR), 'open') AS on_time, CAST(delivered_date AS VARCHAR) AS delivered_date FROM x_ordel_days""")
def _(t: Tables):
    return D.v_orders(t, ()).select(
        "order_id", "status", dbl("delivery_days").alias("delivery_days"), dbl("days_late").alias("days_late"),
        F.coalesce(F.col("on_time").cast("string"), F.lit("open")).alias("on_time"), iso("delivered_date"))


@query("p08b_review_columns", """
SELECT r.event_id, r.score, r.has_comment,
       CAST(date_diff('second', CAST(o.purchase_date AS TIMESTAMP), date_trunc('second', r.review_ts)) // 3600 AS BIGINT) AS answer_hours
FROM x_reviews r JOIN x_orders o USING (order_id)""")
def _(t: Tables):
    hours = F.floor(
        F.timestamp_diff("SECOND", F.col("purchase_date").cast("timestamp"), F.date_trunc("second", F.col("review_ts").cast("timestamp")))
        / 3600)
    return D.reviews(t).join(D.orders(t), "order_id").select(
        "event_id", "score", "has_comment", hours.cast("bigint").alias("answer_hours"))


KPI_BY_REGION = """
SELECT region, 'sales' AS kpi, round(CAST(sum(price) FILTER (status <> 'P') AS DOUBLE), 6) AS value FROM x_vsales GROUP BY region
UNION ALL SELECT region, 'ticket', round(CAST(sum(price) FILTER (status <> 'P') AS DOUBLE) / count(DISTINCT order_id) FILTER (status <> 'P'), 6) FROM x_vsales GROUP BY region
UNION ALL SELECT region, 'freight_share', round(CAST(sum(freight) FILTER (status <> 'P') AS DOUBLE) / CAST(sum(price) FILTER (status <> 'P') AS DOUBLE), 6) FROM x_vsales GROUP BY region
UNION ALL SELECT region, 'active_sellers', count(DISTINCT seller_id) FILTER (status <> 'P') FROM x_vsales GROUP BY region
UNION ALL SELECT region, 'orders', count(*) FILTER (status <> 'P') FROM x_vorders GROUP BY region
UNION ALL SELECT region, 'on_time', round(CAST(count(*) FILTER (on_time) AS DOUBLE) / nullif(count(delivered_date), 0), 6) FROM x_vorders GROUP BY region
UNION ALL SELECT region, 'delivery_days', round(CAST(sum(delivery_days) AS DOUBLE) / nullif(count(delivery_days), 0), 6) FROM x_vorders GROUP BY region
UNION ALL SELECT region, 'cancel_rate', round(CAST(count(*) FILTER (status = 'P') AS DOUBLE) / count(*), 6) FROM x_vorders GROUP BY region
UNION ALL SELECT region, 'customers', count(DISTINCT customer_id) FROM x_vorders WHERE status <> 'P' GROUP BY region
UNION ALL SELECT region, 'repurchase', round(CAST(count(*) FILTER (n >= 2) AS DOUBLE) / count(*), 6) FROM x_custorders GROUP BY region
UNION ALL SELECT region, 'rating', round(CAST(sum(score) AS DOUBLE) / count(score), 6) FROM x_vreviews GROUP BY region
UNION ALL SELECT region, 'negative_reviews', round(CAST(count(*) FILTER (score <= 2) AS DOUBLE) / count(score), 6) FROM x_vreviews GROUP BY region"""

from .registry import cte

cte("x_ordel_days", """
SELECT *, CAST(delivered_date - purchase_date AS INTEGER) AS delivery_days,
       CAST(delivered_date - promised_date AS INTEGER) AS days_late, delivered_date <= promised_date AS on_time FROM x_mordel""")
cte("x_custorders", "SELECT region, customer_id, count(*) AS n FROM x_vorders WHERE status <> 'P' GROUP BY ALL")
cte("x_goals", """
SELECT * FROM (VALUES ('freight_share', 0.20, false), ('on_time', 0.90, true), ('cancel_rate', 0.02, false),
  ('rating', 4.0, true), ('negative_reviews', 0.15, false)) g(kpi, target, up)""")

JUDGED = """SELECT k.*, CAST(g.target AS DOUBLE) AS target, CASE WHEN g.up IS NULL THEN 'no target' WHEN g.up = (value >= g.target) OR value = g.target THEN 'met' ELSE 'missed' END AS met
FROM k LEFT JOIN x_goals g USING (kpi)"""


@query("k00_kpi_by_region", f"WITH k AS ({KPI_BY_REGION})\n{JUDGED}")
def _(t: Tables):
    return K.kpis(K.datasets(t), by=["region"])


@query("p07_kpi_filtered", """
WITH k AS (
SELECT 'sales' AS kpi, round(CAST(sum(price) FILTER (status <> 'P') AS DOUBLE), 6) AS value FROM x_vsales
  WHERE purchase_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND region IN ('ASIA', 'EUROPE') AND category = 'PROMO'
UNION ALL
SELECT 'freight_share', round(CAST(sum(freight) FILTER (status <> 'P') AS DOUBLE) / CAST(sum(price) FILTER (status <> 'P') AS DOUBLE), 6) FROM x_vsales
  WHERE purchase_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND region IN ('ASIA', 'EUROPE') AND category = 'PROMO')
""" + JUDGED)
def _(t: Tables):
    return K.kpis(K.datasets(t, ("customer", "product")), ["sales", "freight_share"], filters={
        "purchase_date": ("1997-01-01", "1998-12-31"), "region": ["ASIA", "EUROPE"], "category": "PROMO"})


def one(name: str, kpi: str, by: str, sql: str):
    """A KPI on its own by one cut, as a wide table."""
    dims = {"category": ("product",), "brand": ("product",), "region": ("customer",), "state": ("customer",)}.get(by, ())

    @query(name, sql)
    def _(t: Tables):
        k = K.REGISTRY[kpi]
        ds = K.datasets(t, dims)["orders" if k.dataset == "customers" else k.dataset]()
        if k.dataset == "customers":
            ds = K.customer_counts(ds, [by])
        return K.evaluate_wide(ds, [kpi], [by])


one("k01_sales_by_month", "sales", "ym", "SELECT ym, CAST(sum(price) FILTER (status <> 'P') AS DOUBLE) AS sales FROM x_vsales GROUP BY ym")
one("k03_orders_by_month", "orders", "ym", "SELECT ym, CAST(count(*) FILTER (status <> 'P') AS DOUBLE) AS orders FROM x_vorders GROUP BY ym")
one("k04_ticket_by_category", "ticket", "category",
    "SELECT category, round(CAST(sum(price) FILTER (status <> 'P') AS DOUBLE) / count(DISTINCT order_id) FILTER (status <> 'P'), 6) AS ticket FROM x_vsales GROUP BY category")
one("k05_customers_by_month", "customers", "ym", "SELECT ym, CAST(count(DISTINCT customer_id) AS DOUBLE) AS customers FROM x_vorders WHERE status <> 'P' GROUP BY ym")
one("k06_repurchase_by_state", "repurchase", "state",
    "SELECT state, round(CAST(count(*) FILTER (n >= 2) AS DOUBLE) / count(*), 6) AS repurchase FROM (SELECT state, customer_id, count(*) AS n FROM x_vorders WHERE status <> 'P' GROUP BY ALL) GROUP BY state")
one("k07_on_time_by_region", "on_time", "region",
    "SELECT region, round(CAST(count(*) FILTER (on_time) AS DOUBLE) / nullif(count(delivered_date), 0), 6) AS on_time FROM x_vorders GROUP BY region")
one("k08_delivery_days_by_payment_type", "delivery_days", "payment_type",
    "SELECT payment_type, round(CAST(sum(delivery_days) AS DOUBLE) / count(delivery_days), 6) AS delivery_days FROM x_vorders GROUP BY payment_type")
one("k09_freight_share_by_seller", "freight_share", "seller_id",
    "SELECT seller_id, round(CAST(sum(freight) FILTER (status <> 'P') AS DOUBLE) / CAST(sum(price) FILTER (status <> 'P') AS DOUBLE), 6) AS freight_share FROM x_vsales GROUP BY seller_id")
one("k10_cancel_rate_by_month", "cancel_rate", "ym",
    "SELECT ym, round(CAST(count(*) FILTER (status = 'P') AS DOUBLE) / count(*), 6) AS cancel_rate FROM x_vorders GROUP BY ym")
one("k11_rating_by_region", "rating", "region",
    "SELECT region, round(CAST(sum(score) AS DOUBLE) / count(score), 6) AS rating FROM x_vreviews GROUP BY region")
one("k12_negative_reviews_by_month", "negative_reviews", "ym",
    "SELECT ym, round(CAST(count(*) FILTER (score <= 2) AS DOUBLE) / count(score), 6) AS negative_reviews FROM x_vreviews GROUP BY ym")
one("k13_active_sellers_by_month", "active_sellers", "ym",
    "SELECT ym, CAST(count(DISTINCT seller_id) FILTER (status <> 'P') AS DOUBLE) AS active_sellers FROM x_vsales GROUP BY ym")


@query("k17_change_by_region_month", """
WITH m AS (SELECT region, ym, CAST(ym // 100 * 12 + ym % 100 - 1 AS INTEGER) AS mi, CAST(sum(price) FILTER (status <> 'P') AS DOUBLE) AS sales
           FROM x_vsales GROUP BY region, ym)
SELECT a.region, a.ym, a.sales, round((a.sales - b.sales) / b.sales, 6) AS vs_previous, round((a.sales - c.sales) / c.sales, 6) AS vs_last_year,
       coalesce((a.sales - b.sales) / b.sales < -0.15, false) AS dropped
FROM m a LEFT JOIN m b ON a.region = b.region AND a.mi = b.mi + 1 LEFT JOIN m c ON a.region = c.region AND a.mi = c.mi + 12""")
def _(t: Tables):
    m = K.evaluate_wide(D.v_sales(t, ("customer",)), ["sales"], ["region", "ym"]).withColumn("mi", K.month_index())
    out = K.change(m, ["region"], "mi", "sales", {"vs_previous": 1, "vs_last_year": 12})
    return out.select("region", "ym", "sales", "vs_previous", "vs_last_year",
                      F.coalesce(F.col("vs_previous") < -0.15, F.lit(False)).alias("dropped"))


@query("k18_drill_region_state", """
SELECT coalesce(region, 'ALL') AS region, coalesce(state, 'ALL') AS state, CAST(sum(price) FILTER (status <> 'P') AS DOUBLE) AS sales,
       count(*) AS n_lines, round(CAST(sum(freight) FILTER (status <> 'P') AS DOUBLE) / CAST(sum(price) FILTER (status <> 'P') AS DOUBLE), 6) AS freight_share
FROM x_vsales GROUP BY ROLLUP (region, state)""")
def _(t: Tables):
    return D.v_sales(t, ("customer",)).rollup("region", "state").agg(
        K.value(K.REGISTRY["sales"]), F.count("*").alias("n_lines"), K.value(K.REGISTRY["freight_share"])
    ).select(F.coalesce("region", F.lit("ALL")).alias("region"), F.coalesce("state", F.lit("ALL")).alias("state"),
             "sales", "n_lines", "freight_share")


@query("k18b_kpis_month_and_region", """
SELECT CASE WHEN grouping(ym) = 1 THEN 'region' ELSE 'month' END AS cut, coalesce(CAST(ym AS VARCHAR), region) AS cut_value,
       CAST(count(*) FILTER (status <> 'P') AS DOUBLE) AS orders,
       round(CAST(count(*) FILTER (on_time) AS DOUBLE) / nullif(count(delivered_date), 0), 6) AS on_time
FROM x_vorders GROUP BY GROUPING SETS ((ym), (region))""")
def _(t: Tables):
    # Both cuts from one pass over the orders.
    return D.v_orders(t).groupingSets([["ym"], ["region"]], "ym", "region").agg(
        F.grouping("ym").alias("g"), K.value(K.REGISTRY["orders"]), K.value(K.REGISTRY["on_time"])
    ).select(F.when(F.col("g") == 1, "region").otherwise("month").alias("cut"),
             F.coalesce(F.col("ym").cast("string"), "region").alias("cut_value"), "orders", "on_time")


LATE_BUCKET = "CASE WHEN days_late <= -30 THEN 'a: 30+ early' WHEN days_late <= 0 THEN 'b: early' WHEN days_late <= 7 THEN 'c: 1-7 late' WHEN days_late <= 30 THEN 'd: 8-30 late' ELSE 'e: 31+ late' END"


@query("k19_rating_by_delay", f"""
SELECT {LATE_BUCKET} AS bucket, count(*) AS n, round(CAST(sum(score) AS DOUBLE) / count(*), 6) AS rating
FROM x_vreviews WHERE days_late IS NOT NULL GROUP BY 1""")
def _(t: Tables):
    return D.v_reviews(t, ()).filter("days_late IS NOT NULL").groupBy(F.expr(LATE_BUCKET).alias("bucket")).agg(
        F.count("*").alias("n"), ratio(F.sum("score"), F.count("*")).alias("rating"))


@query("k20_rating_slope", """
SELECT round(regr_slope(score, days_late), 8) AS slope, round(regr_intercept(score, days_late), 6) AS intercept, count(*) AS n
FROM x_vreviews WHERE days_late IS NOT NULL""")
def _(t: Tables):
    return D.v_reviews(t, ()).filter("days_late IS NOT NULL").agg(
        F.round(F.regr_slope("score", "days_late"), 8).alias("slope"),
        F.round(F.regr_intercept("score", "days_late"), 6).alias("intercept"), F.count("*").alias("n"))


@query("k21_payment_mix", """
SELECT payment_type, instalments, count(*) AS n, CAST(sum(total) AS DOUBLE) AS paid,
       round(CAST(sum(total) AS DOUBLE) / (SELECT CAST(sum(total) AS DOUBLE) FROM x_orders), 6) AS share
FROM (SELECT *, CAST(1 + order_id % 4 AS BIGINT) AS instalments FROM x_orders) GROUP BY payment_type, instalments""")
def _(t: Tables):
    from pyspark.sql import Window
    g = D.orders(t).groupBy("payment_type", (F.col("order_id") % 4 + 1).alias("instalments")).agg(
        F.count("*").alias("n"), F.sum("total").alias("p"))
    # The total runs over the few grouped rows, not over the orders.
    return g.select("payment_type", "instalments", "n", dbl("p").alias("paid"),
                    ratio(F.col("p"), F.sum("p").over(Window.partitionBy())).alias("share"))


@query("k22_state_map", """
SELECT state, sales, on_time FROM (SELECT state, CAST(sum(price) FILTER (status <> 'P') AS DOUBLE) AS sales FROM x_vsales GROUP BY state)
JOIN (SELECT state, round(CAST(count(*) FILTER (on_time) AS DOUBLE) / nullif(count(delivered_date), 0), 6) AS on_time FROM x_vorders GROUP BY state) USING (state)""")
def _(t: Tables):
    # items_value is already per order, so one pass over orders gives both numbers.
    return D.v_orders(t).groupBy("state").agg(
        dbl(F.sum(F.when(F.col("status") != "P", F.col("items_value")))).alias("sales"), K.value(K.REGISTRY["on_time"]))


@query("l01_best_sellers", """
SELECT seller_id, CAST(sum(price) AS DOUBLE) AS sales FROM x_vsales WHERE status <> 'P' GROUP BY seller_id ORDER BY sales DESC, seller_id LIMIT 10""")
def _(t: Tables):
    return D.v_sales(t, ()).filter("status <> 'P'").groupBy("seller_id").agg(dbl(F.sum("price")).alias("sales")).orderBy(
        F.desc("sales"), "seller_id").limit(10)


@query("l01b_top_categories_by_region", """
SELECT region, category, sales, CAST(rn AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY sales DESC, category) AS rn FROM (
    SELECT region, category, CAST(sum(price) AS DOUBLE) AS sales FROM x_vsales WHERE status <> 'P' GROUP BY ALL)) WHERE rn <= 3""")
def _(t: Tables):
    from pyspark.sql import Window
    g = D.v_sales(t, ("customer", "product")).filter("status <> 'P'").groupBy("region", "category").agg(
        dbl(F.sum("price")).alias("sales"))
    w = Window.partitionBy("region").orderBy(F.desc("sales"), "category")
    return g.withColumn("place", F.row_number().over(w)).filter("place <= 3")


@query("w01_latest_review", """
SELECT order_id, event_id, score, has_comment FROM x_latest""")
def _(t: Tables):
    return D.latest_reviews(t).select("order_id", "event_id", "score", "has_comment")


@query("p09_region_rollup", """
SELECT region, count(DISTINCT state) AS n_states, count(*) AS n_customers FROM x_customers GROUP BY region""")
def _(t: Tables):
    return D.customers(t).groupBy("region").agg(F.count_distinct("state").alias("n_states"), F.count("*").alias("n_customers"))


MONTH_COMPLETE = 0.5  # a month is complete from half the orders of the median month (ours)


def calendar(t: Tables):
    """Date dimension from the first to the last order day."""
    span = D.orders(t).agg(F.min("purchase_date").alias("a"), F.max("purchase_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    per_month = D.orders(t).groupBy("ym").agg(F.count("*").alias("n"))
    usual = per_month.agg(F.expr("percentile(n, 0.5)").alias("usual"))
    complete = per_month.select("ym", (F.col("n") >= literals(usual)["usual"] * MONTH_COMPLETE).alias("is_complete"))
    days = days.select(
        "day", F.year("day").alias("year"), F.month("day").alias("month"), F.weekofyear("day").alias("week"),
        F.weekday("day").alias("weekday"), D.ym("day").alias("ym"),
        (F.date_format("day", "MM-dd").isin("01-01", "05-01", "12-25")).alias("is_holiday"),
        # The Friday after the fourth Thursday of November.
        ((F.month("day") == 11) & (F.weekday("day") == 4) & F.dayofmonth("day").between(23, 29)).alias("is_black_friday"))
    return days.join(complete, "ym", "left").withColumn("is_complete", F.coalesce("is_complete", F.lit(False)))


cte("x_complete", f"""
SELECT ym, n >= (SELECT median(n) FROM (SELECT count(*) AS n FROM x_orders GROUP BY ym)) * {MONTH_COMPLETE} AS is_complete
FROM (SELECT ym, count(*) AS n FROM x_orders GROUP BY ym)""")


@query("p10_date_dimension", """
SELECT CAST(d AS VARCHAR) AS day, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(week(d) AS INTEGER) AS week,
       CAST(isodow(d) - 1 AS INTEGER) AS weekday, CAST(year(d) * 100 + month(d) AS INTEGER) AS ym,
       strftime(d, '%m-%d') IN ('01-01', '05-01', '12-25') AS is_holiday,
       month(d) = 11 AND isodow(d) = 5 AND day(d) BETWEEN 23 AND 29 AS is_black_friday, coalesce(c.is_complete, false) AS is_complete
FROM (SELECT CAST(unnest(generate_series((SELECT CAST(min(purchase_date) AS TIMESTAMP) FROM x_orders), (SELECT CAST(max(purchase_date) AS TIMESTAMP) FROM x_orders), INTERVAL 1 DAY)) AS DATE) AS d)
LEFT JOIN x_complete c ON c.ym = year(d) * 100 + month(d)""")
def _(t: Tables):
    return calendar(t).withColumn("day", F.col("day").cast("string"))


@query("s17_sales_daily", """
SELECT CAST(purchase_date AS VARCHAR) AS day, region, category, CAST(sum(price) AS DOUBLE) AS sales, count(*) AS n_lines, CAST(sum(freight) AS DOUBLE) AS freight
FROM x_vsales WHERE status <> 'P' GROUP BY ALL""")
def _(t: Tables):
    return sales_daily(t).select(F.col("day").cast("string").alias("day"), "region", "category", dbl("sales").alias("sales"),
                                 "n_lines", dbl("freight").alias("freight"))


def sales_daily(t: Tables):
    return D.v_sales(t, ("customer", "product")).filter("status <> 'P'").groupBy(
        F.col("purchase_date").alias("day"), "region", "category").agg(
        F.sum("price").alias("sales"), F.count("*").alias("n_lines"), F.sum("freight").alias("freight"))


@query("s17b_delivery_weekly", """
SELECT CAST(CAST(date_trunc('week', promised_date) AS DATE) AS VARCHAR) AS week, region, count(delivered_date) AS delivered,
       count(*) FILTER (on_time) AS on_time FROM x_vorders GROUP BY ALL""")
def _(t: Tables):
    return delivery_weekly(t).withColumn("week", F.col("week").cast("string"))


def delivery_weekly(t: Tables):
    return D.v_orders(t).groupBy(F.date_trunc("week", "promised_date").cast("date").alias("week"), "region").agg(
        F.count("delivered_date").alias("delivered"), F.count_if("on_time").alias("on_time"))


@query("p06_currency", """
SELECT ym, CAST(sum(price) AS DOUBLE) AS brl, CAST(sum(CAST(round(price * CAST(3.5 AS DECIMAL(6,2)), 2) AS DECIMAL(14,2))) AS DOUBLE) AS mxn,
       CAST(sum(CAST(round(price * CAST(0.2 AS DECIMAL(6,2)), 2) AS DECIMAL(14,2))) AS DOUBLE) AS usd FROM x_vsales WHERE status <> 'P' GROUP BY ym""")
def _(t: Tables):
    def at(rate):
        return F.round(F.col("price") * F.lit(rate).cast("decimal(6,2)"), 2).cast("decimal(14,2)")
    return D.v_sales(t, ()).filter("status <> 'P'").groupBy("ym").agg(
        dbl(F.sum("price")).alias("brl"), dbl(F.sum(at("3.50"))).alias("mxn"), dbl(F.sum(at("0.20"))).alias("usd"))
