"""Row- and column-security queries and their leak tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dbl
from ..operators import kpi as K, security as S
from ..sources import domain as D
from ..sources.tables import Tables
from .registry import query


@query("x01_manager_sales", """
SELECT region, CAST(sum(price) FILTER (status <> 'P') AS DOUBLE) AS sales FROM x_vsales WHERE region = 'ASIA' GROUP BY region""")
def _(t: Tables):
    return K.evaluate_wide(S.relation("manager.asia", D.v_sales(t, ("customer",))), ["sales"], ["region"])


@query("x01b_manager_orders_reviews", """
SELECT 'orders' AS dataset, region, count(*) AS n FROM x_vorders WHERE region = 'EUROPE' GROUP BY region
UNION ALL SELECT 'reviews', region, count(*) FROM x_vreviews WHERE region = 'EUROPE' GROUP BY region""")
def _(t: Tables):
    def n(name, df):
        return S.relation("manager.europe", df).groupBy("region").agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "region", "n")
    return n("orders", D.v_orders(t)).unionByName(n("reviews", D.v_reviews(t)))


@query("x02_seller_lines", """
SELECT order_id, line_seq, CAST(price AS DOUBLE) AS price FROM x_vsales WHERE seller_id = 7""")
def _(t: Tables):
    return S.relation("seller.7", D.v_sales(t, ())).select("order_id", "line_seq", dbl("price").alias("price"))


@query("j03_seller_orders", """
SELECT order_id, status, coalesce(on_time, false) AS on_time FROM x_ordel_days WHERE order_id IN (SELECT order_id FROM x_slines WHERE seller_id = 7)""")
def _(t: Tables):
    return S.relation("seller.7", D.v_orders(t, ()), D.staged_lines(t)).select("order_id", "status", F.coalesce("on_time", F.lit(False)).alias("on_time"))


@query("x03_seller_columns", """
SELECT 'total' AS column_name, 0 AS visible UNION ALL SELECT 'items_value', 0 UNION ALL SELECT 'customer_id', 0 UNION ALL SELECT 'order_id', (SELECT CAST(count(DISTINCT order_id) > 0 AS INTEGER) FROM x_lines WHERE seller_id = 7)""")
def _(t: Tables):
    view = S.relation("seller.7", D.v_orders(t, ()), D.staged_lines(t))
    has = view.agg((F.count("*") > 0).cast("int").alias("n"))
    names = ["total", "items_value", "customer_id", "order_id"]
    flags = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("n") * int(c in view.columns)).alias("visible")) for c in names])
    return has.select(F.explode(flags).alias("f")).select("f.*")


@query("x04_analyst_customers", """
SELECT region, CAST(count(DISTINCT customer_id) AS DOUBLE) AS customers FROM x_vorders WHERE status <> 'P' GROUP BY region""")
def _(t: Tables):
    # Counting customers is allowed; reading who they are is not.
    return K.evaluate_wide(K.customer_counts(S.rows_for("analyst", D.v_orders(t)), ["region"]), ["customers"], ["region"])


@query("x04b_analyst_rows", """
SELECT order_id, status, region, CAST(total AS DOUBLE) AS total FROM x_vorders""")
def _(t: Tables):
    return S.relation("analyst", D.v_orders(t)).select("order_id", "status", "region", dbl("total").alias("total"))


@query("x05_unknown_user", "SELECT order_id, status FROM x_orders WHERE 1 = 0")
def _(t: Tables):
    return S.relation("nobody", D.v_orders(t)).select("order_id", "status")


@query("x06_area_views", """
SELECT 'shop' AS area, order_id, line_seq, brand, line_status AS detail FROM x_vsales
UNION ALL SELECT 'sales', order_id, line_seq, brand, CAST(price AS VARCHAR) FROM x_vsales WHERE seller_id = 3""")
def _(t: Tables):
    base = D.v_sales(t, ("product",))
    shop = S.area_view("shop", base).select(F.lit("shop").alias("area"), "order_id", "line_seq", "brand", F.col("line_status").alias("detail"))
    own = S.area_view("sales", base, seller_id=3).select(F.lit("sales").alias("area"), "order_id", "line_seq", "brand", F.col("price").cast("string").alias("detail"))
    return shop.unionByName(own)


@query("x06b_administration_view", "SELECT order_id, line_seq, brand, CAST(price AS DOUBLE) AS price, status FROM x_vsales")
def _(t: Tables):
    # Administration sees prices, and neither customer nor seller; these lines carry no costs.
    return S.area_view("administration", D.v_sales(t, ("product",))).withColumn("price", dbl("price"))


@query("s12_permissions", """
SELECT p.*, n FROM (VALUES ('director', '', ''), ('analyst', '', ''), ('manager.asia', 'ASIA', ''), ('manager.europe', 'EUROPE', ''), ('seller.7', '', '7')) p("UserName", customer_region, seller_id)
JOIN (SELECT 'director' AS u, count(*) AS n FROM x_vsales UNION ALL SELECT 'analyst', count(*) FROM x_vsales UNION ALL
      SELECT 'manager.asia', count(*) FROM x_vsales WHERE region = 'ASIA' UNION ALL SELECT 'manager.europe', count(*) FROM x_vsales WHERE region = 'EUROPE'
      UNION ALL SELECT 'seller.7', count(*) FROM x_vsales WHERE seller_id = 7) ON u = "UserName\"""")
def _(t: Tables):
    rules = S.permissions(list(S.USERS.values()), t.spark)
    base = D.v_sales(t, ("customer",)).groupBy("region", "seller_id").agg(F.count("*").alias("k"))
    # How many lines each rule lets through, from one small grouped table.
    # A row answers to three kinds of rule: all, its region, its seller.
    none, seller = F.lit(""), F.col("seller_id").cast("string")
    kinds = F.array(F.struct(none.alias("r"), none.alias("s")), F.struct(F.col("region").alias("r"), none.alias("s")), F.struct(none.alias("r"), seller.alias("s")))
    keyed = base.select("k", F.explode(kinds).alias("key")).groupBy(F.col("key.r").alias("customer_region"), F.col("key.s").alias("seller_id")).agg(F.sum("k").alias("n"))
    return keyed.join(F.broadcast(rules), ["customer_region", "seller_id"]).select("UserName", "customer_region", "seller_id", "n")


@query("s13_seller_grain", """
SELECT order_id, seller_id, count(*) AS n_lines, CAST(sum(price) AS DOUBLE) AS price, CAST(sum(freight) AS DOUBLE) AS freight, any_value(status) AS status
FROM x_lines JOIN x_orders USING (order_id) GROUP BY order_id, seller_id""")
def _(t: Tables):
    return S.seller_grain(D.lines(t), D.orders(t)).select("order_id", "seller_id", "n_lines", dbl("price").alias("price"), dbl("freight").alias("freight"), "status")


@query("u04_leak_test", """
SELECT * FROM (VALUES ('in view only', 0), ('in filter only', 0)) v(side, n)""")
def _(t: Tables):
    base = D.v_orders(t).select("order_id", "status", "region", "ym")
    view, want = S.relation("manager.asia", base), base.filter(F.col("region") == "ASIA")
    a = view.exceptAll(want).agg(F.count("*").cast("int").alias("n")).select(F.lit("in view only").alias("side"), "n")
    b = want.exceptAll(view).agg(F.count("*").cast("int").alias("n")).select(F.lit("in filter only").alias("side"), "n")
    return a.unionByName(b)
