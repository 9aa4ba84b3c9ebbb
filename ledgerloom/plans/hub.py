"""Integration-hub queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dbl, ratio
from ..operators import hub as H
from ..sources import domain as D
from ..sources.tables import Tables
from .registry import cte, query

RATES = {"USD": 5.0, "EUR": 5.5, "BRL": 1.0}
CCY = "CASE WHEN order_id % 7 = 0 THEN 'USD' WHEN order_id % 11 = 0 THEN 'EUR' ELSE 'BRL' END"
INV_CCY = "CASE WHEN order_id % 35 = 0 THEN 'BRL' WHEN order_id % 7 = 0 THEN 'USD' WHEN order_id % 11 = 0 THEN 'EUR' ELSE 'BRL' END"


def payments(t: Tables):
    return H.to_canonical(D.orders(t), {"ref": "order_id", "amount": "total", "currency": F.expr(CCY), "cancelled": F.col("status") == "P"})


def invoices(t: Tables):
    """A document per (order, line); the natural copies of a line key are the planted double billing."""
    g = D.lines(t).groupBy("order_id", "line_seq").agg(F.sum("price").alias("price"), F.count("*").alias("copies"))
    return H.to_canonical(g, {"ref": "order_id", "document": "line_seq", "amount": "price", "currency": F.expr(INV_CCY), "copies": "copies"})


@query("s09_second_vendor", """
SELECT order_id AS ref, CAST(total AS DOUBLE) AS amount, CASE WHEN order_id % 7 = 0 THEN 'USD' WHEN order_id % 11 = 0 THEN 'EUR' ELSE 'BRL' END AS currency, CASE WHEN order_id % 2 = 0 THEN 'pms-a' ELSE 'pms-b' END AS source FROM x_orders""")
def _(t: Tables):
    return canonical_payments(t).select("ref", dbl("amount").alias("amount"), "currency", "source")


def canonical_payments(t: Tables):
    """Two vendors with different field names, one canonical table."""
    o = D.orders(t).withColumn("ccy", F.expr(CCY))
    a = o.filter("order_id % 2 = 0").select(F.col("order_id").alias("id"), F.col("total").alias("amount"), F.col("ccy").alias("currency"))
    b = o.filter("order_id % 2 = 1").select(F.col("order_id").alias("txn_ref"), F.col("total").alias("value"), "ccy")
    left = H.to_canonical(a, {"ref": "id", "amount": "amount", "currency": "currency", "source": F.lit("pms-a")})
    right = H.to_canonical(b, {"ref": "txn_ref", "amount": "value", "currency": "ccy", "source": F.lit("pms-b")})
    return left.unionByName(right)


@query("u01_canonical_union", "SELECT CASE WHEN order_id % 2 = 0 THEN 'pms-a' ELSE 'pms-b' END AS source, count(*) AS n, CAST(sum(total) AS DOUBLE) AS amount FROM x_orders GROUP BY 1")
def _(t: Tables):
    return canonical_payments(t).groupBy("source").agg(F.count("*").alias("n"), dbl(F.sum("amount")).alias("amount"))


cte("x_rates", "SELECT * FROM (VALUES ('USD', CAST(5.0 AS DECIMAL(10,4))), ('EUR', CAST(5.5 AS DECIMAL(10,4))), ('BRL', CAST(1.0 AS DECIMAL(10,4)))) r(ccy, rate)")
cte("x_recon", f"""
SELECT ref, class, CASE class WHEN 'missing invoice' THEN paid WHEN 'cancelled but invoiced' THEN billed WHEN 'matched' THEN 0 ELSE abs(paid - billed) END AS at_risk FROM (
 SELECT *, CASE WHEN billed IS NULL AND NOT cancelled THEN 'missing invoice' WHEN billed IS NULL THEN 'matched' WHEN coalesce(cancelled, true) THEN 'cancelled but invoiced' WHEN copies > 1 THEN 'double billing'
  WHEN pay_ccy <> inv_ccy THEN 'currency mismatch' WHEN abs(paid - billed) > 0.01 THEN 'amount mismatch' ELSE 'matched' END AS class FROM (
  SELECT order_id AS ref, {CCY} AS pay_ccy, status = 'P' AS cancelled, CAST(round(total * rate, 2) AS DECIMAL(18,2)) AS paid FROM x_orders JOIN x_rates ON ccy = {CCY}) p
 FULL JOIN (SELECT order_id AS ref, {INV_CCY} AS inv_ccy, max(copies) AS copies, sum(CAST(round(price * rate, 2) AS DECIMAL(18,2))) AS billed
   FROM (SELECT order_id, line_seq, sum(price) AS price, count(*) AS copies FROM x_lines GROUP BY ALL) JOIN x_rates ON ccy = {INV_CCY} GROUP BY order_id) i USING (ref))""")


@query("j08_reconciliation", "SELECT ref, class, CAST(at_risk AS DOUBLE) AS at_risk FROM x_recon")
def _(t: Tables):
    return H.reconcile(payments(t), invoices(t), RATES).select("ref", "class", dbl("at_risk").alias("at_risk"))


@query("h01_money_at_risk", "SELECT class, count(*) AS n, CAST(sum(at_risk) AS DOUBLE) AS at_risk FROM x_recon WHERE class <> 'matched' GROUP BY class")
def _(t: Tables):
    return H.reconcile(payments(t), invoices(t), RATES).filter("class <> 'matched'").groupBy("class").agg(F.count("*").alias("n"), dbl(F.sum("at_risk")).alias("at_risk"))


GL = [(f"Brand#{i}", f"GL-{4000 + i}") for i in range(1, 21)]  # brands 21 and up have no account


@query("j23_dead_letters", "SELECT order_id, line_seq, product_id, 'no mapping for brand ' || brand AS reason FROM x_lines JOIN x_products USING (product_id) WHERE CAST(substring(brand, 7) AS INTEGER) > 20")
def _(t: Tables):
    rows = D.lines(t).join(D.products(t).select("product_id", "brand"), "product_id")
    _, dead = H.route(rows, F.broadcast(t.rows("brand string, gl string", GL)), "brand")
    return dead.select("order_id", "line_seq", "product_id", "reason")


@query("p17_mapping_rules", """
SELECT coalesce(gl, 'unmapped') AS gl, CASE WHEN region = 'ASIA' THEN 'USD' WHEN region = 'EUROPE' THEN 'EUR' ELSE 'BRL' END AS currency, count(*) AS n, CAST(sum(CAST(round(price * CASE category WHEN 'PROMO' THEN CAST(0.08 AS DECIMAL(4,2)) ELSE CAST(0.16 AS DECIMAL(4,2)) END, 2) AS DECIMAL(14,2))) AS DOUBLE) AS tax
FROM (SELECT *, CASE WHEN CAST(substring(brand, 7) AS INTEGER) <= 20 THEN 'GL-' || (4000 + CAST(substring(brand, 7) AS INTEGER)) END AS gl FROM x_vsales) GROUP BY ALL""")
def _(t: Tables):
    ccy = t.rows("region string, currency string", [("ASIA", "USD"), ("EUROPE", "EUR"), ("AFRICA", "BRL"), ("AMERICA", "BRL"), ("MIDDLE EAST", "BRL")])
    tax = t.rows("category string, tax_rate string", [(c, "0.08" if c == "PROMO" else "0.16") for c in ("PROMO", "MEDIUM", "STANDARD", "LARGE", "SMALL", "ECONOMY")])
    v = D.v_sales(t, ("customer", "product")).join(F.broadcast(t.rows("brand string, gl string", GL)), "brand", "left").join(F.broadcast(ccy), "region", "left").join(F.broadcast(tax), "category", "left")
    amount = F.round(F.col("price") * F.col("tax_rate").cast("decimal(4,2)"), 2).cast("decimal(14,2)")
    return v.groupBy(F.coalesce("gl", F.lit("unmapped")).alias("gl"), "currency").agg(F.count("*").alias("n"), dbl(F.sum(amount)).alias("tax"))


@query("h02_sync_health", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(CAST(count(*) FILTER (event_type <> 'error') AS DOUBLE) / count(*), 6) AS success_rate, count(*) FILTER (event_type = 'error') AS dead_letters, count(*) FILTER (event_type = 'view') AS queue_depth,
 round(CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'purchase'), 0) / 100, 6) AS mean_latency FROM events GROUP BY 1""")
def _(t: Tables):
    r = D.readings(t)
    is_ = lambda k: F.col("tag") == k
    return r.groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(
        ratio(F.count_if(~is_("error")), F.count("*")).alias("success_rate"), F.count_if(is_("error")).alias("dead_letters"), F.count_if(is_("view")).alias("queue_depth"),
        F.round(dbl(F.sum(F.when(is_("purchase"), F.col("centi")))) / F.nullif(F.count_if(is_("purchase")), F.lit(0)) / 100, 6).alias("mean_latency"))


def deliveries(t: Tables):
    """Every event once, plus a replay of those whose id ends in 3."""
    e = t.events.select("event_id", "ts", "value")
    return e.withColumn("attempt", F.lit(1)).unionByName(e.filter("event_id % 10 = 3").withColumn("attempt", F.lit(2)))


@query("t03b_idempotent_apply", "SELECT CAST(count(*) AS BIGINT) AS applied, count(*) FILTER (event_id % 10 = 3) AS duplicates, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events")
def _(t: Tables):
    applied, log = H.apply_once(deliveries(t), "event_id", ["attempt"])
    return applied.join(log, "event_id").agg(F.count("*").alias("applied"), F.sum("duplicates").alias("duplicates"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query("t11b_upsert", "SELECT order_id, CASE WHEN order_id % 5 = 0 THEN 'F' ELSE status END AS status, CAST(CASE WHEN order_id % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM x_orders")
def _(t: Tables):
    target = D.orders(t).select("order_id", "status", F.lit(1).alias("version"))
    batch = D.orders(t).filter("order_id % 5 = 0").select("order_id", F.lit("F").alias("status"), F.lit(2).alias("version"))
    once = H.upsert(target, batch, "order_id", "version")
    return H.upsert(once, batch, "order_id", "version")  # a second run changes nothing


@query("t12b_recovery_sweep", "SELECT CASE WHEN CAST(substring(brand, 7) AS INTEGER) <= 20 THEN 'applied' WHEN CAST(substring(brand, 7) AS INTEGER) <= 23 THEN 'recovered' ELSE 'dead' END AS state, count(*) AS n FROM x_lines JOIN x_products USING (product_id) GROUP BY 1")
def _(t: Tables):
    rows = D.lines(t).join(D.products(t).select("product_id", "brand"), "product_id")
    more = GL + [(f"Brand#{i}", f"GL-{4000 + i}") for i in (21, 22, 23)]
    ok, dead = H.route(rows, F.broadcast(t.rows("brand string, gl string", GL)), "brand")
    again, still = H.route(dead.drop("reason"), F.broadcast(t.rows("brand string, gl string", more)), "brand")
    n = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "n")
    return n(ok, "applied").unionByName(n(again, "recovered")).unionByName(n(still, "dead"))
