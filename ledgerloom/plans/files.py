"""Source and sink queries: each writes what Spark derives from the tables, reads it back and returns it."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions.money import dbl
from ..operators import anomalies as A, kpi as K, quality as Q, sensors as N
from ..session import checkpoint_dir, literals, settle
from ..sources import domain as D, files as S, sinks as W
from ..sources.readings import confirmed_taps
from ..sources.tables import Tables
from . import alerts, kpis, office, sensors
from .registry import cte, query


def scratch(t: Tables, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/out/{name}-{uuid.uuid4().hex}"


@query("s01_typed_csv", "SELECT p_partkey AS product_id, p_name AS name, p_type AS category, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price FROM part")
def _(t: Tables):
    path = scratch(t, "csv")
    t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price")).write.csv(path, header=True)
    return S.read_flat(t.spark, path, "product_id bigint, name string, category string, price decimal(12,2)").filter("_bad IS NULL").select("product_id", "name", "category", dbl("price").alias("price"))


@query("s02_extract_since", "SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-30'")
def _(t: Tables):
    fresh, _ = S.extract_since(t.orders, "o_orderdate", datetime(2000, 6, 30))
    return fresh.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))


@query("s02b_new_watermark", "SELECT CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS watermark FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-30'")
def _(t: Tables):
    _, mark = S.extract_since(t.orders, "o_orderdate", datetime(2000, 6, 30))
    return mark.select(F.col("watermark").cast("date").cast("string").alias("watermark"))


cte("x_fxall", """
SELECT day, 0 AS pri, CAST(3 + (dayofyear(day) % 50) / 100.0 AS DECIMAL(10,4)) AS rate FROM (SELECT DISTINCT purchase_date AS day FROM x_orders) WHERE dayofyear(day) % 3 = 0
UNION ALL SELECT day, 1, CAST(3.6 AS DECIMAL(10,4)) FROM (SELECT DISTINCT purchase_date AS day FROM x_orders) WHERE dayofyear(day) % 5 = 0 UNION ALL SELECT DATE '1994-12-31', 2, CAST(3.5 AS DECIMAL(10,4))""")
cte("x_fx", "SELECT day, arg_min(rate, pri) AS rate, CAST(min(pri) AS INTEGER) AS source_rank FROM x_fxall GROUP BY day")


def rates(t: Tables):
    """Rates of a live source with holes, a cache and a fallback; derived from the order days."""
    days = D.orders(t).select(F.col("purchase_date").alias("day")).distinct()
    doy = F.dayofyear("day")
    live = days.filter(doy % 3 == 0).select("day", (F.lit(3) + (doy % 50) / 100.0).cast("decimal(10,4)").alias("rate"))
    cache = days.filter(doy % 5 == 0).select("day", F.lit("3.6").cast("decimal(10,4)").alias("rate"))
    fallback = t.rows("d string, r string", [("1994-12-31", "3.5")]).select(F.col("d").cast("date").alias("day"), F.col("r").cast("decimal(10,4)").alias("rate"))
    return S.first_available([live, cache, fallback], ["day"])


@query("s03_rate_fallback", "SELECT CAST(day AS VARCHAR) AS day, CAST(rate AS DOUBLE) AS rate, source_rank FROM x_fx")
def _(t: Tables):
    return rates(t).select(F.col("day").cast("string").alias("day"), dbl("rate").alias("rate"), "source_rank")


@query("j02_rate_as_of", "SELECT order_id, CAST(rate AS DOUBLE) AS rate, CAST(round(total * rate, 2) AS DOUBLE) AS converted FROM x_orders ASOF JOIN x_fx ON x_fx.day <= purchase_date")
def _(t: Tables):
    o = D.orders(t)
    known = S.last_known(o.select(F.col("purchase_date").alias("day")), rates(t))
    return o.join(known, o.purchase_date == known.day).select("order_id", dbl("rate").alias("rate"), dbl(F.round(F.col("total") * F.col("rate"), 2)).alias("converted"))


@query("s05_latin1_csv", "SELECT conv_id, turn, role, text FROM conversations")
def _(t: Tables):
    path = scratch(t, "latin1")
    # Quoted and with line breaks marked: a text keeps its lines, and a file stays splittable.
    text = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    rows = t.conversations.select("conv_id", "turn", "role", text.alias("text"))
    rows.write.option("encoding", "ISO-8859-1").option("escape", "\"").option("quoteAll", True).csv(path, header=True)
    back = S.read_flat(t.spark, path, "conv_id bigint, turn bigint, role string, text string", "ISO-8859-1")
    plain = F.replace(F.regexp_replace("text", r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), F.lit("\\\\"), F.lit("\\"))
    return back.select("conv_id", "turn", "role", plain.alias("text"))


def invoice_xml(t: Tables):
    """Invoices of both versions written out as XML from the orders."""
    o = D.orders(t)
    kind = F.when(F.col("order_id") % 10 == 0, "E").when(F.col("order_id") % 10 == 1, "P").otherwise("I")
    usd = F.col("order_id") % 4 == 0
    # Version 4.0 and 3.3 differ in the namespace only, as far as these fields go.
    v = F.when(F.col("order_id") % 2 == 0, "4.0").otherwise("3.3")
    ns = F.when(F.col("order_id") % 2 == 0, "http://www.sat.gob.mx/cfd/4").otherwise("http://www.sat.gob.mx/cfd/3")
    return o.select("order_id", F.concat(
        F.lit('<cfdi:Comprobante xmlns:cfdi="'), ns, F.lit('" Version="'), v, F.lit('" Serie="A" Folio="'), F.col("order_id").cast("string"), F.lit('" Fecha="'), F.col("purchase_date").cast("string"),
        F.lit('T10:00:00" Moneda="'), F.when(usd, "USD").otherwise("MXN"), F.lit('"'), F.when(usd, F.lit(' TipoCambio="17.5"')).otherwise(""), F.lit(' Total="'), F.col("total").cast("string"),
        F.lit('" TipoDeComprobante="'), kind, F.lit('"><cfdi:Complemento><tfd:TimbreFiscalDigital xmlns:tfd="http://www.sat.gob.mx/TimbreFiscalDigital" UUID="'), F.md5(F.col("order_id").cast("string")),
        F.lit('"/></cfdi:Complemento></cfdi:Comprobante>')).alias("xml"))


@query("s06_invoice_xml", """
SELECT order_id, CASE WHEN order_id % 2 = 0 THEN '4.0' ELSE '3.3' END AS version, CAST(order_id AS VARCHAR) AS folio, md5(CAST(order_id AS VARCHAR)) AS uuid, CASE order_id % 10 WHEN 0 THEN 'E' WHEN 1 THEN 'P' ELSE 'I' END AS type,
 CASE WHEN order_id % 4 = 0 THEN 'USD' ELSE 'MXN' END AS currency, CAST(total AS DOUBLE) AS total, CAST(purchase_date AS VARCHAR) AS date FROM x_orders""")
def _(t: Tables):
    return S.invoices_from_xml(invoice_xml(t)).select("order_id", "version", "folio", "uuid", "type", "currency", "total", F.col("date").cast("string").alias("date"))


@query("s06b_invoices_in_archives", """
SELECT CAST(order_id AS VARCHAR) AS folio, order_id % 3 > 0 AS in_archive, md5(CAST(order_id AS VARCHAR)) AS uuid, CAST(total AS DOUBLE) AS total FROM x_orders""")
def _(t: Tables):
    x = invoice_xml(t).withColumn("name", F.concat("order_id", F.lit(".XML")))
    month = F.concat(F.lit("batch-"), F.floor(F.col("order_id") / 500))  # 500 ids are an archive
    packed = S.archives(x.filter("order_id % 3 > 0").select(month.alias("archive"), "name", F.col("xml").alias("text")), "archive")
    loose = x.filter("order_id % 3 = 0").select(F.col("name").alias("path"), F.encode("xml", "UTF-8").alias("content"))
    inv = S.invoices_from_xml(S.unpacked(packed.unionByName(loose)))
    return inv.select("folio", F.contains("path", F.lit(".zip!")).alias("in_archive"), "uuid", F.col("total").cast("double").alias("total"))


@query("p16_invoice_normalised", """
SELECT 'booked' AS side, count(*) AS n, CAST(sum(CAST(round(total * CASE WHEN order_id % 4 = 0 THEN CAST(17.5 AS DECIMAL(10,4)) ELSE CAST(1 AS DECIMAL(10,4)) END * CASE WHEN order_id % 10 = 0 THEN -1 ELSE 1 END, 2) AS DECIMAL(14,2))) AS DOUBLE) AS amount FROM x_orders WHERE order_id % 10 <> 1
UNION ALL SELECT 'skipped', count(*), 0 FROM x_orders WHERE order_id % 10 = 1""")
def _(t: Tables):
    booked, skipped = S.normalise_invoices(S.invoices_from_xml(invoice_xml(t)))
    a = booked.agg(F.count("*").alias("n"), dbl(F.sum("amount")).alias("amount")).select(F.lit("booked").alias("side"), "n", "amount")
    return a.unionByName(skipped.agg(F.count("*").alias("n")).select(F.lit("skipped").alias("side"), "n", F.lit(0.0).alias("amount")))


@query("s07_history_csv", "SELECT reading_id, tag, centi FROM x_readings")
def _(t: Tables):
    path = scratch(t, "history")
    D.readings(t).select("reading_id", "tag", F.col("us").alias("t_inicio"), "centi").write.csv(path, header=True)
    return S.read_flat(t.spark, path, "reading_id bigint, tag string, t_inicio bigint, centi bigint").select("reading_id", "tag", "centi")


@query("s07b_evaluation_files", sensors.REPORT)
def _(t: Tables):
    """History by one clock, confirmed taps by that of the field crew, six hours behind."""
    history, confirmed = scratch(t, "history"), scratch(t, "confirmed")
    D.readings(t).select("reading_id", "tag", "k", F.col("us").alias("t_inicio"), "centi").write.csv(history, header=True)
    there = F.date_format(F.timestamp_micros(F.col("us") - 6 * sensors.H), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    sensors.taps(t).select(there.alias("t_inicio"), "km", (F.col("centi") / 100).alias("caudal"), F.col("tap_id").cast("string").alias("descripcion")).write.csv(confirmed, header=True)
    kind = dict(D.readings(t).dtypes)["k"]
    r = S.read_flat(t.spark, history, f"reading_id bigint, tag string, k {kind}, t_inicio bigint, centi bigint").withColumnRenamed("t_inicio", "us")
    found = confirmed_taps(t.spark, confirmed, -6).select("tap_id", "us", F.col("km").cast("int").alias("km"), F.round(F.col("caudal") * 100).cast("bigint").alias("centi"))
    return sensors.report(N.merge(sensors.raw_incidents(r), ["zone"], 6 * sensors.H), settle(found), r)


@query("s10_replace_table", "SELECT order_id, status FROM x_orders WHERE status = 'F'")
def _(t: Tables):
    root = scratch(t, "replace")
    o = D.orders(t).select("order_id", "status")
    W.replace_table(o, root, "orders")
    W.replace_table(D.customers(t), root, "customers")
    path = W.replace_table(o.filter("status = 'F'"), root, "orders")
    return t.spark.read.schema(o.schema).parquet(path)


@query("s11_export_manifest", """
SELECT 'orders' AS table_name, count(*) AS rows, 'one row per order' AS purpose, 8 AS n_columns, 'customer_id' AS customer_columns FROM x_orders UNION ALL SELECT 'lines', count(*), 'one row per order line', 11, '' FROM x_lines
UNION ALL SELECT 'customers', count(*), 'customer dimension', 5, 'customer_id,customer_name' FROM x_customers UNION ALL SELECT 'products', count(*), 'product dimension', 4, '' FROM x_products UNION ALL SELECT 'sellers', count(*), 'seller dimension', 4, '' FROM x_sellers""")
def _(t: Tables):
    return W.export({"orders": (D.orders(t), "one row per order"), "lines": (D.lines(t), "one row per order line"), "customers": (D.customers(t), "customer dimension"),
                     "products": (D.products(t), "product dimension"), "sellers": (D.sellers(t), "seller dimension")}, scratch(t, "export"))


@query("s14b_at_risk_attachment", """
SELECT s.user_name, CAST(s.sent AS VARCHAR) AS day, v.order_id FROM (SELECT user_name, sent, bool_or(region = 'ALL') AS whole FROM x_sentto GROUP BY ALL) s JOIN x_vorders v
 ON v.status <> 'P' AND v.purchase_date <= s.sent AND (v.last_ship IS NULL OR v.last_ship > s.sent) AND v.promised_date - s.sent <= 7
 AND (s.whole OR EXISTS (SELECT 1 FROM x_sentto q WHERE q.user_name = s.user_name AND q.sent = s.sent AND q.region = v.region))""")
def _(t: Tables):
    """The lists behind the digest records, written by day; read back here."""
    mail = settle(alerts.sent_to(t))
    asked = mail.groupBy("user_name", "sent").agg(F.bool_or(F.col("region") == "ALL").alias("whole"), F.collect_set("region").alias("rs"))
    all_regions = F.array(*[F.lit(r) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])
    asked = asked.select("user_name", "sent", F.explode(F.when(F.col("whole"), all_regions).otherwise(F.col("rs"))).alias("region"))
    # The days on which anything was sent are bounded by the calendar and stand in the plan as one array. An order
    # takes those it is at risk on, and only then meets the readers of its region on that day.
    days = literals(mail.agg(F.array_sort(F.collect_set("sent")).alias("days")))["days"]
    o = D.v_orders(t).filter("status <> 'P'").withColumn("start", F.greatest("purchase_date", F.date_sub("promised_date", 7)))
    hit = F.filter(days, lambda d: (d >= F.col("start")) & (F.col("last_ship").isNull() | (d < F.col("last_ship"))))
    at_risk = o.select("order_id", "region", F.explode(hit).alias("sent"))
    out = at_risk.join(asked, ["region", "sent"]).select("user_name", F.col("sent").cast("string").alias("day"), "order_id")
    path = scratch(t, "digest")
    W.write_daily(out, path, day="day")
    return W.read_daily(t.spark, path).select("user_name", F.col("day").cast("string").alias("day"), "order_id")


@query("s15_gated_publish", "SELECT count(*) AS n, CAST(sum(total) AS DOUBLE) AS total FROM x_orders")
def _(t: Tables):
    root = scratch(t, "publish")
    good, checks = D.orders(t), {"duplicate orders": lambda d: Q.duplicate_keys(d, "order_id")}
    Q.publish(good, root, checks)
    try:
        Q.publish(good.unionByName(good), root, checks)
    except Q.PublishRefused:
        pass  # readers keep the last good build
    return Q.published(t.spark, root).agg(F.count("*").alias("n"), dbl(F.sum("total")).alias("total"))


@query("s16_findings_file", "SELECT page_id, finding, severity, 'validate before delivery' AS note FROM x_find")
def _(t: Tables):
    path = scratch(t, "findings")
    W.write_findings(office.findings(t).select("page_id", "finding", "severity"), path)
    return t.spark.read.schema("page_id bigint, finding string, severity string, note string").json(path)


@query("s17c_monthly_tables", "SELECT ym, count(*) AS n, CAST(sum(price) AS DOUBLE) AS price FROM x_vsales WHERE ym BETWEEN 199701 AND 199712 AND region = 'ASIA' GROUP BY ym")
def _(t: Tables):
    path = scratch(t, "v_sales")
    wide = D.v_sales(t).select("order_id", "seller_id", "price", "freight", "status", "region", "category", "ym")
    W.write_monthly(wide, path)
    # Month folders are pruned and the region filter reaches the scan.
    back = t.spark.read.schema(wide.schema).parquet(path).filter(F.col("ym").between(199701, 199712) & (F.col("region") == "ASIA"))
    return back.groupBy("ym").agg(F.count("*").alias("n"), dbl(F.sum("price")).alias("price"))


@query("s18b_alert_log_rerun", "SELECT CAST(sent AS VARCHAR) AS sent, series, region FROM x_alerts")
def _(t: Tables):
    path = scratch(t, "alert_log")
    found = A.alerts(alerts.judged(t)).select(F.col("sent").cast("string").alias("sent"), "series", "region")
    W.write_daily(found.unionByName(found.select(F.lit("2001-02-30").alias("sent"), "series", "region").limit(1)), path)
    span = found.agg(F.min("sent"), F.greatest(F.max("sent"), F.lit("2001-12-31"))).first()
    if span[0]:
        W.write_daily(found, path, *span)  # a rerun replaces its days, also the one it has no alert for now
    return W.read_daily(t.spark, path).select(F.col("sent").cast("string").alias("sent"), "series", "region")
