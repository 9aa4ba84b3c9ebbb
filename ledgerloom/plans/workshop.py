"""Made-to-order queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window, functions as F

from ..functions.money import dbl, ratio
from ..operators import workshop as W
from ..session import literals
from ..sources import domain as D, templates as T
from ..sources.tables import Tables
from .registry import cte, query

st = lambda c: F.col(c).cast("string").alias(c)
ANCHOR = "SELECT max(purchase_date) AS anchor FROM x_orders"
CLOSE = """count(*) FILTER (status IN ('F','P')) AS decided, round(CAST(count(*) FILTER (status = 'F') AS DOUBLE) / nullif(count(*) FILTER (status IN ('F','P')), 0), 6) AS rate_count,
 round(CAST(sum(total) FILTER (status = 'F') AS DOUBLE) / CAST(sum(total) FILTER (status IN ('F','P')) AS DOUBLE), 6) AS rate_money"""
BAND = "CASE WHEN total < 100000 THEN 'small' WHEN total < 300000 THEN 'medium' ELSE 'large' END"


@query("m01_close_rate", f"SELECT {CLOSE} FROM x_orders")
def _(t: Tables):
    return D.orders(t).agg(*W.close_rate())


@query("m02_close_rate_cuts", f"""
SELECT coalesce(segment, 'ALL') AS segment, coalesce(band, 'ALL') AS band, {CLOSE} FROM (SELECT o.*, c.segment, {BAND} AS band FROM x_orders o JOIN x_customers c USING (customer_id))
GROUP BY GROUPING SETS ((segment), (band))""")
def _(t: Tables):
    q = D.orders(t).join(D.customers(t), "customer_id").withColumn("band", W.size_band())
    return q.groupingSets([["segment"], ["band"]], "segment", "band").agg(*W.close_rate()).na.fill("ALL", ["segment", "band"])


@query("m03_loss_reasons", "SELECT payment_type AS reason, count(*) AS n, CAST(sum(total) AS DOUBLE) AS lost FROM x_orders WHERE status = 'P' GROUP BY 1")
def _(t: Tables):
    return D.orders(t).filter("status = 'P'").groupBy(F.col("payment_type").alias("reason")).agg(F.count("*").alias("n"), dbl(F.sum("total")).alias("lost"))


def anchor_day(t: Tables):
    """Today: the last day with an order, as a literal, so that filters on it reach the scan."""
    return literals(D.orders(t).agg(F.max("purchase_date").alias("anchor")))["anchor"]


@query("m04_stale_quotes", f"SELECT order_id, CAST((SELECT anchor FROM ({ANCHOR})) - purchase_date AS INTEGER) AS days_open FROM x_orders WHERE status = 'O' AND (SELECT anchor FROM ({ANCHOR})) - purchase_date > 45")
def _(t: Tables):
    return D.orders(t).filter("status = 'O'").withColumn("days_open", F.datediff(anchor_day(t), "purchase_date")).filter(
        F.col("days_open") > W.STALE_QUOTE_DAYS).select("order_id", "days_open")


@query("m05_close_trend", f"SELECT ym, {CLOSE} FROM x_orders GROUP BY ym HAVING CAST(count(*) FILTER (status IN ('F','P')) AS DOUBLE) / count(*) > 0.66")
def _(t: Tables):
    g = D.orders(t).groupBy("ym").agg(*W.close_rate(), F.count("*").alias("n"))
    return g.filter(F.col("decided") / F.col("n") > 0.66).drop("n")


@query("m06_order_on_time", "SELECT ym, count(*) AS delivered, count(*) FILTER (on_time) AS on_time FROM x_ordel_days WHERE delivered_date IS NOT NULL GROUP BY ym")
def _(t: Tables):
    return D.v_orders(t, ()).filter("delivered_date IS NOT NULL").groupBy("ym").agg(F.count("*").alias("delivered"), F.count_if("on_time").alias("on_time"))


cte("x_obs", "SELECT line_seq AS stage, ship_date - purchase_date AS days, ship_date AS done FROM x_lines JOIN x_orders USING (order_id) WHERE ship_date >= purchase_date")


@query("m07_stage_times", "SELECT stage, CAST(quantile_cont(days, 0.5) AS DOUBLE) AS typical, CAST(quantile_cont(days, 0.8) AS DOUBLE) AS slow, count(*) AS n FROM x_obs GROUP BY stage")
def _(t: Tables):
    p = W.pace(W.stage_observations(D.lines(t), D.orders(t)), ["stage"], (W.TYPICAL, W.SLOW))
    return p


@query("m08_work_in_progress", "SELECT line_seq AS stage, count(*) AS pieces, CAST(sum(price) AS DOUBLE) AS money FROM x_lines JOIN x_orders USING (order_id) WHERE status = 'O' AND line_status = 'O' GROUP BY 1")
def _(t: Tables):
    return D.lines(t).filter("line_status = 'O'").join(D.orders(t).filter("status = 'O'").select("order_id"), "order_id", "left_semi").groupBy(
        F.col("line_seq").alias("stage")).agg(F.count("*").alias("pieces"), dbl(F.sum("price")).alias("money"))


cte("x_cost", """
SELECT l.*, o.status, o.ym, o.purchase_date, p.brand, p.category, CASE WHEN l.product_id % 10 <> 0 THEN CAST(round(p.list_price * CAST(l.quantity AS DECIMAL(12,2)) * CAST(0.6 AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) END AS material,
 round((50 + l.order_id % 500)::DOUBLE * CAST(l.price AS DOUBLE) / nullif(CAST(sum(l.price) OVER (PARTITION BY l.order_id) AS DOUBLE), 0), 2) AS transport
FROM x_lines l JOIN x_orders o USING (order_id) JOIN x_products p USING (product_id)""")


def pieces(t: Tables):
    p = W.spread(W.costed(D.lines(t), D.products(t)), (F.col("order_id") % 500 + 50).cast("double"))
    return p.join(D.orders(t).select("order_id", "status", "ym", "purchase_date"), "order_id")


@query("m10_order_cost_spread", "SELECT order_id, line_seq, product_id, seller_id, CAST(price AS DOUBLE) AS price, transport FROM x_cost")
def _(t: Tables):
    return W.spread(D.lines(t), (F.col("order_id") % 500 + 50).cast("double")).select("order_id", "line_seq", "product_id", "seller_id", dbl("price").alias("price"), "transport")


@query("m09_margin_per_piece", "SELECT order_id, line_seq, product_id, round(CAST(price AS DOUBLE) - CAST(material AS DOUBLE) - transport, 2) AS margin FROM x_cost WHERE status = 'F' AND material IS NOT NULL")
def _(t: Tables):
    return pieces(t).filter("status = 'F' AND material IS NOT NULL").select("order_id", "line_seq", "product_id", F.round(dbl("price") - dbl("material") - F.col("transport"), 2).alias("margin"))


@query("m11_without_cost", "SELECT status, count(*) AS pieces, count(*) FILTER (material IS NULL) AS without_cost FROM x_cost GROUP BY status")
def _(t: Tables):
    p = W.costed(D.lines(t), D.products(t)).join(D.orders(t).select("order_id", "status"), "order_id")
    return p.groupBy("status").agg(F.count("*").alias("pieces"), F.count_if(F.col("material").isNull()).alias("without_cost"))


@query("m12_margin_by_brand_month", """
SELECT brand, ym, count(*) AS pieces, CAST(sum(price) AS DOUBLE) AS sold, CAST(sum(material) AS DOUBLE) AS material, round(CAST(sum(price - material) AS DOUBLE) / CAST(sum(price) AS DOUBLE), 6) AS margin
FROM x_cost WHERE status = 'F' AND material IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    p = W.costed(D.lines(t), D.products(t)).filter("material IS NOT NULL").join(D.orders(t).filter("status = 'F'").select("order_id", "ym"), "order_id")
    return p.groupBy("brand", "ym").agg(F.count("*").alias("pieces"), dbl(F.sum("price")).alias("sold"), dbl(F.sum("material")).alias("material"),
                                        ratio(F.sum(F.col("price") - F.col("material")), F.sum("price")).alias("margin"))


@query("m13_margin_fall_cause", f"""
SELECT brand, round(m1 - m0, 6) AS margin_change, CASE WHEN d_mat >= d_tra THEN 'material' ELSE 'transport' END AS cause, round(greatest(d_mat, d_tra), 6) AS cause_change FROM (
 SELECT brand, mat1 / p1 - mat0 / p0 AS d_mat, tra1 / p1 - tra0 / p0 AS d_tra, 1 - (mat1 + tra1) / p1 AS m1, 1 - (mat0 + tra0) / p0 AS m0 FROM (
  SELECT brand, CAST(sum(price) FILTER (y = y0) AS DOUBLE) AS p0, CAST(sum(price) FILTER (y = y1) AS DOUBLE) AS p1, CAST(sum(material) FILTER (y = y0) AS DOUBLE) AS mat0, CAST(sum(material) FILTER (y = y1) AS DOUBLE) AS mat1,
   CAST(sum(CAST(transport AS DECIMAL(14,2))) FILTER (y = y0) AS DOUBLE) AS tra0, CAST(sum(CAST(transport AS DECIMAL(14,2))) FILTER (y = y1) AS DOUBLE) AS tra1
  FROM (SELECT *, ym // 100 AS y, (SELECT year(anchor) - 2 FROM ({ANCHOR})) AS y0, (SELECT year(anchor) - 1 FROM ({ANCHOR})) AS y1 FROM x_cost WHERE status = 'F' AND material IS NOT NULL) GROUP BY brand)) WHERE m1 < m0""")
def _(t: Tables):
    """The last whole year against the one before."""
    y1 = F.year(anchor_day(t)) - 1
    p = pieces(t).filter("status = 'F' AND material IS NOT NULL").withColumn("y", F.floor(F.col("ym") / 100))
    at = lambda c, back: dbl(F.sum(F.when(F.col("y") == y1 - back, F.col(c).cast("decimal(14,2)"))))
    g = p.filter(F.col("y").between(y1 - 1, y1)).groupBy("brand").agg(*[at(c, back).alias(f"{c}{back}") for c in ("price", "material", "transport") for back in (0, 1)])
    share = lambda c, y: F.col(f"{c}{y}") / F.col(f"price{y}")
    margin = lambda y: 1 - (F.col(f"material{y}") + F.col(f"transport{y}")) / F.col(f"price{y}")
    g = g.select("brand", margin(1).alias("m0"), margin(0).alias("m1"), (share("material", 0) - share("material", 1)).alias("dm"), (share("transport", 0) - share("transport", 1)).alias("dt"))
    return g.filter("m1 < m0").select("brand", F.round(F.col("m1") - F.col("m0"), 6).alias("margin_change"),
                                      F.when(F.col("dm") >= F.col("dt"), "material").otherwise("transport").alias("cause"), F.round(F.greatest("dm", "dt"), 6).alias("cause_change"))


@query("m14_billed_vs_delivered", """
SELECT coalesce(b.ym, d.ym) AS ym, coalesce(billed, 0) AS billed, coalesce(delivered, 0) AS delivered FROM (SELECT ym, CAST(sum(total) AS DOUBLE) AS billed FROM x_orders WHERE status = 'F' GROUP BY ym) b
FULL JOIN (SELECT CAST(year(delivered_date) * 100 + month(delivered_date) AS INTEGER) AS ym, CAST(sum(items_value) AS DOUBLE) AS delivered FROM x_mordel WHERE delivered_date IS NOT NULL GROUP BY 1) d ON b.ym = d.ym""")
def _(t: Tables):
    b = D.orders(t).filter("status = 'F'").groupBy("ym").agg(dbl(F.sum("total")).alias("billed"))
    d = D.v_orders(t, ()).filter("delivered_date IS NOT NULL").groupBy(D.ym("delivered_date").alias("ym")).agg(dbl(F.sum("items_value")).alias("delivered"))
    return b.join(d, "ym", "full_outer").na.fill(0.0)


def recent(t: Tables, day):
    """Stage observations of the last 120 days."""
    o = W.stage_observations(D.lines(t), D.orders(t))
    return o.filter((F.col("done") <= day) & (F.col("done") > F.date_sub(day, W.RECENT_DAYS)))


@query("m15_recent_pace", f"SELECT stage, CAST(median(days) AS DOUBLE) AS typical, count(*) AS n FROM x_obs WHERE done <= (SELECT anchor FROM ({ANCHOR})) AND done > (SELECT anchor FROM ({ANCHOR})) - 120 GROUP BY stage")
def _(t: Tables):
    return W.pace(recent(t, anchor_day(t)), ["stage"])


cte("x_stages", "SELECT order_id, " + ", ".join(f"min(ship_date) FILTER (line_seq = {s}) AS s{s}" for s in range(1, 8)) + ", max(ship_date) AS last_line FROM x_lines GROUP BY order_id")
cte("x_pace", f"SELECT a AS as_of, " + ", ".join(f"CAST(median(days) FILTER (stage = {s}) AS DOUBLE) AS p{s}" for s in range(1, 8)) + f" FROM x_obs, (SELECT anchor AS a FROM ({ANCHOR})) WHERE done <= a AND done > a - 120 GROUP BY a")


def est_sql(asof: str) -> str:
    days = " + ".join(f"CASE WHEN s{s} IS NULL OR s{s} > {asof} THEN p{s} ELSE 0.0::DOUBLE END" for s in range(1, 8))
    left = " + ".join(f"CAST(s{s} IS NULL OR s{s} > {asof} AS INTEGER)" for s in range(1, 8))
    which = ", ".join(f"CASE WHEN s{s} IS NULL OR s{s} > {asof} THEN '{s}' END" for s in range(1, 8))
    return f"CAST(ceil({days}) AS INTEGER) AS days_left, {left} AS stages_left, concat_ws(',', {which}) AS which"


cte("x_est", f"""
SELECT *, as_of + days_left AS estimated, 'stages left: ' || which || '; days at recent pace: ' || coalesce(CAST(days_left AS VARCHAR), 'unknown') AS why FROM (
 SELECT o.order_id, o.promised_date, p.as_of, {est_sql('p.as_of')} FROM x_orders o LEFT JOIN x_stages g USING (order_id), x_pace p WHERE o.status = 'O')""")


def open_estimates(t: Tables):
    day = anchor_day(t)
    paces = literals(W.wide_pace(recent(t, day).withColumn("as_of", day), ["as_of"]))
    live = D.orders(t).filter("status = 'O'").join(W.stage_dates(D.lines(t)), "order_id", "left")
    return W.estimate(live.withColumns(paces), F.col("as_of"))


@query("m16_estimated_finish", "SELECT order_id, stages_left, days_left, CAST(estimated AS VARCHAR) AS estimated, why FROM x_est")
def _(t: Tables):
    return open_estimates(t).select("order_id", "stages_left", "days_left", st("estimated"), "why")


@query("j25_remaining_stages", "SELECT stage, count(*) AS pieces FROM (SELECT order_id, unnest([1,2,3,4,5,6,7]) AS stage, which FROM x_est) WHERE contains(which, CAST(stage AS VARCHAR)) GROUP BY stage")
def _(t: Tables):
    # The route has seven stages, so the left-over list of an order is at most seven long.
    done = D.lines(t).filter(F.col("ship_date") <= anchor_day(t)).groupBy("order_id").agg(F.collect_set("line_seq").alias("done"))
    live = D.orders(t).filter("status = 'O'").select("order_id").join(done, "order_id", "left")
    route = F.array(*[F.lit(s) for s in W.ROUTE])
    left = F.array_except(route, F.coalesce("done", F.array().cast("array<int>")))
    return live.select(F.explode(left).alias("stage")).groupBy("stage").agg(F.count("*").alias("pieces"))


@query("p21_delivery_risk", """
SELECT order_id, CASE WHEN promised_date < as_of THEN 'overdue' WHEN estimated > promised_date THEN 'running late' WHEN promised_date - estimated < 5 THEN 'tight' ELSE 'on time' END AS risk FROM x_est""")
def _(t: Tables):
    return open_estimates(t).select("order_id", W.risk_status(F.col("as_of")).alias("risk"))


cte("x_asofs", f"SELECT CAST(date_trunc('month', anchor) - to_months(CAST(m AS INTEGER)) AS DATE) + 14 AS as_of FROM ({ANCHOR}), range(1, 13) r(m)")
cte("x_btpace", "SELECT as_of, " + ", ".join(f"CAST(median(days) FILTER (stage = {s}) AS DOUBLE) AS p{s}" for s in range(1, 8)) + " FROM x_obs, x_asofs WHERE done <= as_of AND done > as_of - 120 GROUP BY as_of")
cte("x_bt", f"""
SELECT *, coalesce(as_of + days_left > promised_date, false) AS flagged,
 CASE status WHEN 'P' THEN false WHEN 'F' THEN coalesce(last_line, (SELECT anchor FROM ({ANCHOR}))) > promised_date ELSE (SELECT anchor FROM ({ANCHOR})) > promised_date END AS late,
 CASE WHEN status = 'F' THEN abs(as_of + days_left - last_line) END AS error_days FROM (
 SELECT o.order_id, o.status, o.promised_date, g.last_line, p.as_of, {est_sql('p.as_of')} FROM x_orders o LEFT JOIN x_stages g USING (order_id), x_btpace p WHERE o.purchase_date <= p.as_of AND (g.last_line IS NULL OR g.last_line > p.as_of))""")


@query("m17_backtest", """
SELECT CAST(as_of AS VARCHAR) AS as_of, count(*) AS n, count(*) FILTER (flagged) AS n_flagged, round(CAST(count(*) FILTER (flagged AND late) AS DOUBLE) / nullif(count(*) FILTER (flagged), 0), 6) AS precision,
 round(CAST(count(*) FILTER (flagged AND late) AS DOUBLE) / nullif(count(*) FILTER (late), 0), 6) AS recall, CAST(median(error_days) AS DOUBLE) AS median_error FROM x_bt GROUP BY as_of""")
def _(t: Tables):
    anchor = D.orders(t).agg(F.max("purchase_date")).first()[0]
    # The 15th of the 12 months before the month of the last order.
    as_ofs = [date(m // 12, m % 12 + 1, 15) for m in range(12 * anchor.year + anchor.month - 13, 12 * anchor.year + anchor.month - 1)] if anchor else []
    b = W.backtest(D.orders(t), D.lines(t), as_ofs, F.lit(anchor).cast("date"))
    # Whole error days are counted first, so the median reads distinct values only.
    g = b.groupBy("as_of", "error_days").agg(F.count("*").alias("k"), F.count_if("flagged").alias("f"), F.count_if("late").alias("l"), F.count_if(F.col("flagged") & F.col("late")).alias("fl"))
    return g.groupBy(F.col("as_of").cast("string").alias("as_of")).agg(
        F.sum("k").alias("n"), F.sum("f").alias("n_flagged"), ratio(F.sum("fl"), F.sum("f")).alias("precision"),
        ratio(F.sum("fl"), F.sum("l")).alias("recall"), F.expr("percentile(error_days, 0.5, k)").alias("median_error"))


@query("l02_longest_in_stage", f"""
SELECT stage, order_id, seller_id, CAST(age AS INTEGER) AS age FROM (SELECT line_seq AS stage, order_id, seller_id, product_id, (SELECT anchor FROM ({ANCHOR})) - ship_date AS age,
 row_number() OVER (PARTITION BY line_seq ORDER BY ship_date, order_id, seller_id, product_id) AS rn FROM x_lines WHERE line_status = 'O') WHERE rn <= 3""")
def _(t: Tables):
    w = Window.partitionBy("stage").orderBy("ship_date", "order_id", "seller_id", "product_id")
    # rn <= 3 keeps three rows per stage in every task before the shuffle.
    top = D.lines(t).filter("line_status = 'O'").withColumn("stage", F.col("line_seq")).withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    return top.select("stage", "order_id", "seller_id", F.datediff(anchor_day(t), "ship_date").alias("age"))


#: Orders that the list of the most urgent ones shows.
MOST_URGENT = 20


@query("l02b_risk_by_urgency", f"""
SELECT order_id, CAST(promised_date AS VARCHAR) AS promised_date, risk FROM (
 SELECT *, CASE WHEN promised_date < as_of THEN 'overdue' WHEN estimated > promised_date THEN 'running late' WHEN promised_date - estimated < 5 THEN 'tight' ELSE 'on time' END AS risk FROM x_est) e
WHERE risk <> 'on time' ORDER BY e.promised_date, order_id LIMIT {MOST_URGENT}""")
def _(t: Tables):
    risk = open_estimates(t).withColumn("risk", W.risk_status(F.col("as_of"))).filter("risk <> 'on time'")
    return risk.orderBy("promised_date", "order_id").limit(MOST_URGENT).select("order_id", st("promised_date"), "risk")


@query("j06_never_invoiced", """
SELECT 'delivered without invoice' AS finding, order_id FROM x_orders WHERE status = 'F' AND order_id NOT IN (SELECT order_id FROM x_lines)
UNION ALL SELECT 'invoice without order', order_id FROM x_summary WHERE order_id NOT IN (SELECT order_id FROM x_orders WHERE status <> 'P')""")
def _(t: Tables):
    inv = D.lines(t).select("order_id").distinct()
    a = D.orders(t).filter("status = 'F'").join(inv, "order_id", "left_anti").select(F.lit("delivered without invoice").alias("finding"), "order_id")
    b = inv.join(D.orders(t).filter("status <> 'P'").select("order_id"), "order_id", "left_anti").select(F.lit("invoice without order").alias("finding"), "order_id")
    return a.unionByName(b)


@query("j07_folio_or_uuid", """
SELECT o.order_id, CASE WHEN order_id % 2 = 0 THEN 'folio' ELSE 'uuid' END AS matched_by, abs(total - items_value) > 1000 AS disagrees
FROM x_orders o JOIN x_summary s USING (order_id) WHERE order_id % 3 <> 0""")
def _(t: Tables):
    # Orders carry either the folio or the uuid of their invoice; two equi joins instead of an OR.
    folio, uid = F.concat(F.lit("A-"), "order_id"), F.md5(F.col("order_id").cast("string"))
    o = D.orders(t).withColumn("ref", F.when(F.col("order_id") % 3 == 0, F.lit(None)).when(F.col("order_id") % 2 == 0, folio).otherwise(uid))
    inv = D.order_lines_summary(t).select(folio.alias("folio"), uid.alias("uuid"), F.col("items_value").alias("billed"))
    by = lambda key: o.filter("ref IS NOT NULL").join(inv.select(F.col(key).alias("ref"), "billed"), "ref").select(
        "order_id", F.lit(key).alias("matched_by"), (F.abs(F.col("total") - F.col("billed")) > 1000).alias("disagrees"))
    return by("folio").unionByName(by("uuid"))


@query("s04_template_values", "SELECT order_id, CAST(total AS DOUBLE) AS amount, CAST(purchase_date AS VARCHAR) AS quoted, payment_type AS option FROM x_orders")
def _(t: Tables):
    o = D.orders(t)
    text = o.select(
        F.col("order_id").cast("string").alias("Folio "), F.concat(F.lit("$"), F.format_number("total", 2)).alias("IMPORTE"),
        F.when(F.col("order_id") % 3 == 0, F.datediff("purchase_date", F.lit("1899-12-30").cast("date")).cast("string"))
        .when(F.col("order_id") % 3 == 1, F.date_format("purchase_date", "dd/MM/yyyy")).otherwise(F.col("purchase_date").cast("string")).alias("Fécha Cotización"),
        F.upper("payment_type").alias("opcion"))
    spec = [T.Field("order_id", "folio", "int"), T.Field("amount", "importe", "money"), T.Field("quoted", "fecha cotizacion", "date"),
            T.Field("option", "opción", "option", tuple(D.PROMISE_DAYS))]
    got = T.read_template(text, spec)
    return got.filter(F.size("reasons") == 0).select("order_id", dbl("amount").alias("amount"), st("quoted"), "option")
