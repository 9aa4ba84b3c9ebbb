"""Airline disruption queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import cents, dbl, ratio
from ..operators import airline as L
from ..session import literals, settle
from ..sources import domain as D
from ..sources.tables import Tables
from .registry import cte, query

HORIZON = 120

cte("x_staged", "SELECT order_id, line_seq, product_id, seller_id, price FROM x_slines")
cte("x_legs", """
SELECT *, coalesce(arr + 45 > next_dep, false) AS missed FROM (SELECT order_id AS passenger, line_seq AS leg, line_seq * 240 AS dep, line_seq * 240 + 120 + CAST(CAST(price * 100 AS BIGINT) % 200 AS INTEGER) AS arr,
 CAST(CAST(price * 100 AS BIGINT) % 200 AS INTEGER) AS delay, seller_id % 25 AS at_city, product_id % 25 AS to_city, lead(line_seq * 240) OVER (PARTITION BY order_id ORDER BY line_seq) AS next_dep FROM x_staged)""")


def legs(t: Tables):
    delay = (cents("price") % 200).cast("int")
    return D.staged_lines(t).select(
        F.col("order_id").alias("passenger"), F.col("line_seq").alias("leg"), (F.col("line_seq") * 240).alias("dep"), (F.col("line_seq") * 240 + 120 + delay).alias("arr"),
        delay.alias("delay"), (F.col("seller_id") % 25).alias("at_city"), (F.col("product_id") % 25).alias("to_city"))


@query("j20_missed_connections", "SELECT passenger, leg, delay, delay < 60 AS under_one_hour FROM x_legs WHERE missed")
def _(t: Tables):
    return L.missed_connections(legs(t)).filter("missed").select("passenger", "leg", "delay", (F.col("delay") < 60).alias("under_one_hour"))


cte("x_pax", """
SELECT passenger AS ask_id, o, z, CAST(purchase_date - DATE '1995-01-01' AS INTEGER) AS asked FROM (
 SELECT passenger, first(at_city ORDER BY leg) FILTER (missed) AS o, first(to_city ORDER BY leg DESC) AS z FROM x_legs GROUP BY passenger) JOIN x_orders ON order_id = passenger WHERE o IS NOT NULL AND o <> z""")
cte("x_flights", "SELECT order_id AS flight_id, customer_id % 25 AS o, order_id % 25 AS z, CAST(purchase_date - DATE '1995-01-01' AS INTEGER) AS dep, CAST(1 + order_id % 3 AS INTEGER) AS seats FROM x_orders WHERE customer_id % 25 <> order_id % 25")
cte("x_days", "SELECT o, z, dep, min(flight_id) AS flight_id FROM x_flights GROUP BY ALL")

day_no = lambda c: F.datediff(c, F.lit("1995-01-01").cast("date"))


def stranded(t: Tables):
    m = L.missed_connections(legs(t)).groupBy("passenger").agg(
        F.min_by("at_city", F.when(F.col("missed"), F.col("leg"))).alias("o"), F.max_by("to_city", "leg").alias("z"), F.bool_or("missed").alias("any"))
    return m.filter("any AND o <> z").join(D.orders(t).select(F.col("order_id").alias("passenger"), "purchase_date"), "passenger").select(
        F.col("passenger").alias("ask_id"), "o", "z", day_no("purchase_date").alias("at"))


def flights(t: Tables):
    o = D.orders(t)
    return o.select(F.col("order_id").alias("flight_id"), (F.col("customer_id") % 25).alias("o"), (F.col("order_id") % 25).alias("z"),
                    day_no("purchase_date").alias("dep"), (F.col("order_id") % 3 + 1).cast("int").alias("seats")).filter("o <> z")


@query("j21_reaccommodation_options", f"""
WITH d AS (SELECT p.*, f.dep AS arrive FROM x_pax p ASOF JOIN x_days f ON f.o = p.o AND f.z = p.z AND f.dep >= p.asked),
v1 AS (SELECT a.*, f.dep AS d1 FROM (SELECT p.*, h.z AS h FROM x_pax p JOIN (SELECT DISTINCT o, z FROM x_days) h ON h.o = p.o AND h.z <> p.z) a ASOF JOIN x_days f ON f.o = a.o AND f.z = a.h AND f.dep >= a.asked),
v2 AS (SELECT v.*, f.dep AS arrive FROM (SELECT *, d1 + 1 AS d1n FROM v1) v ASOF JOIN x_days f ON f.o = v.h AND f.z = v.z AND f.dep >= v.d1n),
c AS (SELECT ask_id, asked, arrive, 'direct' AS kind, -1 AS hub FROM d UNION ALL SELECT ask_id, asked, arrive, 'via', h FROM v2)
SELECT ask_id, count(*) AS n_options, first(arrive ORDER BY arrive, kind, hub) AS arrive, first(kind ORDER BY arrive, kind, hub) AS kind, CAST(first(hub ORDER BY arrive, kind, hub) AS BIGINT) AS hub FROM c WHERE arrive <= asked + {HORIZON} GROUP BY ask_id""")
def _(t: Tables):
    one_a_day = flights(t).groupBy("o", "z", "dep").agg(F.min("flight_id").alias("flight_id"))
    return L.options(stranded(t), one_a_day, HORIZON).withColumn("hub", F.col("hub").cast("bigint"))


cte("x_queue", "SELECT ask_id, o, z, row_number() OVER (PARTITION BY o, z ORDER BY asked, ask_id) AS n FROM x_pax")
cte("x_asked", "SELECT o, z, asked, sum(k) OVER (PARTITION BY o, z ORDER BY asked) AS a FROM (SELECT o, z, asked, count(*) AS k FROM x_pax GROUP BY o, z, asked)")
cte("x_taken", """
SELECT o, z, arg_min(flight_id, (dep, flight_id)) AS flight_id, taken FROM (
 SELECT *, c + least(0, min(a - c) OVER (PARTITION BY o, z ORDER BY dep, flight_id)) AS taken FROM (
  SELECT f.*, coalesce(q.a, 0) AS a, sum(seats) OVER (PARTITION BY f.o, f.z ORDER BY f.dep, f.flight_id) AS c FROM x_flights f ASOF LEFT JOIN x_asked q ON q.o = f.o AND q.z = f.z AND q.asked <= f.dep)) GROUP BY o, z, taken""")
cte("x_given", "SELECT q.ask_id, t.flight_id FROM x_queue q ASOF JOIN x_taken t ON t.o = q.o AND t.z = q.z AND t.taken >= q.n")


@query("w30_seat_allocation", "SELECT ask_id, flight_id FROM x_given")
def _(t: Tables):
    return L.allocate(stranded(t), flights(t))


@query("w30b_seats_on_connections")
def _(t: Tables):
    return L.reaccommodate(stranded(t), flights(t), HORIZON)


cte("x_dis", """
SELECT *, CASE WHEN attributable AND NOT long AND delay >= 60 THEN CAST(round(fare * CAST(0.075 AS DECIMAL(5,3)), 2) AS DECIMAL(12,2)) ELSE 0 END + CASE WHEN long THEN fare ELSE 0 END
  + CASE WHEN attributable AND long THEN CAST(round(fare * CAST(0.25 AS DECIMAL(5,3)), 2) AS DECIMAL(12,2)) ELSE 0 END AS owed FROM (
 SELECT *, cancelled OR delay >= 240 AS long FROM (SELECT order_id, customer_id, purchase_date, total AS fare, CAST(CAST(total * 100 AS BIGINT) % 600 AS INTEGER) AS delay, status = 'P' AS cancelled,
  CASE payment_type WHEN '1-URGENT' THEN 'engine recall' WHEN '2-HIGH' THEN 'crew' WHEN '3-MEDIUM' THEN 'weather' WHEN '4-NOT SPECIFIED' THEN 'airspace' WHEN '5-LOW' THEN 'maintenance' ELSE 'other' END AS cause,
  payment_type IN ('1-URGENT', '2-HIGH', '5-LOW') AS attributable FROM x_orders))""")


def disruptions(t: Tables):
    name, owed = L.cause("payment_type")
    o = D.orders(t).select("order_id", "customer_id", "purchase_date", F.col("total").alias("fare"), (cents("total") % 600).cast("int").alias("delay"), (F.col("status") == "P").alias("cancelled"), name.alias("cause"), owed.alias("attributable"))
    return L.entitlement(o)


@query("p22_entitlement", """
SELECT order_id, cause, delay >= 60 OR cancelled AS food, attributable AND delay >= 480 AS hotel, CAST(owed AS DOUBLE) AS owed FROM x_dis""")
def _(t: Tables):
    return disruptions(t).select("order_id", "cause", "food", "hotel", dbl("owed").alias("owed"))


cte("x_claims", "SELECT *, CASE WHEN owed = 0 THEN 'not owed' WHEN claimed <= owed THEN 'valid' ELSE 'partial' END AS verdict FROM (SELECT *, CAST(round(fare * CAST((order_id % 4) * 0.1 AS DECIMAL(3,1)), 2) AS DECIMAL(14,2)) AS claimed FROM x_dis) WHERE claimed > 0")


def claims(t: Tables):
    c = disruptions(t).withColumn("claimed", F.round(F.col("fare") * ((F.col("order_id") % 4) * 0.1).cast("decimal(3,1)"), 2).cast("decimal(14,2)")).withColumn("filed", F.col("purchase_date"))
    return L.adjudicate(c.filter("claimed > 0"))


@query("c01_claims", "SELECT order_id, verdict, CAST(least(owed, claimed) AS DOUBLE) AS pay, CAST(claimed - least(owed, claimed) AS DOUBLE) AS overpayment, CAST(purchase_date + 10 AS VARCHAR) AS deadline FROM x_claims")
def _(t: Tables):
    return claims(t).select("order_id", "verdict", dbl("pay").alias("pay"), dbl("overpayment").alias("overpayment"), F.col("deadline").cast("string").alias("deadline"))


@query("c02_disruption_summary", """
SELECT coalesce(cause, 'ALL') AS cause, count(*) AS disrupted, count(*) FILTER (cancelled) AS cancelled, count(*) FILTER (delay < 60 AND NOT cancelled) AS under_one_hour, CAST(sum(owed) AS DOUBLE) AS owed FROM x_dis WHERE delay > 0 OR cancelled GROUP BY ROLLUP (cause)""")
def _(t: Tables):
    return disruptions(t).filter("delay > 0 OR cancelled").rollup("cause").agg(
        F.count("*").alias("disrupted"), F.count_if("cancelled").alias("cancelled"), F.count_if(F.expr("delay < 60 AND NOT cancelled")).alias("under_one_hour"), dbl(F.sum("owed")).alias("owed")
    ).withColumn("cause", F.coalesce("cause", F.lit("ALL")))


@query("c02b_reaccommodated_share", "SELECT count(*) AS stranded, count(g.ask_id) AS reaccommodated, round(CAST(count(g.ask_id) AS DOUBLE) / count(*), 6) AS share FROM x_pax p LEFT JOIN x_given g USING (ask_id)")
def _(t: Tables):
    s = stranded(t)
    g = L.allocate(s, flights(t)).withColumn("ok", F.lit(1))
    return s.join(g.select("ask_id", "ok"), "ask_id", "left").agg(F.count("*").alias("stranded"), F.count("ok").alias("reaccommodated"), ratio(F.count("ok"), F.count("*")).alias("share"))


@query("c03_loss_sensitivity", """
SELECT rate, round(refunds * (1 - rate), 2) AS lost_refunds, overpaid, reviews * 120.0::DOUBLE AS review_cost, round(refunds * (1 - rate), 2) + overpaid + reviews * 120.0::DOUBLE AS total FROM
 (SELECT CAST(sum(owed) AS DOUBLE) AS refunds FROM x_dis WHERE long), (SELECT CAST(sum(claimed - least(owed, claimed)) AS DOUBLE) AS overpaid, count(*) AS reviews FROM x_claims), (VALUES (0.6::DOUBLE), (0.7::DOUBLE), (0.85::DOUBLE)) s(rate)""")
def _(t: Tables):
    r = disruptions(t).filter(F.col("cancelled") | (F.col("delay") >= L.REFUND_MIN)).agg(dbl(F.sum("owed")).alias("refunds"))
    c = claims(t).agg(dbl(F.sum("overpayment")).alias("overpaid"), F.count("*").alias("reviews"))
    s = r.withColumns(literals(c)).withColumn("rate", F.explode(F.array(*[F.lit(x) for x in (0.6, 0.7, 0.85)])))
    lost = F.round(F.col("refunds") * (1 - F.col("rate")), 2)
    return s.select("rate", lost.alias("lost_refunds"), "overpaid", (F.col("reviews") * F.lit(120.0)).alias("review_cost"), (lost + F.col("overpaid") + F.col("reviews") * F.lit(120.0)).alias("total"))


@query("l04_spare_aircraft", """
WITH r AS (SELECT o, n, row_number() OVER (ORDER BY n DESC, o) AS rk, sum(n) OVER () AS total FROM (SELECT o, count(*) AS n FROM x_pax GROUP BY o))
SELECT k AS spares, CAST(sum(n) FILTER (rk <= k) AS BIGINT) AS recovered, CAST((any_value(total) - sum(n) FILTER (rk <= k)) * 1778 AS BIGINT) AS cost FROM r, (VALUES (2), (3), (4)) s(k) GROUP BY k""")
def _(t: Tables):
    per = settle(stranded(t)).groupBy("o").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    top = per.orderBy(F.desc("n"), "o").limit(4).agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), F.col("o").alias("o")))).alias("top"))
    k = top.withColumns(literals(total)).withColumn("spares", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))))
    got = F.aggregate(F.slice("top", F.lit(1), F.col("spares")), F.lit(0).cast("bigint"), lambda a, x: a - x["col1"])
    return k.select("spares", got.alias("recovered"), ((F.col("total") - got) * 1778).alias("cost"))


SPARE_SEATS, LOSS = 90, 1778
cte("x_grounded", """
SELECT CAST(year(purchase_date) AS INTEGER) AS period, customer_id // 10 AS tail, order_id AS flight_id, customer_id % 25 AS o, order_id % 25 AS z, CAST(purchase_date - DATE '1995-01-01' AS INTEGER) AS dep, booked
FROM x_orders JOIN (SELECT order_id, CAST(sum(line_seq * 20) AS BIGINT) AS booked FROM x_staged GROUP BY order_id) USING (order_id) WHERE customer_id // 10 % 4 = 0""")
cte("x_chains", f"""
SELECT period, tail, max(got) AS recovered FROM (
 WITH RECURSIVE c AS (SELECT period, tail, z, dep, least(booked, {SPARE_SEATS}) AS got FROM x_grounded
  UNION ALL SELECT g.period, g.tail, g.z, g.dep, c.got + least(g.booked, {SPARE_SEATS}) FROM c JOIN x_grounded g ON g.period = c.period AND g.tail = c.tail AND g.o = c.z AND g.dep >= c.dep + 1)
 SELECT * FROM c) GROUP BY period, tail""")
cte("x_ranked", "SELECT *, row_number() OVER (PARTITION BY period ORDER BY recovered DESC, tail) AS rk FROM x_chains")


def grounded(t: Tables):
    """Legs of the aircraft on the ground, a year each: ten customers are one aircraft, every fourth aircraft stands."""
    booked = D.staged_lines(t).groupBy("order_id").agg(F.sum(F.col("line_seq") * 20).cast("bigint").alias("booked"))
    o = D.orders(t).withColumn("tail", F.floor(F.col("customer_id") / 10)).filter("tail % 4 = 0")
    return o.join(booked, "order_id").select(
        F.year("purchase_date").alias("period"), "tail", F.col("order_id").alias("flight_id"), (F.col("customer_id") % 25).alias("o"),
        (F.col("order_id") % 25).alias("z"), day_no("purchase_date").alias("dep"), "booked")


@query("l04b_rotations", "SELECT period, tail, CAST(rk AS INTEGER) AS rank, CAST(recovered AS BIGINT) AS recovered FROM x_ranked WHERE rk <= 4")
def _(t: Tables):
    return L.assigned(L.rotations(grounded(t), SPARE_SEATS), 4).select("period", "tail", "rank", "recovered")


@query("l04c_cost_of_spares", f"""
SELECT period, k AS spares, any_value(stranded) AS stranded, CAST(sum(recovered) AS BIGINT) AS recovered, CAST((any_value(stranded) - sum(recovered)) * {LOSS} AS BIGINT) AS cost
FROM x_ranked JOIN (SELECT period, CAST(sum(booked) AS BIGINT) AS stranded FROM x_grounded GROUP BY period) USING (period), (VALUES (2), (3), (4)) s(k) WHERE rk <= k GROUP BY period, k""")
def _(t: Tables):
    legs = settle(grounded(t))
    return L.cost_of_spares(legs, L.rotations(legs, SPARE_SEATS), [2, 3, 4], LOSS)
