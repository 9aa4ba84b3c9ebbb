"""Targets, anomaly, alert, event-impact and digest queries."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import functions as F

from ..functions.money import dbl, ratio
from ..operators import anomalies as A, kpi as K, targets as G
from ..session import literals, settle
from ..sources import domain as D
from ..sources.tables import Tables
from .kpis import MONTH_COMPLETE
from .registry import CTES, cte, query

HOLIDAYS = ["01-01", "05-01", "12-25"]
EVENTS = [
    A.Event("spring sale", "planned", date(1996, 3, 11), date(1996, 3, 24), 1.3, ("orders", "sales")),
    A.Event("november sale", "planned", date(1997, 11, 17), date(1997, 11, 30), 1.4, ("orders", "sales")),
    A.Event("carrier strike", "unplanned", date(1998, 5, 18), date(1998, 6, 14)),
]
UPLIFT = {199603: 1.3, 199711: 1.4}
OVERRIDES = [("ASIA", 199806, 2500000.0), ("EUROPE", 199502, 900000.0)]
FLOOR = 3.0  # orders a day; low enough that the fixture has daily and weekly series
USERS = [("director", "director", None), ("analyst", "analyst", None), ("manager.asia", "manager", "ASIA"),
         ("manager.europe", "manager", "EUROPE"), ("seller.7", "seller", None)]
PLAYBOOKS = [("orders", "Commerce", "check traffic and prices"), ("sales", "Commerce", "review the sales plan"),
             ("on_time", "Logistics", "warn customers of orders at risk"), ("pickups", "Logistics", "ask carriers whether pickups stopped"),
             ("late_dispatch", "Sellers desk", "contact the sellers behind"), ("negative_reviews", "Service", "read the comments of the week")]


def complete_months(t: Tables):
    m = D.orders(t).groupBy("ym").agg(F.count("*").alias("n"))
    usual = m.agg(F.expr("percentile(n, 0.5)").alias("usual"))
    return m.select("ym", (F.col("n") >= literals(usual)["usual"] * MONTH_COMPLETE).alias("is_complete"))


def region_day_sales(t: Tables):
    return D.v_sales(t, ("customer",)).filter("status <> 'P'").groupBy("region", F.col("purchase_date").alias("day"), "ym").agg(
        F.sum("price").alias("sales"))


def targets(t: Tables):
    m = region_day_sales(t).groupBy("region", "ym").agg(F.sum("sales").alias("sales"))
    return G.run_rate(G.monthly(m, complete_months(t), UPLIFT), t.rows("region string, ym int, override double", OVERRIDES))


cte("x_msales", """
SELECT region, ym, ym // 100 * 12 + ym % 100 - 1 AS mi, CAST(m AS DOUBLE) AS sales, uplift, CAST((CAST(m * 100 AS HUGEINT) * 2000 + uplift) // (2 * uplift) AS DECIMAL(20,0)) AS base_cents FROM (
 SELECT region, ym, sum(price) AS m, CASE ym WHEN 199603 THEN 1300 WHEN 199711 THEN 1400 ELSE 1000 END AS uplift FROM x_vsales WHERE status <> 'P' GROUP BY region, ym)""")
cte("x_derived", """
SELECT a.region, a.ym, CAST((CAST(sum(b.base_cents) AS HUGEINT) * 210 * any_value(a.uplift) + 300000) // 600000 AS DOUBLE) / 100 AS derived
FROM x_msales a JOIN x_complete ca USING (ym) JOIN x_msales b ON a.region = b.region AND b.mi BETWEEN a.mi - 3 AND a.mi - 1
JOIN x_complete cb ON cb.ym = b.ym WHERE ca.is_complete GROUP BY a.region, a.ym HAVING count(*) = 3 AND bool_and(cb.is_complete)""")
cte("x_targets", """
SELECT coalesce(d.region, o.region) AS region, coalesce(d.ym, o.ym) AS ym, coalesce(o.v, d.derived) AS target
FROM x_derived d FULL JOIN (VALUES ('ASIA', 199806, 2500000.0::DOUBLE), ('EUROPE', 199502, 900000.0::DOUBLE)) o(region, ym, v) ON d.region = o.region AND d.ym = o.ym""")


@query("k14_run_rate_target", "SELECT region, CAST(ym AS INTEGER) AS ym, target FROM x_targets")
def _(t: Tables):
    return targets(t)


@query("k15_uplift_in_target", """
SELECT region, CAST(ym AS INTEGER) AS ym, CAST(base_cents AS DOUBLE) / 100 AS base, round(sales, 2) AS sales FROM x_msales""")
def _(t: Tables):
    m = region_day_sales(t).groupBy("region", "ym").agg(F.sum("sales").alias("sales"))
    return G.monthly(m, complete_months(t), UPLIFT).select("region", "ym", dbl("base").alias("base"), F.round(dbl("sales"), 2).alias("sales"))


cte("x_due", """
SELECT region, ym, target * (least(last_day(make_date(ym // 100, ym % 100, 1)), DATE '1998-09-20') - greatest(make_date(ym // 100, ym % 100, 1), DATE '1996-05-10') + 1)
  / (last_day(make_date(ym // 100, ym % 100, 1)) - make_date(ym // 100, ym % 100, 1) + 1) AS due
FROM x_targets WHERE least(last_day(make_date(ym // 100, ym % 100, 1)), DATE '1998-09-20') >= greatest(make_date(ym // 100, ym % 100, 1), DATE '1996-05-10')""")


@query("k02_target_attainment", """
SELECT region, sales, target_sales, round(sales / target_sales, 4) AS attainment FROM (
 SELECT d.region, CAST(sum(s.sales) AS DOUBLE) AS sales, round(sum(d.due), 2) AS target_sales FROM x_due d
 LEFT JOIN (SELECT region, ym, sum(price) AS sales FROM x_vsales WHERE status <> 'P' AND purchase_date BETWEEN DATE '1996-05-10' AND DATE '1998-09-20' GROUP BY ALL) s
   ON s.region = d.region AND s.ym = d.ym GROUP BY d.region)""")
def _(t: Tables):
    return G.attainment(region_day_sales(t), targets(t), "1996-05-10", "1998-09-20")


@query("j10_daily_sales_target", """
SELECT region, CAST(purchase_date AS VARCHAR) AS day, CAST(sum(price) AS DOUBLE) AS sales,
       round(any_value(target) / day(last_day(purchase_date)), 2) AS day_target
FROM x_vsales JOIN x_targets USING (region, ym) WHERE status <> 'P' GROUP BY region, purchase_date""")
def _(t: Tables):
    return region_day_sales(t).join(targets(t), ["region", "ym"]).select(
        "region", F.col("day").cast("string").alias("day"), dbl("sales").alias("sales"),
        F.round(F.col("target") / F.dayofmonth(F.last_day("day")), 2).alias("day_target"))


@query("k16_verdict_by_month_region", """
SELECT ym, region, orders, on_time, CASE WHEN orders < 30 THEN 'not judged' WHEN on_time IS NULL THEN 'no value' WHEN on_time >= 0.9 THEN 'pass' ELSE 'fail' END AS on_time_verdict,
       CASE WHEN orders < 30 THEN 'not judged' WHEN attainment IS NULL THEN 'no value' WHEN attainment >= 0.9 THEN 'pass' ELSE 'fail' END AS target_verdict
FROM (SELECT ym, region, CAST(count(*) FILTER (status <> 'P') AS DOUBLE) AS orders, round(CAST(count(*) FILTER (on_time) AS DOUBLE) / nullif(count(delivered_date), 0), 6) AS on_time
      FROM x_vorders GROUP BY ALL)
LEFT JOIN (SELECT region, ym, round(m.sales / t.target, 4) AS attainment FROM x_msales m JOIN x_targets t USING (region, ym)) USING (region, ym)""")
def _(t: Tables):
    k = K.evaluate_wide(D.v_orders(t), ["orders", "on_time"], ["ym", "region"])
    a = region_day_sales(t).groupBy("region", "ym").agg(F.sum("sales").alias("s")).join(targets(t), ["region", "ym"]).select(
        "region", "ym", ratio("s", "target", 4).alias("attainment"))
    return k.join(a, ["region", "ym"], "left").select(
        "ym", "region", "orders", "on_time", G.verdict(F.col("on_time"), 0.9, F.col("orders")).alias("on_time_verdict"),
        G.verdict(F.col("attainment"), 0.9, F.col("orders")).alias("target_verdict"))


# ------------------------------------------------------------------ series
def daily_series(t: Tables, orders=None, reviews=None):
    """Six series, each dated the day its value is knowable: (series, region, day, num, den, n).

    One pass over the orders gives five of them: every order hands out one entry
    per series and the entries are summed before the shuffle. The whole company
    is added from the grouped rows, not from the orders. A load hands in its wide tables.
    """
    dec = lambda c: c.cast("decimal(20,2)")
    none, one = F.lit(None), F.lit(1)
    entry = lambda name, use, day, num, den: F.when(use, F.struct(
        F.lit(name).alias("series"), F.col(day).alias("day"), dec(num).alias("num"), dec(den).alias("den")))
    live, done = F.col("status") != "P", (F.col("status") == "F") & F.col("last_ship").isNotNull()
    shipped = live & F.col("first_ship").isNotNull()
    o = (orders if orders is not None else D.v_orders(t)).withColumn("deadline", F.date_sub("promised_date", 2))
    entries = F.array_compact(F.array(
        entry("orders", live, "purchase_date", one, none),
        entry("sales", live, "purchase_date", F.coalesce("items_value", F.lit(0)), none),
        entry("on_time", done, "promised_date", F.col("on_time").cast("int"), one),
        entry("pickups", shipped, "first_ship", one, none),
        entry("late_dispatch", shipped, "deadline", (F.col("first_ship") > F.col("deadline")).cast("int"), one)))
    from_orders = o.select("region", F.explode(entries).alias("e")).select("region", "e.*")
    r = reviews if reviews is not None else D.latest_reviews(t).join(o.select("order_id", "region"), "order_id")  # those of held orders go with them
    from_reviews = r.select("region", F.lit("negative_reviews").alias("series"), F.col("review_ts").cast("date").alias("day"),
                            dec((F.col("score") <= 2).cast("int")).alias("num"), dec(one).alias("den"))
    g = from_orders.unionByName(from_reviews).groupBy("series", "region", "day").agg(
        F.sum("num").alias("num"), F.sum("den").alias("den"), F.count("*").alias("n"))
    both = g.withColumn("region", F.explode(F.array(F.col("region"), F.lit("ALL"))))
    return both.groupBy("series", "region", "day").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("n").alias("n"))


def series(t: Tables):
    """The series at their grain; the small daily table is written once so the facts are read once."""
    return A.choose_grain(settle(daily_series(t)), FLOOR)


cte("x_sbase", """
SELECT 'orders' AS series, region, purchase_date AS day, 1::DECIMAL(20,2) AS num, NULL::DECIMAL(20,2) AS den FROM x_vorders WHERE status <> 'P'
UNION ALL SELECT 'sales', region, purchase_date, CAST(coalesce(items_value, 0) AS DECIMAL(20,2)), NULL FROM x_vorders WHERE status <> 'P'
UNION ALL SELECT 'on_time', region, promised_date, CAST(on_time AS INTEGER), 1 FROM x_vorders WHERE status = 'F' AND last_ship IS NOT NULL
UNION ALL SELECT 'negative_reviews', region, CAST(review_ts AS DATE), CAST(score <= 2 AS INTEGER), 1 FROM x_vreviews
UNION ALL SELECT 'pickups', region, first_ship, 1, NULL FROM x_vorders WHERE status <> 'P' AND first_ship IS NOT NULL
UNION ALL SELECT 'late_dispatch', region, promised_date - 2, CAST(first_ship > promised_date - 2 AS INTEGER), 1 FROM x_vorders WHERE status <> 'P' AND first_ship IS NOT NULL""")
cte("x_sdaily", """
SELECT series, region, day, sum(num) AS num, sum(den) AS den, count(*) AS n FROM x_sbase GROUP BY ALL
UNION ALL SELECT series, 'ALL', day, sum(num), sum(den), count(*) FROM x_sbase GROUP BY series, day""")
cte("x_span", """
SELECT series, region, min(day) AS a, max(day) AS b, CASE WHEN series IN ('sales', 'negative_reviews') OR sum(n)::DOUBLE / (max(day) - min(day) + 1) < 3.0 THEN 'weekly' ELSE 'daily' END AS grain
FROM x_sdaily GROUP BY series, region""")
cte("x_series", """
SELECT series, region, grain, d, CASE WHEN series IN ('orders', 'sales', 'pickups') THEN num ELSE num / den END AS value FROM (
 SELECT series, region, grain, CASE WHEN grain = 'weekly' THEN CAST(date_trunc('week', day) AS DATE) ELSE day END AS d, CAST(coalesce(sum(num), 0) AS DOUBLE) AS num, CAST(sum(den) AS DOUBLE) AS den
 FROM (SELECT series, region, day, num, den FROM x_sdaily UNION ALL
       SELECT series, region, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE), 0, NULL FROM x_span WHERE series IN ('orders', 'sales', 'pickups'))
 JOIN x_span USING (series, region) GROUP BY ALL)""")
cte("x_factor", """
SELECT *, value / factor AS adjusted FROM (SELECT *, CASE WHEN series IN ('orders', 'sales', 'pickups') AND grain = 'daily' AND k >= 4 AND raw > 0 THEN raw ELSE 1.0::DOUBLE END AS factor FROM (
 SELECT *, avg(value) OVER same / avg(value) OVER before AS raw, count(*) OVER same AS k FROM x_series
 WINDOW before AS (PARTITION BY series, region ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        same AS (PARTITION BY series, region, isodow(d) ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""")
cte("x_sev", """
SELECT *, (d <= DATE '1996-03-24' AND dl >= DATE '1996-03-11') OR (d <= DATE '1997-11-30' AND dl >= DATE '1997-11-17') AS planned,
 CASE WHEN d <= DATE '1998-06-14' AND dl >= DATE '1998-05-18' THEN 'carrier strike' END AS event,
 series IN ('orders', 'sales') AND ((d <= DATE '1996-03-24' AND dl >= DATE '1996-03-11') OR (d <= DATE '1997-11-30' AND dl >= DATE '1997-11-17')) AS suppressed,
 CASE WHEN d <= DATE '1996-03-24' AND dl >= DATE '1996-03-11' THEN 'spring sale' WHEN d <= DATE '1997-11-30' AND dl >= DATE '1997-11-17' THEN 'november sale'
      WHEN d <= DATE '1998-06-28' AND dl >= DATE '1998-05-18' THEN 'carrier strike' END AS near_event
FROM (SELECT *, CASE WHEN grain = 'weekly' THEN d + 6 ELSE d END AS dl, CASE WHEN grain = 'weekly' THEN 8 WHEN series = 'on_time' THEN 20 ELSE 28 END AS n FROM x_factor)""")
cte("x_base", """
SELECT series, region, d, count(*) AS n_base, median(v) AS med, mad(v) AS md FROM (
 SELECT a.series, a.region, a.d, a.n, b.adjusted AS v, row_number() OVER (PARTITION BY a.series, a.region, a.d ORDER BY b.d DESC) AS rn
 FROM x_sev a JOIN x_sev b ON a.series = b.series AND a.region = b.region AND b.d < a.d AND b.d >= a.d - 900 AND NOT b.planned AND (b.event IS NULL OR a.event IS NULL OR b.event <> a.event))
WHERE rn <= n GROUP BY series, region, d, n HAVING count(*) = n""")
cte("x_z", """
SELECT s.*, b.med, CASE WHEN b.md > 0 THEN round((s.adjusted - b.med) / (1.4826::DOUBLE * b.md), 6) END AS z
FROM x_sev s LEFT JOIN x_base b ON s.series = b.series AND s.region = b.region AND s.d = b.d""")
cte("x_judge", """
SELECT *, NOT tail AND coalesce(is_complete, true) AND NOT (grain = 'daily' AND strftime(d, '%m-%d') IN ('01-01', '05-01', '12-25')) AS judged FROM (
 SELECT z.*, c.is_complete, series IN ('orders', 'sales', 'pickups') AND coalesce(max(value / nullif(u.usual, 0)) OVER (PARTITION BY z.series, z.region ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 0.5, false) AS tail
 FROM x_z z JOIN (SELECT series, region, median(value) AS usual FROM x_series GROUP BY ALL) u USING (series, region)
 LEFT JOIN x_complete c ON c.ym = year(z.d) * 100 + month(z.d))""")
cte("x_flag", """
SELECT *, severity IN ('anomaly', 'critical') AND bad AND NOT suppressed AS flagged FROM (
 SELECT *, CASE WHEN z IS NULL OR NOT judged THEN 'none' WHEN abs(z) >= 6 THEN 'critical' WHEN abs(z) > 3.5 THEN 'anomaly' ELSE 'ok' END AS severity,
  coalesce(sign(z) = CASE WHEN series IN ('negative_reviews', 'late_dispatch') THEN 1 ELSE -1 END, false) AS bad FROM x_judge)""")
cte("x_epis", """
SELECT series, region, grain, episode, min(d) AS first_d, max(d) AS last_d, count(*) AS periods, min(due) AS sent, bool_or(severity = 'critical') AS is_critical, min(near_event) AS near_event,
 first(value ORDER BY abs(z) DESC, d DESC) AS value, first(med * factor ORDER BY abs(z) DESC, d DESC) AS expected, first(z ORDER BY abs(z) DESC, d DESC) AS z FROM (
 SELECT *, CASE WHEN severity = 'critical' OR row_number() OVER (PARTITION BY series, region, episode ORDER BY d) >= 2 THEN dl END AS due FROM (
  SELECT *, sum(CAST(flagged AND NOT was AS INTEGER)) OVER (PARTITION BY series, region ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM (
   SELECT *, coalesce(lag(flagged) OVER (PARTITION BY series, region ORDER BY d), false) AS was FROM x_flag)) WHERE flagged)
GROUP BY series, region, grain, episode""")
cte("x_alerts", "SELECT * FROM x_epis WHERE sent IS NOT NULL")


def judged(t: Tables):
    return settle(A.detect(settle(daily_series(t)), EVENTS, complete_months(t), HOLIDAYS, FLOOR))


@query("w09_knowable_series", "SELECT series, region, CAST(day AS VARCHAR) AS day, CAST(num AS DOUBLE) AS num, n FROM x_sdaily")
def _(t: Tables):
    return daily_series(t).select("series", "region", F.col("day").cast("string").alias("day"), dbl("num").alias("num"), "n")


@query("w08_weekly_when_low", "SELECT series, region, grain, count(*) AS periods, round(sum(value), 2) AS total FROM x_series GROUP BY ALL")
def _(t: Tables):
    return series(t).groupBy("series", "region", "grain").agg(
        F.count("*").alias("periods"), F.round(F.sum("value"), 2).alias("total"))


@query("w02_weekday_factor", "SELECT series, region, CAST(d AS VARCHAR) AS d, round(factor, 6) AS factor, round(adjusted, 6) AS adjusted FROM x_factor WHERE grain = 'daily'")
def _(t: Tables):
    return A.weekday_factor(series(t)).filter("grain = 'daily'").select(
        "series", "region", F.col("d").cast("string").alias("d"), F.round("factor", 6).alias("factor"), F.round("adjusted", 6).alias("adjusted"))


@query("w03_robust_z", "SELECT series, region, CAST(d AS VARCHAR) AS d, round(med, 6) AS median, z FROM x_z")
def _(t: Tables):
    s = A.with_events(A.weekday_factor(series(t)), EVENTS)
    return A.robust_z(s, EVENTS).select("series", "region", F.col("d").cast("string").alias("d"), F.round("median", 6).alias("median"), "z")


@query("w04_baseline_validity", "SELECT series, region, CAST(d AS VARCHAR) AS d, planned, coalesce(event, '') AS event, round(med, 6) AS median FROM x_z WHERE planned OR event IS NOT NULL")
def _(t: Tables):
    s = A.with_events(A.weekday_factor(series(t)), EVENTS)
    return A.robust_z(s, EVENTS).filter("planned OR event IS NOT NULL").select(
        "series", "region", F.col("d").cast("string").alias("d"), "planned", F.coalesce("event", F.lit("")).alias("event"), F.round("median", 6).alias("median"))


@query("j09_periods_in_events", "SELECT near_event AS event, series, count(*) AS periods, round(sum(value), 4) AS total FROM x_sev WHERE near_event IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    s = A.with_events(series(t), EVENTS)
    return s.filter("near_event IS NOT NULL").groupBy(F.col("near_event").alias("event"), "series").agg(
        F.count("*").alias("periods"), F.round(F.sum("value"), 4).alias("total"))


@query("w07_not_judged", "SELECT series, region, CAST(d AS VARCHAR) AS d, tail FROM x_judge WHERE NOT judged")
def _(t: Tables):
    return judged(t).filter(~F.col("judged")).select("series", "region", F.col("d").cast("string").alias("d"), "tail")


@query("w05_severity", "SELECT series, severity, bad, flagged, count(*) AS n FROM x_flag GROUP BY ALL")
def _(t: Tables):
    return judged(t).groupBy("series", "severity", "bad", "flagged").agg(F.count("*").alias("n"))


@query("w11_suppressed", "SELECT series, region, CAST(d AS VARCHAR) AS d, severity FROM x_flag WHERE suppressed")
def _(t: Tables):
    return judged(t).filter("suppressed").select("series", "region", F.col("d").cast("string").alias("d"), "severity")


ALERT_SQL = "SELECT series, region, grain, CAST(first_d AS VARCHAR) AS first_d, CAST(last_d AS VARCHAR) AS last_d, periods, is_critical, round(value, 4) AS value, round(expected, 4) AS expected, z, coalesce(near_event, '') AS near_event"


def alert_cols(df, *more):
    return df.select("series", "region", "grain", F.col("first_d").cast("string").alias("first_d"), F.col("last_d").cast("string").alias("last_d"), "periods", "is_critical",
                     F.round("value", 4).alias("value"), F.round("expected", 4).alias("expected"), "z", F.coalesce("near_event", F.lit("")).alias("near_event"), *more)


@query("w06_episodes", ALERT_SQL + " FROM x_epis")
def _(t: Tables):
    return alert_cols(A.episodes(judged(t)))


@query("s18_alert_log", ALERT_SQL + ", CAST(sent AS VARCHAR) AS sent FROM x_alerts")
def _(t: Tables):
    return alert_cols(A.alerts(judged(t)), F.col("sent").cast("string").alias("sent"))


@query("j11_alert_playbook", """
SELECT series, region, CAST(sent AS VARCHAR) AS sent, owner, step FROM x_alerts JOIN (VALUES ('orders', 'Commerce', 'check traffic and prices'), ('sales', 'Commerce', 'review the sales plan'),
 ('on_time', 'Logistics', 'warn customers of orders at risk'), ('pickups', 'Logistics', 'ask carriers whether pickups stopped'), ('late_dispatch', 'Sellers desk', 'contact the sellers behind'),
 ('negative_reviews', 'Service', 'read the comments of the week')) p(series, owner, step) USING (series)""")
def _(t: Tables):
    p = t.rows("series string, owner string, step string", PLAYBOOKS)
    return A.alerts(judged(t)).join(F.broadcast(p), "series").select("series", "region", F.col("sent").cast("string").alias("sent"), "owner", "step")


cte("x_users", """
SELECT * FROM (VALUES ('director', 'director', NULL), ('analyst', 'analyst', NULL), ('manager.asia', 'manager', 'ASIA'), ('manager.europe', 'manager', 'EUROPE'), ('seller.7', 'seller', NULL)) u(user_name, role, region)""")
cte("x_sentto", """
SELECT a.*, u.user_name FROM x_alerts a JOIN x_users u ON
 (a.region = 'ALL' AND u.role IN ('director', 'analyst')) OR (a.region <> 'ALL' AND u.role = 'manager' AND u.region = a.region)
 OR (a.region IN ('ASIA', 'EUROPE') AND a.is_critical AND u.role = 'director')
 OR (a.region NOT IN ('ALL', 'ASIA', 'EUROPE') AND u.role IN ('director', 'analyst'))""")


def sent_to(t: Tables):
    return A.recipients(A.alerts(judged(t)), t.rows("user_name string, role string, region string", USERS))


@query("j12_alert_recipients", "SELECT user_name, series, region, CAST(sent AS VARCHAR) AS sent FROM x_sentto")
def _(t: Tables):
    return sent_to(t).select("user_name", "series", "region", F.col("sent").cast("string").alias("sent"))


@query("p18_alert_text", """
SELECT series, region, CAST(sent AS VARCHAR) AS sent, series || CASE WHEN z < 0 THEN ' falls in ' ELSE ' rises in ' END || region || ': ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
  || ' hundredths (expected ' || CAST(CAST(round(expected * 100) AS BIGINT) AS VARCHAR) || ')' || coalesce('; event: ' || near_event, '') AS message FROM x_alerts""")
def _(t: Tables):
    whole = lambda c: F.round(F.col(c) * 100).cast("bigint").cast("string")
    return A.alerts(judged(t)).select("series", "region", F.col("sent").cast("string").alias("sent"), F.concat(
        "series", F.when(F.col("z") < 0, " falls in ").otherwise(" rises in "), "region", F.lit(": "), whole("value"), F.lit(" hundredths (expected "), whole("expected"), F.lit(")"),
        F.coalesce(F.concat(F.lit("; event: "), "near_event"), F.lit(""))).alias("message"))


def at_risk(t: Tables, as_of: str):
    """Orders open on the day and due within 7 days or overdue; no customer columns."""
    day = F.lit(as_of).cast("date")
    open_then = (F.col("status") != "P") & (F.col("purchase_date") <= day) & (F.col("last_ship").isNull() | (F.col("last_ship") > day))
    return D.v_orders(t).filter(open_then & (F.datediff("promised_date", day) <= 7)).select(
        "order_id", "region", "promised_date", F.when(F.col("promised_date") < day, "overdue").otherwise("due soon").alias("risk"))


@query("p11_orders_at_risk", """
SELECT order_id, region, CAST(promised_date AS VARCHAR) AS promised_date, CASE WHEN promised_date < DATE '1998-05-27' THEN 'overdue' ELSE 'due soon' END AS risk
FROM x_vorders WHERE status <> 'P' AND purchase_date <= DATE '1998-05-27' AND (last_ship IS NULL OR last_ship > DATE '1998-05-27') AND promised_date - DATE '1998-05-27' <= 7""")
def _(t: Tables):
    return at_risk(t, "1998-05-27").withColumn("promised_date", F.col("promised_date").cast("string"))


@query("s14_digest", """
SELECT s.user_name, CAST(s.sent AS VARCHAR) AS day, count(*) AS n_alerts, bool_or(is_critical) AS has_critical, string_agg(series || '@' || region, ', ' ORDER BY series || '@' || region) AS alerts,
       any_value(k.n) AS orders_at_risk
FROM x_sentto s JOIN (SELECT user_name, sent, count(*) AS n FROM (SELECT DISTINCT s.user_name, s.sent, v.order_id FROM x_sentto s JOIN x_vorders v ON (s.region = 'ALL' OR s.region = v.region)
   AND v.status <> 'P' AND v.purchase_date <= s.sent AND (v.last_ship IS NULL OR v.last_ship > s.sent) AND v.promised_date - s.sent <= 7) GROUP BY ALL) k ON k.user_name = s.user_name AND k.sent = s.sent
GROUP BY s.user_name, s.sent""")
def _(t: Tables):
    """One record per person and day. The alerts of a day are few (six series by region); the at-risk
    list itself can be long, so the record carries its size and the list is written beside it."""
    mail = settle(sent_to(t).select("user_name", "sent", "series", "region", "is_critical"))
    head = mail.groupBy("user_name", "sent").agg(
        F.count("*").alias("n_alerts"), F.bool_or("is_critical").alias("has_critical"),
        F.array_join(F.array_sort(F.collect_list(F.concat("series", F.lit("@"), "region"))), ", ").alias("alerts"))
    # An order is at risk from 7 days before its promise until it ships.
    spans = D.v_orders(t).filter("status <> 'P'").select(
        F.explode(F.array(F.col("region"), F.lit("ALL"))).alias("region"),
        F.greatest("purchase_date", F.date_sub("promised_date", 7)).alias("start"), F.col("last_ship").alias("stop"))
    # A person with a company-wide alert that day gets the company list, else the regions of the alerts.
    asked = mail.groupBy("user_name", "sent").agg(F.bool_or(F.col("region") == "ALL").alias("whole"), F.collect_set("region").alias("rs"))
    asked = asked.select("user_name", F.col("sent").alias("day"), F.explode(F.when(F.col("whole"), F.array(F.lit("ALL"))).otherwise(F.col("rs"))).alias("region"))
    covered = asked.join(A.covered_counts(spans, ["region"], asked), ["region", "day"]).withColumnRenamed("day", "sent")
    total = covered.groupBy("user_name", "sent").agg(F.sum("n").alias("orders_at_risk"))
    return head.join(total, ["user_name", "sent"]).select("user_name", F.col("sent").cast("string").alias("day"), "n_alerts", "has_critical", "alerts", "orders_at_risk")


@query("w10_leading_indicators", """
SELECT CAST(promised_date - 2 AS VARCHAR) AS day, count(*) AS due, count(*) FILTER (first_ship > promised_date - 2) AS late,
       round(CAST(count(*) FILTER (first_ship > promised_date - 2) AS DOUBLE) / count(*), 6) AS late_share, round(CAST(sum(first_ship - purchase_date) AS DOUBLE) / count(*), 6) AS mean_handover_days
FROM x_vorders WHERE status <> 'P' AND first_ship IS NOT NULL GROUP BY 1""")
def _(t: Tables):
    o = D.v_orders(t).filter("status <> 'P' AND first_ship IS NOT NULL").withColumn("deadline", F.date_sub("promised_date", 2))
    late = F.count_if(F.col("first_ship") > F.col("deadline"))
    return o.groupBy(F.col("deadline").cast("string").alias("day")).agg(
        F.count("*").alias("due"), late.alias("late"), ratio(late, F.count("*")).alias("late_share"),
        ratio(F.sum(F.datediff("first_ship", "purchase_date")), F.count("*")).alias("mean_handover_days"))


@query("w12_event_impact", """
SELECT event, series, periods, actual, expected, round((actual - expected) / nullif(expected, 0), 4) AS change FROM (
 SELECT e.name AS event, series, count(*) AS periods, round(sum(value), 4) AS actual, round(sum(med * factor), 4) AS expected
 FROM x_z z JOIN (VALUES ('spring sale', DATE '1996-03-11', DATE '1996-03-24'), ('november sale', DATE '1997-11-17', DATE '1997-11-30'), ('carrier strike', DATE '1998-05-18', DATE '1998-06-14')) e(name, a, b)
   ON z.d <= e.b AND z.dl >= e.a WHERE region = 'ALL' AND med IS NOT NULL GROUP BY ALL)""")
def _(t: Tables):
    return A.impact(judged(t), EVENTS)


@query("w12b_rating_during_event", """
SELECT CASE WHEN purchase_date BETWEEN DATE '1998-05-18' AND DATE '1998-06-14' THEN 'during' ELSE 'before' END AS phase, count(*) AS n, round(CAST(sum(score) AS DOUBLE) / count(*), 6) AS rating
FROM x_vreviews WHERE purchase_date BETWEEN DATE '1998-04-20' AND DATE '1998-06-14' GROUP BY 1""")
def _(t: Tables):
    e = EVENTS[2]
    r = D.v_reviews(t, ()).filter(F.col("purchase_date").between(F.lit(date(1998, 4, 20)), F.lit(e.end)))
    phase = F.when(F.col("purchase_date") >= F.lit(e.start), "during").otherwise("before")
    return r.groupBy(phase.alias("phase")).agg(F.count("*").alias("n"), ratio(F.sum("score"), F.count("*")).alias("rating"))


cte("x_deliveries", """
SELECT CASE WHEN grain = 'weekly' THEN CAST(date_trunc('week', day) AS DATE) ELSE day END AS d, CAST(sum(den) AS DOUBLE) AS den
FROM x_sdaily JOIN x_span USING (series, region) WHERE series = 'on_time' AND region = 'ALL' GROUP BY 1""")
cte("x_calendar", "SELECT * FROM (VALUES ('spring sale', DATE '1996-03-11', DATE '1996-03-24'), ('november sale', DATE '1997-11-17', DATE '1997-11-30'), ('carrier strike', DATE '1998-05-18', DATE '1998-06-14')) e(event, a, b)")
cte("x_rated", """
SELECT event, round(CAST(sum(score) FILTER (purchase_date < a) AS DOUBLE) / nullif(count(*) FILTER (purchase_date < a), 0), 6) AS rating_before,
 round(CAST(sum(score) FILTER (purchase_date >= a) AS DOUBLE) / nullif(count(*) FILTER (purchase_date >= a), 0), 6) AS rating_during
FROM x_calendar LEFT JOIN x_vreviews ON purchase_date BETWEEN a - CAST(b - a + 1 AS INTEGER) AND b GROUP BY event""")


@query("w12c_event_cost", """
SELECT e.event, count(z.d) AS periods, sum(den) AS deliveries, round(sum(den * (1 - value)), 4) AS actual_late, round(sum(den * (1 - z.med * factor)), 4) AS expected_late,
 round(sum(den * (1 - value)) - sum(den * (1 - z.med * factor)), 4) AS extra_late, round(sqrt(sum((den * 1.4826::DOUBLE * md) ** 2)), 4) AS spread, any_value(rating_before) AS rating_before, any_value(rating_during) AS rating_during
FROM x_calendar e JOIN x_rated USING (event) LEFT JOIN (SELECT z.*, y.den, q.md FROM x_z z JOIN x_deliveries y ON y.d = z.d JOIN x_base q ON q.series = z.series AND q.region = z.region AND q.d = z.d WHERE z.series = 'on_time' AND z.region = 'ALL' AND z.med IS NOT NULL) z
 ON z.d <= e.b AND z.dl >= e.a GROUP BY e.event""")
def _(t: Tables):
    return A.late_cost(judged(t), EVENTS).join(A.rating_change(D.v_reviews(t, ()), EVENTS), "event")


@query("w13_replay", "SELECT CAST(sent AS VARCHAR) AS sent, series, region, is_critical FROM x_alerts")
def _(t: Tables):
    return A.alerts(judged(t)).select(F.col("sent").cast("string").alias("sent"), "series", "region", "is_critical")


@query("w13b_lead_time", """
SELECT g.region, CAST(g.sent AS VARCHAR) AS lagging, CAST(min(l.sent) AS VARCHAR) AS leading, CAST(g.sent - min(l.sent) AS INTEGER) AS lead_days
FROM x_alerts g LEFT JOIN x_alerts l ON l.region = g.region AND l.series IN ('pickups', 'late_dispatch') AND l.sent BETWEEN g.sent - 28 AND g.sent
WHERE g.series = 'on_time' GROUP BY g.region, g.sent""")
def _(t: Tables):
    return A.lead_times(settle(A.alerts(judged(t))), ("pickups", "late_dispatch"), "on_time").select(
        "region", F.col("lagging").cast("string").alias("lagging"), F.col("leading").cast("string").alias("leading"), "lead_days")


@query("w14_alert_rate", """
SELECT s.series, s.region, s.months, coalesce(a.n, 0) AS alerts, round(CAST(coalesce(a.n, 0) AS DOUBLE) / s.months, 6) AS per_month FROM (
 SELECT series, region, count(DISTINCT year(d) * 100 + month(d)) AS months FROM x_flag WHERE z IS NOT NULL AND judged GROUP BY ALL) s
LEFT JOIN (SELECT series, region, count(*) AS n FROM x_alerts WHERE near_event IS NULL GROUP BY ALL) a USING (series, region)""")
def _(t: Tables):
    j = judged(t)
    months = j.filter("z IS NOT NULL AND judged").groupBy("series", "region").agg(F.count_distinct(D.ym("d")).alias("months"))
    n = A.alerts(j).filter("near_event IS NULL").groupBy("series", "region").agg(F.count("*").alias("n"))
    return months.join(n, ["series", "region"], "left").select(
        "series", "region", "months", F.coalesce("n", F.lit(0)).alias("alerts"), ratio(F.coalesce("n", F.lit(0)), "months").alias("per_month"))


# The oracle of the noise check is the same chain of relations over the shuffled series.
cte("x_seriesn", """
SELECT a.series, a.region, a.grain, a.d, b.value FROM (SELECT *, row_number() OVER (PARTITION BY series, region ORDER BY d) AS i FROM x_series) a
JOIN (SELECT *, row_number() OVER (PARTITION BY series, region ORDER BY md5(CAST(d AS VARCHAR))) AS i FROM x_series) b ON a.series = b.series AND a.region = b.region AND a.i = b.i""")
for _name in ("x_factor", "x_sev", "x_base", "x_z", "x_judge", "x_flag", "x_epis"):
    cte(_name + "n", re.sub(r"\b(x_series|x_factor|x_sev|x_base|x_z|x_judge|x_flag|x_epis)\b", r"\1n", CTES[_name]))


@query("w14b_alerts_on_noise", """
SELECT f.series, f.periods, f.marked, coalesce(e.alerts, 0) AS alerts FROM (SELECT series, count(*) FILTER (z IS NOT NULL) AS periods, count(*) FILTER (severity IN ('anomaly', 'critical')) AS marked FROM x_flagn GROUP BY series) f
LEFT JOIN (SELECT series, count(*) AS alerts FROM x_episn WHERE sent IS NOT NULL GROUP BY series) e USING (series)""")
def _(t: Tables):
    noise = settle(A.judge(settle(A.shuffled(series(t))), EVENTS, complete_months(t), HOLIDAYS))
    f = noise.groupBy("series").agg(F.count("z").alias("periods"), F.count_if(F.col("severity").isin("anomaly", "critical")).alias("marked"))
    e = A.alerts(noise).groupBy("series").agg(F.count("*").alias("alerts"))
    return f.join(e, "series", "left").select("series", "periods", "marked", F.coalesce("alerts", F.lit(0)).alias("alerts"))
