"""Fraud queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import great_circle_km
from ..functions.money import cents, dbl
from ..operators import fraud as R
from ..sources import domain as D
from ..sources.tables import Tables
from .registry import cte, query

# The fixture is sparse (an operation per customer every ten hours), so the speed is scaled.
P = R.Params(speed_kmh=60.0)
CONFIRMED = "is_fraud"
DAY, HOUR = R.DAY, R.HOUR


def balances(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("customer"), cents("c_acctbal").alias("balance"))


def complaints(t: Tables):
    return D.operations(t).filter("is_complaint").select(
        F.col("op_id").alias("complaint_id"), "customer", F.col("ts").cast("date").alias("filed"), F.floor(F.col("op_id") / 2).cast("bigint").alias("about"))


cte("x_pos", """
SELECT *, lag(us) OVER w AS b_us, lag(city) OVER w AS b_city, lead(us) OVER w AS a_us, lead(city) OVER w AS a_city FROM x_ops WHERE card_present WINDOW w AS (PARTITION BY customer ORDER BY us, op_id)""")


def _km(c1: str, c2: str) -> str:
    return f"""2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians((15.0::DOUBLE + {c2} * 1.5::DOUBLE) - (15.0::DOUBLE + {c1} * 1.5::DOUBLE)) / 2), 2)
 + cos(radians(15.0::DOUBLE + {c1} * 1.5::DOUBLE)) * cos(radians(15.0::DOUBLE + {c2} * 1.5::DOUBLE)) * pow(sin(radians((-115.0::DOUBLE + {c2} * 2.3::DOUBLE) - (-115.0::DOUBLE + {c1} * 2.3::DOUBLE)) / 2), 2))))"""


cte("x_imp", f"""
SELECT op_id, coalesce({_km('city', 'b_city')} > abs(us - b_us)::DOUBLE / {HOUR} * 60, false) OR coalesce({_km('city', 'a_city')} > abs(us - a_us)::DOUBLE / {HOUR} * 60, false) AS impossible FROM x_pos""")
cte("x_feat", f"""
SELECT o.*, coalesce(i.impossible, false) AS impossible, row_number() OVER w - 1 AS n_before,
 coalesce(sum(CAST(hour(ts) BETWEEN 0 AND 5 AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nights_before,
 coalesce(sum(CAST(ip_country <> 'MX' AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS foreign_before,
 coalesce(sum(CAST(channel = 'online' AND amount <= 500 AS INTEGER)) OVER (PARTITION BY customer ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND 1 PRECEDING), 0) AS small_24h,
 coalesce(sum(amount) OVER (PARTITION BY customer ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW), 0) AS spend_24h,
 coalesce(sum(amount) OVER (PARTITION BY customer ORDER BY us RANGE BETWEEN {30 * DAY} PRECEDING AND 1 PRECEDING), 0) AS spend_30d,
 row_number() OVER (PARTITION BY customer, city ORDER BY us, op_id) = 1 AS new_city, row_number() OVER (PARTITION BY customer, device ORDER BY us, op_id) = 1 AS new_device,
 row_number() OVER (PARTITION BY customer, beneficiary ORDER BY us, op_id) = 1 AS new_beneficiary, b.balance
FROM x_ops o LEFT JOIN x_imp i USING (op_id) LEFT JOIN (SELECT c_custkey AS customer, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer) b USING (customer)
WINDOW w AS (PARTITION BY customer ORDER BY us, op_id)""")
FIRED = {
    "impossible travel": "impossible", "card testing": "small_24h >= 2 AND channel = 'online' AND amount >= 10000",
    "new city": "n_before > 0 AND card_present AND new_city", "new device": "n_before > 0 AND channel <> 'pos' AND new_device",
    "new beneficiary": "n_before > 0 AND channel = 'transfer' AND new_beneficiary", "night": "hour(ts) BETWEEN 0 AND 5 AND nights_before * 4 < n_before",
    "risky category": "category = 3", "foreign ip": "ip_country <> 'MX' AND foreign_before * 4 < n_before",
    "high for the month": "spend_30d > 0 AND amount > spend_30d * 0.5", "drains the balance": "coalesce(amount > balance * 0.8, false)"}
cte("x_score", "SELECT *, CAST(least(100, " + " + ".join(f"CASE WHEN {c} THEN {R.WEIGHTS[n]} ELSE 0 END" for n, c in FIRED.items()) + ") AS INTEGER) AS score, concat_ws('; ', "
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in FIRED.items()) + ") AS reasons FROM x_feat")


def scored(t: Tables):
    return R.score(R.features(D.operations(t), balances(t), P), P)


@query("p20_distance_between_operations", f"SELECT op_id, round({_km('b_city', 'city')}, 4) AS km FROM x_pos WHERE b_city IS NOT NULL")
def _(t: Tables):
    from ..operators.ordered import OrderedScan
    o = OrderedScan(D.operations(t).filter("card_present"), ["customer"], ["us", "op_id"]).prev({"b": "city"}).result().filter("b IS NOT NULL")
    return o.select("op_id", F.round(great_circle_km(*R.place(F.col("b")), *R.place(F.col("city"))), 4).alias("km"))


@query("j19_impossible_travel", "SELECT op_id, customer FROM x_ops JOIN x_imp USING (op_id) WHERE impossible")
def _(t: Tables):
    return R.travel(D.operations(t), P).filter("impossible").select("op_id", "customer")


@query("w15_card_testing", "SELECT op_id, CAST(small_24h AS BIGINT) AS small_24h FROM x_feat WHERE small_24h >= 2 AND channel = 'online' AND amount >= 10000")
def _(t: Tables):
    return R.spending(D.operations(t), P).filter(R.rules(P)["card testing"]).select("op_id", "small_24h")


@query("w16_first_seen", "SELECT op_id, new_city, new_device, new_beneficiary FROM x_feat")
def _(t: Tables):
    o = D.operations(t)
    for c, n in (("city", "new_city"), ("device", "new_device"), ("beneficiary", "new_beneficiary")):
        o = R.first_seen(o, c, n)
    return o.select("op_id", "new_city", "new_device", "new_beneficiary")


@query("w17_own_history_flags", "SELECT op_id, n_before, CAST(nights_before AS BIGINT) AS nights_before, CAST(foreign_before AS BIGINT) AS foreign_before FROM x_feat")
def _(t: Tables):
    return R.travel(D.operations(t), P).select("op_id", "n_before", "nights_before", "foreign_before")


@query("w18_spend_share_24h", "SELECT op_id, round(CAST(spend_24h AS DOUBLE) / nullif(spend_30d, 0), 6) AS share FROM x_feat")
def _(t: Tables):
    return R.spending(D.operations(t), P).select("op_id", F.round(dbl("spend_24h") / F.when(F.col("spend_30d") != 0, dbl("spend_30d")), 6).alias("share"))


@query("f05_amount_in_context", "SELECT op_id, CAST(amount AS BIGINT) AS amount, spend_30d > 0 AND amount > spend_30d * 0.5 AS high_for_month, coalesce(amount > balance * 0.8, false) AS drains_balance FROM x_feat")
def _(t: Tables):
    f = R.spending(D.operations(t), P).join(balances(t), "customer", "left")
    fired = R.rules(P)
    return f.select("op_id", "amount", fired["high for the month"].alias("high_for_month"), fired["drains the balance"].alias("drains_balance"))


@query("f01_explained_score", "SELECT op_id, score, reasons FROM x_score")
def _(t: Tables):
    return scored(t).select("op_id", "score", F.concat_ws("; ", "reasons").alias("reasons"))


@query("f02_threshold_report", """
SELECT cut, CAST(sum(hit) AS BIGINT) AS flagged, round(CAST(sum(hit * f) AS DOUBLE) / nullif(sum(hit), 0), 6) AS precision, round(CAST(sum(hit * f) AS DOUBLE) / sum(f), 6) AS recall,
 round(CAST(sum(hit * f * amount) AS DOUBLE) / sum(f * amount), 6) AS recall_amount, round(CAST(sum(hit) AS DOUBLE) / count(*), 6) AS share_flagged
FROM (SELECT cut, CAST(score >= cut AS INTEGER) AS hit, CAST(is_fraud AS INTEGER) AS f, amount FROM x_score, (VALUES (30), (60)) c(cut)) GROUP BY cut""")
def _(t: Tables):
    return R.threshold_report(scored(t), [P.review, P.block])


cte("x_uses", f"""
SELECT *, coalesce(nxt - us <= {30 * DAY}, false) AS before_fraud FROM (SELECT *, min(CASE WHEN is_fraud THEN us END) OVER (PARTITION BY customer ORDER BY us, op_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM x_ops)""")
cte("x_shops", """
SELECT shop, customers, victims, round(CAST(victims * a AS DOUBLE) / (customers * nullif(v, 0)), 6) AS times_base, coalesce(CAST(victims * a AS DOUBLE) / (customers * nullif(v, 0)) >= 1.3 AND victims >= 10, false) AS compromised FROM (
 SELECT shop, count(*) AS customers, count(*) FILTER (v) AS victims FROM (SELECT shop, customer, bool_or(before_fraud) AS v FROM x_uses GROUP BY ALL) GROUP BY shop),
 (SELECT count(*) AS a, count(*) FILTER (v) AS v FROM (SELECT customer, bool_or(before_fraud) AS v FROM x_uses GROUP BY customer))""")


def shops(t: Tables):
    return R.compromise(R.exposed_use(D.operations(t), F.expr(CONFIRMED), P), 1.3, 10)


@query("j16_use_before_fraud", "SELECT op_id, shop, customer FROM x_uses WHERE before_fraud")
def _(t: Tables):
    return R.exposed_use(D.operations(t), F.expr(CONFIRMED), P).filter("before_fraud").select("op_id", "shop", "customer")


@query("f03_compromise_ratio", "SELECT shop, customers, victims, times_base, compromised FROM x_shops")
def _(t: Tables):
    return shops(t)


cte("x_risky", "SELECT shop FROM x_shops WHERE compromised")
cte("x_compl", "SELECT op_id AS complaint_id, customer, CAST(ts AS DATE) AS filed, op_id // 2 AS about FROM x_ops WHERE is_complaint")


def risky(t: Tables):
    return shops(t).filter("compromised").select("shop")


def exposed(t: Tables):
    return D.operations(t).join(risky(t), "shop", "left_semi").select("customer").distinct()


@query("j17_exposed_not_complained", "SELECT DISTINCT customer FROM x_ops WHERE shop IN (SELECT shop FROM x_risky) AND customer NOT IN (SELECT customer FROM x_compl)")
def _(t: Tables):
    return exposed(t).join(complaints(t).select("customer"), "customer", "left_anti")


@query("u03_exposed_minus_complained", "SELECT DISTINCT customer FROM x_ops WHERE shop IN (SELECT shop FROM x_risky) EXCEPT SELECT customer FROM x_compl")
def _(t: Tables):
    return exposed(t).exceptAll(complaints(t).select("customer").distinct())


@query("j18_complaint_score", "SELECT complaint_id, about, coalesce(score, -1) AS score FROM x_compl LEFT JOIN x_score ON about = op_id")
def _(t: Tables):
    s = scored(t).select(F.col("op_id").alias("about"), "score")
    return complaints(t).join(s, "about", "left").select("complaint_id", "about", F.coalesce("score", F.lit(-1)).alias("score"))


@query("f04_complaint_triage", """
SELECT complaint_id, CASE WHEN score >= 60 OR coalesce(compromised, false) THEN 'refund now' WHEN score >= 30 OR score IS NULL THEN 'investigate' ELSE 'possible friendly fraud' END AS decision, CAST(filed + 45 AS VARCHAR) AS deadline
FROM x_compl LEFT JOIN x_score ON about = op_id LEFT JOIN x_shops USING (shop)""")
def _(t: Tables):
    return R.triage(complaints(t), scored(t), shops(t), P).select("complaint_id", "decision", F.col("deadline").cast("string").alias("deadline"))
