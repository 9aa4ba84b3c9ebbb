"""Security roll-ups and assistant queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.money import dbl
from ..operators import office as O
from ..sources import domain as D
from ..sources.tables import Tables
from .registry import cte, query

M = O.MINUTE
PASS = 15 * M


def changes(t: Tables):
    """File changes: the user is the machine, ten machines a tenant, props.k the file."""
    return D.readings(t).select((F.col("station") % 10).alias("tenant"), F.col("station").alias("machine"), F.col("k").alias("path"), "us", F.col("reading_id"), F.col("tag").alias("change"))


DECOYS = [(m, p) for m in range(10) for p in (7, 21, 42)]
cte("x_chg", "SELECT station % 10 AS tenant, station AS machine, k AS path, us, reading_id, tag AS change FROM x_readings")
cte("x_touch", "SELECT * FROM x_chg WHERE path IN (7, 21, 42) AND change <> 'view'")


def touches(t: Tables):
    d = t.rows("tenant long, path int", DECOYS)
    return changes(t).filter("change <> 'view'").join(F.broadcast(d), ["tenant", "path"], "left_semi")


@query("j24_decoy_alarm", "SELECT reading_id, machine, path FROM x_touch")
def _(t: Tables):
    return touches(t).select("reading_id", "machine", "path")


@query("z01_tenant_rollup", f"""
SELECT c.tenant, c.machine, c.pass_us, c.changes, coalesce(a.alarms, 0) AS alarms, c.latest FROM (SELECT tenant, machine, us // {PASS} * {PASS} AS pass_us, count(*) AS changes, first(change ORDER BY us DESC, reading_id DESC) AS latest FROM x_chg GROUP BY ALL) c
LEFT JOIN (SELECT machine, us // {PASS} * {PASS} AS pass_us, count(*) AS alarms FROM x_touch GROUP BY ALL) a ON a.machine = c.machine AND a.pass_us = c.pass_us""")
def _(t: Tables):
    d = t.rows("tenant long, path int, is_decoy boolean", [(*r, True) for r in DECOYS])
    c = changes(t).join(F.broadcast(d), ["tenant", "path"], "left").withColumn("ts", F.timestamp_micros("us"))
    alarm = F.coalesce("is_decoy", F.lit(False)) & (F.col("change") != "view")
    return c.groupBy("tenant", "machine", F.window("ts", "15 minutes").alias("w")).agg(
        F.count("*").alias("changes"), F.count_if(alarm).alias("alarms"), F.max_by("change", F.struct("us", "reading_id")).alias("latest")
    ).select("tenant", "machine", F.unix_micros("w.start").alias("pass_us"), "changes", "alarms", "latest")


# Passive page checks (ours) with their severity and weight.
CHECKS = [("plain http", "high", 10), ("inline script", "medium", 4), ("no language", "low", 1), ("form over plain http", "critical", 20)]
cte("x_pages", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, starts_with(url, 'http://') AS plain, contains(html, '<script') AS script, NOT regexp_matches(html, '<html[^>]*lang=') AS nolang, contains(html, '<form') AS form FROM pages")
cte("x_find", """
SELECT page_id, host, 'plain http' AS finding, 'high' AS severity, 10 AS weight FROM x_pages WHERE plain UNION ALL SELECT page_id, host, 'inline script', 'medium', 4 FROM x_pages WHERE script
UNION ALL SELECT page_id, host, 'no language', 'low', 1 FROM x_pages WHERE nolang UNION ALL SELECT page_id, host, 'form over plain http', 'critical', 20 FROM x_pages WHERE plain AND form""")


def findings(t: Tables):
    p = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.col("url").startswith("http://").alias("plain"),
                       F.col("html").contains("<script").alias("script"), (~F.col("html").rlike("<html[^>]*lang=")).alias("nolang"), F.col("html").contains("<form").alias("form"))
    hit = [F.col("plain"), F.col("script"), F.col("nolang"), F.col("plain") & F.col("form")]
    f = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(n).alias("finding"), F.lit(s).alias("severity"), F.lit(w).alias("weight"))) for h, (n, s, w) in zip(hit, CHECKS)]))
    return p.select("page_id", "host", F.explode(f).alias("f")).select("page_id", "host", "f.*")


RANK = {"critical": 1, "high": 2, "medium": 3, "low": 4}


@query("z02_severity_and_risk", "SELECT host, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, CAST(least(100, sum(weight)) AS BIGINT) AS risk FROM x_find GROUP BY host")
def _(t: Tables):
    return findings(t).groupBy("host").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in RANK], F.least(F.lit(100), F.sum("weight")).cast("bigint").alias("risk"))


@query("p15_scope_gate", "SELECT page_id, host FROM x_pages WHERE regexp_matches(host, '\\.example\\.(com|org)$')")
def _(t: Tables):
    hosts = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    scope = t.rows("zone string", [("example.com",), ("example.org",)])
    return hosts.withColumn("zone", F.substring_index("host", ".", -2)).join(F.broadcast(scope), "zone", "left_semi").select("page_id", "host")


@query("l03_ranked_findings", "SELECT page_id, finding, severity FROM x_find ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, page_id, finding")
def _(t: Tables):
    rank = F.lit(9)
    for s, r in RANK.items():
        rank = F.when(F.col("severity") == s, r).otherwise(rank)
    return findings(t).orderBy(rank, "page_id", "finding").select("page_id", "finding", "severity")


# ------------------------------------------------------------------ assistant
def meetings(t: Tables):
    return D.readings(t).filter("tag IN ('view', 'click')").select(
        F.col("reading_id").alias("meeting_id"), (F.col("station") % 10).alias("owner"), F.col("us").alias("start"), (F.col("us") + (F.col("k") + 5).cast("bigint") * M).alias("end"))


cte("x_meet", f"SELECT reading_id AS meeting_id, station % 10 AS owner, us AS start_us, us + (k + 5) * {M}::BIGINT AS end_us FROM x_readings WHERE tag IN ('view', 'click')")


@query("j22_calendar_conflicts", "SELECT a.meeting_id, count(b.meeting_id) AS overlaps FROM x_meet a LEFT JOIN x_meet b ON a.owner = b.owner AND a.meeting_id <> b.meeting_id AND a.start_us < b.end_us AND b.start_us < a.end_us GROUP BY a.meeting_id")
def _(t: Tables):
    return O.conflicts(meetings(t)).select("meeting_id", "overlaps")


@query("w31_free_slots", f"""
SELECT owner, busy_until AS free_from, nxt AS free_to FROM (SELECT owner, max(end_us) OVER (PARTITION BY owner ORDER BY start_us, meeting_id ROWS UNBOUNDED PRECEDING) AS busy_until, lead(start_us) OVER (PARTITION BY owner ORDER BY start_us, meeting_id) AS nxt FROM x_meet)
WHERE nxt - busy_until >= {30 * M} AND busy_until // {1440 * M} = nxt // {1440 * M}""")
def _(t: Tables):
    return O.free_slots(meetings(t), 30 * M)


@query("w31b_focus_block", f"SELECT owner, count(*) AS encroaching FROM x_meet WHERE start_us < start_us // {1440 * M} * {1440 * M} + {11 * 60 * M} AND end_us > start_us // {1440 * M} * {1440 * M} + {9 * 60 * M} GROUP BY owner")
def _(t: Tables):
    return meetings(t).filter(O.encroaches(F.col("start"), F.col("end"), 9 * 60, 11 * 60)).groupBy("owner").agg(F.count("*").alias("encroaching"))


cte("x_last", "SELECT conv_id, turn, role, text, n_turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations) WHERE rn = 1")
cte("x_tri", f"SELECT *, CASE WHEN regexp_matches(lower(text), '{O.URGENT}') THEN 'urgent' WHEN regexp_matches(lower(text), '{O.SCHEDULE}') THEN 'schedule' WHEN contains(text, '?') OR role = 'user' THEN 'needs reply' ELSE 'fyi' END AS class FROM x_last")


def triaged(t: Tables):
    return O.last_turns(t.conversations).withColumn("class", O.triage(F.col("text"), F.col("role")))


@query("p23_message_triage", "SELECT conv_id, class, n_turns FROM x_tri")
def _(t: Tables):
    return triaged(t).select("conv_id", "class", "n_turns")


@query("w32_follow_ups", "SELECT conv_id, CAST(age AS BIGINT) AS age, CASE WHEN age > 3 THEN 'overdue' WHEN age >= 2 THEN 'due soon' ELSE 'ok' END AS state FROM (SELECT conv_id, conv_id % 9 AS age FROM x_last WHERE role = 'user')")
def _(t: Tables):
    f = O.last_turns(t.conversations).filter("role = 'user'").select("conv_id", (F.col("conv_id") % 9).alias("age"))
    return f.withColumn("state", F.when(F.col("age") > 3, "overdue").when(F.col("age") >= 2, "due soon").otherwise("ok"))


MINUTES = {"urgent": 15, "schedule": 10, "needs reply": 8, "fyi": 2}


@query("e03_time_saved", "SELECT class, count(*) AS drafts, CAST(count(*) * CASE class WHEN 'urgent' THEN 15 WHEN 'schedule' THEN 10 WHEN 'needs reply' THEN 8 ELSE 2 END AS BIGINT) AS minutes FROM x_tri GROUP BY class")
def _(t: Tables):
    m = t.rows("class string, each int", list(MINUTES.items()))
    return triaged(t).groupBy("class").agg(F.count("*").alias("drafts")).join(F.broadcast(m), "class").select("class", "drafts", (F.col("drafts") * F.col("each")).alias("minutes"))


@query("e01_daily_brief", f"""
SELECT a.owner, a.day, a.meetings, a.first_start, coalesce(p.priorities, '') AS priorities, coalesce(o.overdue, 0) AS overdue FROM
 (SELECT owner, start_us // {1440 * M} AS day, count(*) AS meetings, min(start_us) AS first_start FROM x_meet GROUP BY ALL) a
LEFT JOIN (SELECT owner, day, string_agg(CAST(reading_id AS VARCHAR), ',' ORDER BY rn) AS priorities FROM (SELECT reading_id, station % 10 AS owner, us // {1440 * M} AS day, row_number() OVER (PARTITION BY station % 10, us // {1440 * M} ORDER BY centi DESC, reading_id) AS rn FROM x_readings WHERE tag = 'purchase') WHERE rn <= 3 GROUP BY ALL) p USING (owner, day)
LEFT JOIN (SELECT conv_id % 10 AS owner, count(*) AS overdue FROM x_last WHERE role = 'user' AND conv_id % 9 > 3 GROUP BY 1) o USING (owner)""")
def _(t: Tables):
    day = 1440 * M
    at = lambda c: F.floor(F.col(c) / day).cast("bigint")
    m = meetings(t).groupBy("owner", at("start").alias("day")).agg(F.count("*").alias("meetings"), F.min("start").alias("first_start"))
    task = D.readings(t).filter("tag = 'purchase'").select((F.col("station") % 10).alias("owner"), at("us").alias("day"), "reading_id", "centi")
    top = task.withColumn("rn", F.row_number().over(Window.partitionBy("owner", "day").orderBy(F.desc("centi"), "reading_id"))).filter("rn <= 3")
    # Three at most per owner and day, so the collected list is bounded.
    p = top.groupBy("owner", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "reading_id"))), lambda x: x["reading_id"].cast("string")), ",").alias("priorities"))
    o = O.last_turns(t.conversations).filter("role = 'user' AND conv_id % 9 > 3").groupBy((F.col("conv_id") % 10).alias("owner")).agg(F.count("*").alias("overdue"))
    return m.join(p, ["owner", "day"], "left").join(o, "owner", "left").select("owner", "day", "meetings", "first_start", F.coalesce("priorities", F.lit("")).alias("priorities"), F.coalesce("overdue", F.lit(0)).alias("overdue"))


CATEGORY = "CASE WHEN p_name LIKE '%gear%' OR p_name LIKE '%bolt%' THEN 'supplies' WHEN p_name LIKE '%ring%' THEN 'gifts' WHEN p_name LIKE '%widget%' THEN 'software' ELSE 'other' END"


@query("p24_expense_category", f"SELECT p_partkey AS product_id, {CATEGORY} AS category FROM part")
def _(t: Tables):
    return t.part.select(F.col("p_partkey").alias("product_id"), F.expr(CATEGORY).alias("category"))


@query("e02_expense_report", f"SELECT coalesce(cat, 'TOTAL') AS category, count(*) AS n, CAST(sum(price) AS DOUBLE) AS amount FROM x_lines JOIN (SELECT p_partkey AS product_id, {CATEGORY} AS cat FROM part) USING (product_id) GROUP BY ROLLUP (cat)")
def _(t: Tables):
    c = t.part.select(F.col("p_partkey").alias("product_id"), F.expr(CATEGORY).alias("category"))
    return D.lines(t).join(c, "product_id").rollup("category").agg(F.count("*").alias("n"), dbl(F.sum("price")).alias("amount")).withColumn("category", F.coalesce("category", F.lit("TOTAL")))


@query("l05_lowest_fare", "SELECT product_id AS trip, first(seller_id ORDER BY price, seller_id, order_id) AS option, CAST(min(price) AS DOUBLE) AS fare FROM x_lines GROUP BY product_id")
def _(t: Tables):
    return D.lines(t).groupBy(F.col("product_id").alias("trip")).agg(F.min_by("seller_id", F.struct("price", "seller_id", "order_id")).alias("option"), dbl(F.min("price")).alias("fare"))


ZONES = ["America/New_York", "America/Toronto", "America/Mexico_City"]


@query("p19_time_zones", "SELECT event_id, " + ", ".join(f"strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE '{z}', '%Y-%m-%d %H:%M') AS {z.split('/')[1].lower()}" for z in ZONES) + " FROM events")
def _(t: Tables):
    local = lambda z: F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(z), "ts"), "yyyy-MM-dd HH:mm").alias(z.split("/")[1].lower())
    return t.events.select("event_id", *[local(z) for z in ZONES])
