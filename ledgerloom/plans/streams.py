"""Streaming queries: the tables are read as streams, drained, and the written result is returned.

Windows still open behind the watermark are not emitted, so the oracles leave them out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sensors as N
from ..sources import domain as D
from ..sources.tables import SCHEMAS, Tables
from ..streaming import jobs as J, keyed as S
from . import fraud, hub, office, sensors
from .registry import cte, query

H = N.HOUR


class StreamTables(Tables):
    """The same tables as streams, so that the domain functions serve both."""

    def __getattr__(self, name: str):
        if name not in SCHEMAS:
            raise AttributeError(name)
        return J.source(self.spark, self.folder, name, SCHEMAS[name])


def live(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


@query("t06_hourly_samples", f"SELECT * FROM (SELECT tag, us // {H} * {H} AS slot, count(*) AS n, CAST(sum(centi) AS BIGINT) AS centi FROM x_readings GROUP BY 1, 2) WHERE slot + {H} <= (SELECT max(us) FROM x_readings) - {3 * H}")
def _(t: Tables):
    return J.drain(J.samples(D.readings(live(t)), "1 hour", "3 hours"), J.work_folder(t.spark, "samples"))


@query("t04_reordered_windows", f"SELECT * FROM (SELECT tag, us // {24 * H} * {24 * H} AS slot, count(*) AS n, CAST(sum(centi) AS BIGINT) AS centi FROM x_readings GROUP BY 1, 2) WHERE slot + {24 * H} <= (SELECT max(us) FROM x_readings) - {3 * H}")
def _(t: Tables):
    return J.drain(J.samples(D.readings(live(t)), "24 hours", "3 hours"), J.work_folder(t.spark, "reorder"))


@query("t13_decoy_passes", f"SELECT * FROM (SELECT machine, us // {office.PASS} * {office.PASS} AS pass_us, count(*) AS alarms FROM x_touch GROUP BY 1, 2) WHERE pass_us + {office.PASS} <= (SELECT max(us) FROM x_touch) - {H}")
def _(t: Tables):
    d = t.rows("tenant long, path int", office.DECOYS)
    r = D.readings(live(t)).select((F.col("station") % 10).alias("tenant"), F.col("station").alias("machine"), F.col("k").alias("path"), "ts", "tag")
    return J.drain(J.decoy_passes(r.filter("tag <> 'view'").join(F.broadcast(d), ["tenant", "path"], "left_semi"), "1 hour"), J.work_folder(t.spark, "decoys"))


@query("t03_idempotent_stream", "SELECT event_id, CAST(round(value * 100) AS BIGINT) AS centi FROM events")
def _(t: Tables):
    e = live(t).events.select("event_id", "ts", "value")
    both = e.unionByName(live(t).events.select("event_id", "ts", "value").filter("event_id % 10 = 3"))
    once = J.apply_once(both, "event_id", "1 day").select("event_id", F.round(F.col("value") * 100).cast("bigint").alias("centi"))
    return J.drain(once, J.work_folder(t.spark, "once"))


@query("t03c_duplicate_log", "SELECT event_id, CAST(1 AS BIGINT) AS duplicates FROM events WHERE event_id % 10 = 3")
def _(t: Tables):
    e = live(t).events.select("event_id", "value").withColumn("attempt", F.lit(1))
    both = e.unionByName(live(t).events.select("event_id", "value").filter("event_id % 10 = 3").withColumn("attempt", F.lit(2)))
    return J.apply_with_log(both, "event_id", ["attempt"], J.work_folder(t.spark, "log"))[1]


cte("x_fed", f"""
SELECT *, us + CASE WHEN reading_id % 10 = 7 THEN (1 + reading_id % 6) * {H} ELSE 0 END AS arrival FROM x_readings""")
cte("x_late", f"""
SELECT tag, reading_id, us, coalesce(mark, us) AS mark_us, CASE WHEN us < mark - {3 * H} THEN 'late' END AS reason FROM (
 SELECT *, max(us) OVER (PARTITION BY tag ORDER BY arrival, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM x_fed)""")


def scrambled(t: Tables):
    """The readings as they arrive: one in ten is one to six hours behind; five batches."""
    late = F.when(F.col("reading_id") % 10 == 7, (1 + F.col("reading_id") % 6) * H).otherwise(0)
    r = D.readings(t).select("reading_id", "tag", "us").withColumn("arrival", F.col("us") + late)
    return J.feed(r, "arrival", 5, J.work_folder(t.spark, "feed"))


def late_rows(t: Tables):
    return S.drain_keyed(S.lateness(scrambled(t), 3 * H), J.work_folder(t.spark, "late"))


@query("t05_late_readings", "SELECT tag, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason = 'late') AS late FROM x_late GROUP BY tag")
def _(t: Tables):
    return late_rows(t).groupBy("tag").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason") == "late").alias("late"))


@query("t05b_late_rows", "SELECT * FROM x_late WHERE reason IS NOT NULL")
def _(t: Tables):
    return late_rows(t).filter("reason IS NOT NULL")


@query("t07_silent_sources_stream", f"""
SELECT source, last_us, last_us + {12 * H} AS down_us FROM (
 SELECT station AS source, us AS last_us, lead(us) OVER (PARTITION BY station ORDER BY us, reading_id) AS after, (SELECT max(us) FROM x_readings) AS newest FROM x_readings)
WHERE after - last_us > {12 * H} OR (after IS NULL AND last_us + {12 * H} <= newest - {H})""")
def _(t: Tables):
    r = D.readings(t).select(F.col("station").cast("int").alias("source"), "ts", "us")
    fed = J.feed(r, "us", 4, J.work_folder(t.spark, "feed")).select("source", "ts")
    return S.drain_keyed(S.silences(fed, 12 * H, "1 hour"), J.work_folder(t.spark, "silence")).select("source", "last_us", "down_us")


@query("t08_cusum_stream", f"""
SELECT CAST(line AS INTEGER) AS line, slot, CAST(p - least(0, min(p) OVER (PARTITION BY line ORDER BY slot ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS s FROM (
 SELECT line, slot, sum(inflow - outflow - 1000) OVER (PARTITION BY line ORDER BY slot ROWS UNBOUNDED PRECEDING) AS p FROM x_hours WHERE slot + {H} <= (SELECT max(us) FROM x_readings) - {3 * H})""")
def _(t: Tables):
    fed = J.feed(D.readings(t).select("us", "ts", "k", "tag", "centi"), "us", 4, J.work_folder(t.spark, "feed"))
    r = J.as_event_time(fed.withColumn("line", (F.col("k") % 4).cast("int")), "3 hours")
    flow = lambda tag: F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("centi"))), F.lit(0))
    slots = r.groupBy(F.window("ts", "1 hour").alias("w"), "line").agg((flow("purchase") - flow("view")).cast("bigint").alias("d")).select("line", F.unix_micros("w.start").alias("slot"), "d")
    return S.drain_keyed(S.cusum(slots, 1000), J.work_folder(t.spark, "cusum"))


@query("t09_operation_complaint_stream", """
SELECT p.event_id AS op_id, coalesce(c.event_id, -1) AS other_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON c.event_id - 1 - c.event_id % 3 = p.event_id AND c.ts >= p.ts AND c.ts <= p.ts + INTERVAL 6 HOURS
WHERE c.event_id IS NOT NULL OR p.ts + INTERVAL 6 HOURS < (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type IN ('purchase', 'click'))""")
def _(t: Tables):
    ops = live(t).events.filter("event_type = 'purchase'").select(F.col("event_id").alias("op_id"), "ts")
    later = live(t).events.filter("event_type = 'click'").select((F.col("event_id") - 1 - F.col("event_id") % 3).alias("about"), "ts", F.col("event_id").alias("other_id"))
    out = J.drain(J.later_match(ops, later, "6 HOURS", "1 hour"), J.work_folder(t.spark, "match"))
    # An operation without a complaint comes out once the watermark has passed the time a complaint may take.
    return out.select("op_id", F.coalesce("other_id", F.lit(-1)).alias("other_id"))


#: Operations as the fraud rules read them.
OPS = ("op_id bigint, customer bigint, ts timestamp_ntz, us bigint, shop int, city int, device int, beneficiary int, category int, ip_country string, "
       "card_present boolean, channel string, amount bigint, is_fraud boolean, is_complaint boolean")


@query("t10_stream_scoring", "SELECT op_id, score, reasons FROM x_score")
def _(t: Tables):
    fed = J.feed(D.operations(t), "us", 5, J.work_folder(t.spark, "feed"))
    return S.newest(S.drain_keyed(S.score(fed, fraud.balances(t), fraud.P, ahead=True), J.work_folder(t.spark, "score")))


@query("t11_sync_stream", "SELECT order_id, CASE WHEN order_id % 5 = 0 THEN 'F' ELSE status END AS status, CAST(CASE WHEN order_id % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM x_orders")
def _(t: Tables):
    a = D.orders(live(t)).select("order_id", "status", F.lit(1).alias("version"))
    b = D.orders(live(t)).filter("order_id % 5 = 0").select("order_id", F.lit("F").alias("status"), F.lit(2).alias("version"))
    return J.sync(a.unionByName(b).unionByName(D.orders(live(t)).filter("order_id % 5 = 0").select("order_id", F.lit("F").alias("status"), F.lit(2).alias("version"))),
                  "order_id", "version", J.work_folder(t.spark, "sync"))


@query("t12_dead_letter_stream", "SELECT CASE WHEN CAST(substring(brand, 7) AS INTEGER) <= 20 THEN 'applied' ELSE 'dead' END AS state, count(*) AS n FROM x_lines JOIN x_products USING (product_id) GROUP BY 1")
def _(t: Tables):
    rows = D.lines(live(t)).select("order_id", "line_seq", "product_id").join(D.products(t).select("product_id", "brand"), "product_id")
    ok, dead = J.route(rows, F.broadcast(t.rows("brand string, gl string", hub.GL)), "brand", J.work_folder(t.spark, "route"))
    n = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "n")
    return n(ok, "applied").unionByName(n(dead, "dead"))


@query("s08b_payload_stream", "SELECT tag, count(*) AS n, CAST(sum(centi) AS BIGINT) AS centi FROM x_readings GROUP BY tag")
def _(t: Tables):
    from ..sources.readings import from_payloads
    r = D.readings(live(t))
    body = F.when(F.col("reading_id") % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.col("tag").alias("etiqueta"), (F.col("us") / 1e6).alias("ts"), F.col("value").alias("valor"))).alias("lecturas")))) \
        .otherwise(F.to_json(F.struct((F.col("us") / 1e6).alias("ts"), F.create_map("tag", "value").alias("presiones"))))
    flat = J.drain(from_payloads(r.select(body.alias("body"))), J.work_folder(t.spark, "payload"))
    return flat.groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("centi"))
