"""Sensor queries. Durations are scaled to the fixture: a second of the method is an hour here."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import nearest
from ..functions.money import dbl, ratio
from ..operators import sensors as N
from ..operators.ordered import OrderedScan
from ..session import literals, settle
from ..sources import domain as D, readings as I
from ..sources.tables import Tables
from .registry import cte, query

H = N.HOUR
TAGS = ["view", "error", "click", "purchase"]


@query("s08_two_payloads", "SELECT tag, count(*) AS n, CAST(sum(centi) AS BIGINT) AS centi FROM x_readings GROUP BY tag")
def _(t: Tables):
    r = D.readings(t)
    ts = F.col("us") / 1e6
    listed = r.filter("reading_id % 2 = 0").select(F.to_json(F.struct(F.array(F.struct(F.col("tag").alias("etiqueta"), ts.alias("ts"), F.col("value").alias("valor"))).alias("lecturas"))).alias("body"))
    shot = r.filter("reading_id % 2 = 1").select(F.to_json(F.struct(ts.alias("ts"), F.create_map("tag", "value").alias("presiones"))).alias("body"))
    return I.from_payloads(listed.unionByName(shot)).groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("centi"))


@query("p14_reading_rejects", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN tag = 'signup' THEN 'unknown tag' WHEN reading_id % 50 = 0 THEN 'not numeric' WHEN value > 200 THEN 'out of range' WHEN ts > TIMESTAMP '2024-01-30 00:00:00' THEN 'future time' ELSE 'good' END AS reason FROM x_readings) GROUP BY reason""")
def _(t: Tables):
    raw = D.readings(t).select("reading_id", "tag", "ts", F.when(F.col("reading_id") % 50 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("raw"))
    v = N.validate(raw, TAGS, 0.0, 200.0, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return v.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


cte("x_steps", f"""
SELECT *, round(CAST(bs AS DOUBLE) / bn, 6) AS base, round(CAST(rs AS DOUBLE) / rn, 6) AS recent FROM (SELECT *,
 sum(centi) OVER (PARTITION BY tag ORDER BY us RANGE BETWEEN {38 * H} PRECEDING AND {3 * H} PRECEDING) AS bs, count(*) OVER (PARTITION BY tag ORDER BY us RANGE BETWEEN {38 * H} PRECEDING AND {3 * H} PRECEDING) AS bn0,
 nullif(count(*) OVER (PARTITION BY tag ORDER BY us RANGE BETWEEN {38 * H} PRECEDING AND {3 * H} PRECEDING), 0) AS bn,
 sum(centi) OVER (PARTITION BY tag ORDER BY us RANGE BETWEEN {3 * H - 1} PRECEDING AND CURRENT ROW) AS rs, count(*) OVER (PARTITION BY tag ORDER BY us RANGE BETWEEN {3 * H - 1} PRECEDING AND CURRENT ROW) AS rn FROM x_readings)""")
cte("x_cross", """
SELECT *, round((pv - level) / (pv - centi), 6) AS share FROM (SELECT *, base - (base - recent) * 0.5::DOUBLE AS level, lag(centi) OVER (PARTITION BY tag ORDER BY us, reading_id) AS pv, lag(us) OVER (PARTITION BY tag ORDER BY us, reading_id) AS pu FROM x_steps)
WHERE base - recent >= 1500 AND pv > level AND centi <= level""")


@query("w19_step", "SELECT reading_id, base, recent FROM x_steps")
def _(t: Tables):
    return N.steps(D.readings(t), ["tag"], H).select("reading_id", "base", "recent")


def crossings(t: Tables):
    return N.arrivals(N.steps(D.readings(t), ["tag"], H), ["tag"], 1500.0)


@query("w20_half_drop_arrival", "SELECT reading_id, tag, share, pu + CAST(round(share * (us - pu)) AS BIGINT) AS arrival_us FROM x_cross")
def _(t: Tables):
    return crossings(t).select("reading_id", "tag", "share", "arrival_us")


# Every order stands for one wave: its place on the line, small timing errors and fading amplitudes follow from its number.
STN = "[0.0, 20.0, 40.0, 60.0, 80.0, 100.0, 120.0]"
cte("x_fronts", """
SELECT wave, km, abs(km - x) / 1.1::DOUBLE + ((wave * 7 + CAST(km AS BIGINT) * 13) % 11 - 5) / 200.0::DOUBLE AS arrival_s, 1.0::DOUBLE / (1 + abs(km - x) / 30) AS amplitude FROM (
 SELECT o_orderkey AS wave, (o_orderkey % 1180) / 10.0::DOUBLE + 1 AS x, CAST(unnest([0, 20, 40, 60, 80, 100, 120]) AS DOUBLE) AS km FROM orders)""")


def fronts(t: Tables):
    o = D.orders(t).select(F.col("order_id").alias("wave"), ((F.col("order_id") % 1180) / 10.0 + 1).alias("x"))
    e = o.withColumn("km", F.explode(F.array(*[F.lit(k) for k in N.STATIONS])))
    noise = ((F.col("wave") * 7 + F.col("km").cast("bigint") * 13) % 11 - 5) / 200.0
    return e.select("wave", "km", (F.abs(F.col("km") - F.col("x")) / N.WAVE_KM_S + noise).alias("arrival_s"), (F.lit(1.0) / (1 + F.abs(F.col("km") - F.col("x")) / 30)).alias("amplitude"))


@query("w21_triangulation", """
SELECT wave, round(x, 3) AS x, round(sigma, 4) AS sigma FROM (
 SELECT *, row_number() OVER (PARTITION BY wave ORDER BY round(sse, 9), seg) AS rn, CASE WHEN q > 1e-12 AND n > 2 THEN sqrt(sse / (n - 2) / q) END AS sigma FROM (
  SELECT *, greatest(Syy - 2*x*Szy + x*x*Szz - (Sy - x*Sz)*(Sy - x*Sz)/W, 0) AS sse FROM (
   SELECT *, least(greatest(CASE WHEN q > 1e-12 THEN (Szy - Sz*Sy/W) / q ELSE (a + b) / 2 END, a), b) AS x FROM (
    SELECT *, Szz - Sz*Sz/W AS q FROM (
     SELECT wave, seg, a, b, count(*) AS n, sum(w) AS W, sum(w*z) AS Sz, sum(w*y) AS Sy, sum(w*z*z) AS Szz, sum(w*z*y) AS Szy, sum(w*y*y) AS Syy FROM (
      SELECT wave, seg, seg * 20.0::DOUBLE AS a, seg * 20.0::DOUBLE + 20 AS b, amplitude * amplitude AS w, sg / 1.1::DOUBLE AS z, arrival_s + sg * km / 1.1::DOUBLE AS y FROM (
       SELECT *, CASE WHEN km <= seg * 20 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM x_fronts, (SELECT unnest([0,1,2,3,4,5]) AS seg))) GROUP BY ALL))))) WHERE rn = 1""")
def _(t: Tables):
    return N.triangulate(fronts(t)).select("wave", F.round("x", 3).alias("x"), F.round("sigma", 4).alias("sigma"))


@query("w25_profile_fit", """
SELECT incident, x, round(depth, 6) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY gain, x) AS rn FROM (
 SELECT incident, x, round(-sum(d * tri) * sum(d * tri) / sum(tri * tri), 6) AS gain, sum(d * tri) / sum(tri * tri) AS depth FROM (
  SELECT reading_id AS incident, x, 1 + value / 100.0 * CASE WHEN st <= vx THEN st / vx ELSE (120.0::DOUBLE - st) / (120.0::DOUBLE - vx) END AS d, CASE WHEN st <= x THEN st / x ELSE (120.0::DOUBLE - st) / (120.0::DOUBLE - x) END AS tri
  FROM (SELECT reading_id, value, k * 1.15::DOUBLE + 2 AS vx FROM x_readings WHERE tag = 'error'), (SELECT CAST(unnest([0, 20, 40, 60, 80, 100, 120]) AS DOUBLE) AS st), (SELECT CAST(unnest(range(1, 120)) AS DOUBLE) AS x)) GROUP BY incident, x)) WHERE rn = 1""")
def _(t: Tables):
    r = D.readings(t).filter("tag = 'error'").withColumn("vx", F.col("k") * 1.15 + 2)
    drop = lambda s: F.lit(1) + F.col("value") / 100.0 * F.when(F.lit(s) <= F.col("vx"), F.lit(s) / F.col("vx")).otherwise((F.lit(120.0) - s) / (F.lit(120.0) - F.col("vx")))
    d = r.select(F.col("reading_id").alias("incident"), F.array(*[drop(s) for s in N.STATIONS]).alias("drops"))
    return N.profile_fit(d).select("incident", "x", F.round("depth", 6).alias("depth"))


cte("x_hours", f"""
SELECT k % 4 AS line, us // {H} * {H} AS slot, coalesce(sum(centi) FILTER (tag = 'purchase'), 0) AS inflow, coalesce(sum(centi) FILTER (tag = 'view'), 0) AS outflow FROM x_readings GROUP BY ALL""")
ALLOWED, ALARM = 1000, 3000  # k of the CUSUM, and S over which a line is in alarm
cte("x_bal", f"""
WITH RECURSIVE o AS (SELECT *, inflow - outflow AS raw, row_number() OVER (PARTITION BY line ORDER BY slot) AS i FROM x_hours),
f(line, i, d, s, total, n) AS (SELECT line, i, CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), CAST(raw AS HUGEINT), 1 FROM o WHERE i = 1
 UNION ALL SELECT line, i, d, s, CASE WHEN s <= {ALARM} THEN total + raw ELSE total END, CASE WHEN s <= {ALARM} THEN n + 1 ELSE n END FROM (
  SELECT *, greatest(0, before + d - {ALLOWED}) AS s FROM (
   SELECT o.line, o.i, o.raw, f.total, f.n, f.s AS before, CASE WHEN o.i <= {N.WARM_HOURS} THEN 0 ELSE o.raw - (f.total - ((f.total % f.n) + f.n) % f.n) // f.n END AS d FROM f JOIN o ON o.line = f.line AND o.i = f.i + 1)))
SELECT o.line, o.slot, o.inflow, o.outflow, f.d FROM f JOIN o ON o.line = f.line AND o.i = f.i""")
cte("x_cusum", """
SELECT *, p - least(0, min(p) OVER (PARTITION BY line ORDER BY slot ROWS UNBOUNDED PRECEDING)) AS s FROM (SELECT *, sum(d - 1000) OVER (PARTITION BY line ORDER BY slot ROWS UNBOUNDED PRECEDING) AS p FROM x_bal)""")


def hours(t: Tables):
    r = D.readings(t)
    flow = lambda tag: F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("centi"))), F.lit(0))
    return r.groupBy((F.col("k") % 4).alias("line"), (F.floor(F.col("us") / H) * H).cast("bigint").alias("slot")).agg(flow("purchase").alias("inflow"), flow("view").alias("outflow"))


def shortfall(t: Tables):
    return N.balance(hours(t), ALLOWED, ALARM)


@query("w22_balance", "SELECT line, slot, CAST(d AS BIGINT) AS d FROM x_bal")
def _(t: Tables):
    return shortfall(t).select("line", "slot", "d")


@query("w23_cusum", "SELECT line, slot, CAST(s AS BIGINT) AS s FROM x_cusum")
def _(t: Tables):
    return N.cusum(shortfall(t), ["line"], ["slot"], "d", 1000).select("line", "slot", "s")


cte("x_marks", "SELECT k % 4 AS line, us AS m FROM x_readings WHERE tag = 'signup'")
cte("x_near", """
SELECT r.*, b.m AS mark_before, a.m AS mark_after FROM (SELECT *, k % 4 AS line FROM x_readings WHERE tag <> 'signup') r
ASOF LEFT JOIN x_marks b ON b.line = r.line AND b.m <= r.us ASOF LEFT JOIN x_marks a ON a.line = r.line AND a.m >= r.us""")


def marked(t: Tables):
    r = D.readings(t).withColumn("line", F.col("k") % 4)
    return N.nearest_mark(r.filter("tag <> 'signup'"), r.filter("tag = 'signup'"), ["line"])


@query("w24_hold_after_maneuver", f"SELECT reading_id, coalesce(us - mark_before <= {H // 2}, false) AS on_hold FROM x_near")
def _(t: Tables):
    return marked(t).select("reading_id", F.coalesce(F.col("us") - F.col("mark_before") <= H // 2, F.lit(False)).alias("on_hold"))


@query("j13_front_in_log", f"SELECT reading_id, CASE WHEN coalesce(us - mark_before <= {H // 4}, false) OR coalesce(mark_after - us <= {H // 4}, false) THEN 'logged' ELSE 'notify control' END AS log FROM x_near WHERE tag = 'error'")
def _(t: Tables):
    close = F.coalesce(F.col("us") - F.col("mark_before") <= H // 4, F.lit(False)) | F.coalesce(F.col("mark_after") - F.col("us") <= H // 4, F.lit(False))
    return marked(t).filter("tag = 'error'").select("reading_id", F.when(close, "logged").otherwise("notify control").alias("log"))


ACCESSES = [("A1", 8.0), ("A2", 31.0), ("A3", 55.5), ("A4", 77.0), ("A5", 112.0)]
BRIGADES = [("north", 15.0), ("centre", 62.0), ("south", 105.0)]
arr = lambda rows: "[" + ", ".join(f"{{'d': abs(km - {x}), 'n': '{n}'}}" for n, x in rows) + "]"


@query("j14_nearest_access_brigade", f"""
SELECT reading_id, a.n AS access, b.n AS brigade, round(b.d / 60 * 60 + 5, 4) AS eta_min FROM (SELECT reading_id, list_min({arr(ACCESSES)}) AS a, list_min({arr(BRIGADES)}) AS b FROM (SELECT *, k * 1.2::DOUBLE AS km FROM x_readings WHERE tag = 'error'))""")
def _(t: Tables):
    km = F.col("k") * 1.2
    r = D.readings(t).filter("tag = 'error'").select("reading_id", nearest(km, ACCESSES).alias("a"), nearest(km, BRIGADES).alias("b"))
    return r.select("reading_id", F.col("a.name").alias("access"), F.col("b.name").alias("brigade"), F.round(F.col("b.distance") / 60 * 60 + 5, 4).alias("eta_min"))


def raw_incidents(readings):
    return readings.filter("tag = 'error' AND centi > 6000").select(
        F.col("reading_id").alias("incident_id"), "us", F.floor(F.col("k") * 12 / 10).cast("int").alias("km"), "centi").withColumn("zone", F.floor(F.col("km") / 10).cast("int"))


def merged(t: Tables):
    return N.merge(raw_incidents(D.readings(t)), ["zone"], 6 * H)


def taps(t: Tables):
    return D.readings(t).filter("tag = 'purchase' AND centi > 6000").select(F.col("reading_id").alias("tap_id"), "us", F.floor(F.col("k") * 12 / 10).cast("int").alias("km"), "centi")


cte("x_inc", "SELECT reading_id AS incident_id, us, CAST(floor(k * 12 / 10) AS INTEGER) AS km, centi, CAST(floor(floor(k * 12 / 10) / 10) AS INTEGER) AS zone FROM x_readings WHERE tag = 'error' AND centi > 6000")
cte("x_merged", f"""
SELECT zone, run, min(us) AS start_us, max(us) AS end_us, count(*) AS n, first(km ORDER BY us, incident_id) AS km, first(incident_id ORDER BY us, incident_id) AS first_id FROM (
 SELECT *, sum(CAST(b IS NULL OR us - b > {6 * H} AS INTEGER)) OVER (PARTITION BY zone ORDER BY us, incident_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(us) OVER (PARTITION BY zone ORDER BY us, incident_id) AS b FROM x_inc)) GROUP BY zone, run""")
cte("x_taps", "SELECT reading_id AS tap_id, us AS tap_us, CAST(floor(k * 12 / 10) AS INTEGER) AS tap_km, centi FROM x_readings WHERE tag = 'purchase' AND centi > 6000")
cte("x_match", f"""
SELECT tap_id, tap_us, tap_km, first_id, start_us, km, CASE WHEN first_id IS NULL THEN 'missed' ELSE 'found' END AS outcome FROM (
 SELECT t.*, m.first_id, m.start_us, m.km, row_number() OVER (PARTITION BY tap_id ORDER BY abs(start_us - tap_us), first_id) AS rn
 FROM x_taps t LEFT JOIN x_merged m ON abs(start_us - tap_us) <= {12 * H} AND abs(km - tap_km) <= 10) WHERE rn = 1""")
cte("x_outcome", "SELECT * FROM x_match UNION ALL SELECT NULL, NULL, NULL, first_id, start_us, km, 'extra' FROM x_merged WHERE first_id NOT IN (SELECT first_id FROM x_match WHERE first_id IS NOT NULL)")


@query("w27_merged_incidents", "SELECT zone, first_id, n, start_us, end_us, km FROM x_merged")
def _(t: Tables):
    return merged(t).select("zone", "first_id", "n", "start_us", "end_us", "km")


@query("j15_incident_vs_tap", "SELECT coalesce(tap_id, -1) AS tap_id, coalesce(first_id, -1) AS first_id, outcome FROM x_outcome")
def _(t: Tables):
    return N.match_taps(merged(t), taps(t), 12 * H, 10).select(F.coalesce("tap_id", F.lit(-1)).alias("tap_id"), F.coalesce("first_id", F.lit(-1)).alias("first_id"), "outcome")


def report(incidents, confirmed, readings):
    """Per size of tap: detection rate, error, minutes to detect, and the false alarms a day over the days the readings span."""
    m = settle(N.match_taps(incidents, confirmed, 12 * H, 10))
    band = F.when(F.col("centi") < 8000, "low").when(F.col("centi") < 12000, "medium").otherwise("high")
    j = m.filter("outcome <> 'extra'").join(confirmed.select("tap_id", band.alias("band")), "tap_id")
    # Whole kilometres and minutes are counted, then the percentiles read the few distinct values.
    g = j.groupBy("band", "outcome", F.abs(F.col("km") - F.col("tap_km")).alias("e"), F.floor(F.abs(F.col("start_us") - F.col("tap_us")) / (60 * N.SECOND)).alias("m")).agg(F.count("*").alias("k"))
    rep = g.groupBy("band").agg(F.sum("k").alias("taps"), ratio(F.sum(F.when(F.col("outcome") == "found", F.col("k"))), F.sum("k")).alias("detection_rate"),
                                F.expr("percentile(e, 0.9, k)").alias("error_p90_km"), F.expr("percentile(m, 0.5, k)").alias("minutes_to_detect"))
    days = literals(readings.agg(((F.max("us") - F.min("us")) / (24 * H)).alias("days")))["days"]
    return rep.withColumns(literals(m.filter("outcome = 'extra'").agg((F.round(F.count("*") / days, 6)).alias("false_alarms_per_day"))))


REPORT = f"""
SELECT band, count(*) AS taps, round(CAST(count(*) FILTER (outcome = 'found') AS DOUBLE) / count(*), 6) AS detection_rate, CAST(quantile_cont(abs(km - tap_km), 0.9) FILTER (outcome = 'found') AS DOUBLE) AS error_p90_km,
 CAST(median(abs(start_us - tap_us) // {60 * N.SECOND}) FILTER (outcome = 'found') AS DOUBLE) AS minutes_to_detect, round((SELECT CAST(count(*) AS DOUBLE) FROM x_outcome WHERE outcome = 'extra') / (SELECT CAST(max(us) - min(us) AS DOUBLE) / {24 * H} FROM x_readings), 6) AS false_alarms_per_day
FROM (SELECT m.*, CASE WHEN centi < 8000 THEN 'low' WHEN centi < 12000 THEN 'medium' ELSE 'high' END AS band FROM x_match m JOIN x_taps USING (tap_id)) GROUP BY band"""


@query("t01_detection_report", REPORT)
def _(t: Tables):
    return report(merged(t), taps(t), D.readings(t))


@query("t02_stolen_volume", """
SELECT line, CAST(run AS BIGINT) AS run, count(*) AS hours, CAST(sum(d) AS BIGINT) AS volume, CAST(sum(d) * 24 AS BIGINT) AS money FROM (
 SELECT *, sum(CAST(s > 3000 AND NOT was AS INTEGER)) OVER (PARTITION BY line ORDER BY slot ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce(lag(s) OVER (PARTITION BY line ORDER BY slot) > 3000, false) AS was FROM x_cusum)) WHERE s > 3000 GROUP BY line, run""")
def _(t: Tables):
    return volumes(t)


def alarms(t: Tables):
    """Hours in alarm (S over 3000) numbered as runs per line."""
    c = N.cusum(shortfall(t), ["line"], ["slot"], "d", 1000)
    scan = OrderedScan(c, ["line"], ["slot"]).prev({"_was": "s"})
    from ..operators.ordered import islands
    islands(scan, (F.col("s") > 3000) & ~F.coalesce(F.col("_was") > 3000, F.lit(False)), "run")
    return scan.result().filter("s > 3000")


def volumes(t: Tables):
    return alarms(t).groupBy("line", "run").agg(F.count("*").alias("hours"), F.sum("d").alias("volume"), F.sum(F.col("d") * 24).alias("money"))


FUSE = """CASE WHEN stations = 1 THEN 'transmitter fault' WHEN stations > 0 AND (at_terminal OR logged) THEN 'maneuver' WHEN stations > 0 AND shortfall THEN 'confirmed tap' WHEN stations > 0 THEN 'probable tap'
 WHEN long_shortfall THEN 'gradual extraction' WHEN shortfall THEN 're-packing' ELSE 'normal' END"""


@query("w26_fusion", f"""
SELECT line, slot, {FUSE} AS class FROM (
 SELECT c.line, c.slot, coalesce(stations, 0) AS stations, coalesce(at_terminal, false) AS at_terminal, coalesce(logged, false) AS logged, s > 3000 AS shortfall, s > 9000 AS long_shortfall FROM x_cusum c LEFT JOIN (
  SELECT k % 4 AS line, us // {H} * {H} AS slot, count(DISTINCT station % 7) AS stations, bool_or(station % 7 IN (0, 6)) AND count(DISTINCT station % 7) = 2 AS at_terminal FROM x_readings WHERE tag = 'error' GROUP BY ALL) f USING (line, slot)
 LEFT JOIN (SELECT k % 4 AS line, us // {H} * {H} AS slot, count(*) >= 2 AS logged FROM x_readings WHERE tag = 'signup' GROUP BY ALL) g USING (line, slot))""")
def _(t: Tables):
    r = D.readings(t).withColumn("line", F.col("k") % 4).withColumn("slot", (F.floor(F.col("us") / H) * H).cast("bigint"))
    st = F.count_distinct(F.col("station") % 7)
    f = r.filter("tag = 'error'").groupBy("line", "slot").agg(st.alias("stations"), (F.bool_or((F.col("station") % 7).isin(0, 6)) & (st == 2)).alias("at_terminal"))
    g = r.filter("tag = 'signup'").groupBy("line", "slot").agg((F.count("*") >= 2).alias("logged"))
    c = N.cusum(shortfall(t), ["line"], ["slot"], "d", 1000).join(f, ["line", "slot"], "left").join(g, ["line", "slot"], "left")
    no = F.lit(False)
    return c.select("line", "slot", N.classify(F.coalesce("stations", F.lit(0)), F.coalesce("at_terminal", no), F.coalesce("logged", no), F.col("s") > 3000, F.col("s") > 9000).alias("class"))


cte("x_slots", f"SELECT tag, us // {H} * {H} AS slot_us, first(centi ORDER BY us DESC, reading_id DESC) AS value FROM x_readings GROUP BY ALL")
cte("x_gaps", f"""
SELECT tag, value, run, slot_us AS s0, unnest(range(slot_us, CASE WHEN coalesce(nxt - slot_us > {3 * H}, true) THEN slot_us + 1 ELSE nxt END, {H})) AS slot_us FROM (
 SELECT *, sum(CAST(prv IS NULL OR slot_us - prv > {3 * H} AS INTEGER)) OVER (PARTITION BY tag ORDER BY slot_us ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, lag(slot_us) OVER w AS prv, lead(slot_us) OVER w AS nxt FROM x_slots WINDOW w AS (PARTITION BY tag ORDER BY slot_us)))""")


@query("w28_gap_fill", "SELECT tag, slot_us, CAST(value AS BIGINT) AS value, slot_us <> s0 AS repeated, CAST(run AS BIGINT) AS run FROM x_gaps")
def _(t: Tables):
    return N.fill_gaps(D.readings(t), ["tag"], H, 3 * H).select("tag", "slot_us", "value", "repeated", "run")


@query("w29_incident_audit", """
SELECT incident, count(*) AS steps, first(state ORDER BY us DESC, reading_id DESC) AS state, count(*) FILTER (bad) AS bad_transitions FROM (
 SELECT *, before IS NOT NULL AND rank <= before AS bad FROM (SELECT *, lag(rank) OVER (PARTITION BY incident ORDER BY us, reading_id) AS before FROM (
  SELECT station AS incident, us, reading_id, CASE tag WHEN 'view' THEN 'dispatched' WHEN 'click' THEN 'on site' WHEN 'purchase' THEN 'sealed' ELSE 'false alarm' END AS state,
   CASE tag WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 3 END AS rank FROM x_readings WHERE tag <> 'signup'))) GROUP BY incident""")
def _(t: Tables):
    state = F.when(F.col("tag") == "view", "dispatched").when(F.col("tag") == "click", "on site").when(F.col("tag") == "purchase", "sealed").otherwise("false alarm")
    rank = F.when(F.col("tag") == "view", 1).when(F.col("tag") == "click", 2).otherwise(3)
    a = D.readings(t).filter("tag <> 'signup'").select(F.col("station").alias("incident"), "us", "reading_id", state.alias("state"), rank.alias("rank"))
    a = OrderedScan(a, ["incident"], ["us", "reading_id"]).prev({"before": "rank"}).result()
    return a.groupBy("incident").agg(F.count("*").alias("steps"), F.max_by("state", F.struct("us", "reading_id")).alias("state"), F.count_if(F.col("rank") <= F.col("before")).alias("bad_transitions"))


@query("t04b_reorder_late", "SELECT tag, count(*) AS n, CAST(sum(CAST(backwards AS INTEGER)) AS BIGINT) AS backwards FROM (SELECT tag, us < lag(us) OVER (PARTITION BY tag ORDER BY arrival, reading_id) AS backwards FROM (SELECT *, reading_id - reading_id % 4 + (3 - reading_id % 4) AS arrival FROM x_readings)) GROUP BY tag")
def _(t: Tables):
    # Arrival order is scrambled in fours; how often does time run backwards within a tag?
    r = D.readings(t).withColumn("arrival", F.col("reading_id") - F.col("reading_id") % 4 + (3 - F.col("reading_id") % 4))
    s = OrderedScan(r, ["tag"], ["arrival", "reading_id"]).prev({"pu": "us"}).result()
    return s.groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("us") < F.col("pu")).alias("backwards"))


@query("t07b_silent_sources", "SELECT station, max(us) AS last_us FROM x_readings GROUP BY station HAVING max(us) < (SELECT max(us) FROM x_readings) - " + str(12 * H))
def _(t: Tables):
    r = D.readings(t)
    last = r.groupBy("station").agg(F.max("us").alias("last_us"))
    now = literals(r.agg(F.max("us").alias("now")))["now"]
    return last.filter(F.col("last_us") < now - 12 * H).select("station", "last_us")
