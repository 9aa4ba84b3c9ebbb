"""Sensor analytics: fronts, triangulation, balance, CUSUM, fusion, merging and evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import ratio
from .ordered import OrderedScan, islands, rolling

SECOND = 1_000_000
HOUR = 3600 * SECOND

# Fixed values of the line the examples use: 7 stations on 120 km, wave speed in km/s.
LINE_KM = 120.0
STATIONS = (0.0, 20.0, 40.0, 60.0, 80.0, 100.0, 120.0)
WAVE_KM_S = 1.1
BASELINE_S, RECENT_S = 35, 3  # seconds of the step test; callers scale them to the sampling rate
ARRIVAL_SHARE = 0.5
HOLD_AFTER_MANEUVER_MIN = 10
WARM_HOURS = 24  # hours of a line that only teach its meter bias


def validate(df: DataFrame, tags: list[str], low: float, high: float, now: Column) -> DataFrame:
    """(tag, ts, raw text value) to typed value plus the reason of rejection, NULL when good."""
    v = F.col("raw").try_cast("double")
    reason = (
        F.when(~F.col("tag").isin(*tags), "unknown tag").when(v.isNull(), "not numeric")
        .when(~v.between(low, high), "out of range").when(F.col("ts") > now, "future time"))
    return df.withColumn("value", v).withColumn("reason", reason)


def steps(df: DataFrame, keys: list[str], unit: int, hot_rows: int | None = None) -> DataFrame:
    """Adds base (mean of the baseline before) and recent (mean of the last moments); ``unit`` microseconds per step second."""
    one = df.withColumn("_one", F.lit(1))
    split = RECENT_S * unit
    out = rolling(one, keys, "us", "reading_id", {
        "_bs": ("centi", (BASELINE_S + RECENT_S) * unit, split), "_bn": ("_one", (BASELINE_S + RECENT_S) * unit, split),
        "_rs": ("centi", split - 1, 0), "_rn": ("_one", split - 1, 0)}, hot_rows)
    return out.withColumn("base", ratio("_bs", "_bn")).withColumn("recent", ratio("_rs", "_rn")).drop("_one", "_bs", "_bn", "_rs", "_rn")


def arrivals(stepped: DataFrame, keys: list[str], min_drop: float, hot_rows: int | None = None) -> DataFrame:
    """Readings where the value crosses half of the drop, with the share of the way to the crossing (0..1)."""
    scan = OrderedScan(stepped, keys, ["us", "reading_id"], hot_rows).prev({"_pv": "centi", "_pu": "us"})
    level = F.col("base") - (F.col("base") - F.col("recent")) * ARRIVAL_SHARE
    out = scan.result().withColumn("level", level)
    crossed = (F.col("base") - F.col("recent") >= min_drop) & (F.col("_pv") > F.col("level")) & (F.col("centi") <= F.col("level"))
    share = F.round((F.col("_pv") - F.col("level")) / (F.col("_pv") - F.col("centi")), 6)
    out = out.filter(crossed).withColumn("share", share)
    return out.withColumn("arrival_us", F.col("_pu") + F.round(F.col("share") * (F.col("us") - F.col("_pu"))).cast("bigint")).drop("_pv", "_pu")


def triangulate(fronts: DataFrame, stations: tuple[float, ...] = STATIONS, v: float = WAVE_KM_S) -> DataFrame:
    """(wave, km, arrival_s, amplitude) to (wave, x, sigma, n): weighted least squares of t = t0 + |x_k - x| / v.

    Between two neighbouring stations the signs of x_k - x are known, so the fit
    is a straight line and has a closed form; the best stretch wins. No grid.
    """
    stretch = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(zip(stations, stations[1:]))])
    e = fronts.select("wave", "km", "arrival_s", "amplitude", F.explode(stretch).alias("s")).select("*", "s.*")
    sign = F.when(F.col("km") <= F.col("a"), 1.0).otherwise(-1.0)
    e = e.withColumn("w", F.col("amplitude") * F.col("amplitude")).withColumn("z", sign / v).withColumn("y", F.col("arrival_s") + sign * F.col("km") / v)
    s = lambda c: F.sum(c)
    g = e.groupBy("wave", "seg", "a", "b").agg(
        s(F.col("w")).alias("W"), s(F.expr("w*z")).alias("Sz"), s(F.expr("w*y")).alias("Sy"), s(F.expr("w*z*z")).alias("Szz"),
        s(F.expr("w*z*y")).alias("Szy"), s(F.expr("w*y*y")).alias("Syy"), F.count("*").alias("n"))
    szz = F.expr("Szz - Sz*Sz/W")
    free = F.when(szz > 1e-12, F.expr("(Szy - Sz*Sy/W)") / szz).otherwise((F.col("a") + F.col("b")) / 2)
    g = g.withColumn("x", F.least(F.greatest(free, F.col("a")), F.col("b")))
    g = g.withColumn("sse", F.greatest(F.expr("Syy - 2*x*Szy + x*x*Szz - (Sy - x*Sz)*(Sy - x*Sz)/W"), F.lit(0.0)))
    g = g.withColumn("sigma", F.when((szz > 1e-12) & (F.col("n") > 2), F.sqrt(F.col("sse") / (F.col("n") - 2) / szz)))
    best = F.min_by(F.struct("x", "sigma", "n"), F.struct(F.round("sse", 9), F.col("seg")))
    return g.groupBy("wave").agg(best.alias("m")).select("wave", "m.*")


def profile_fit(drops: DataFrame, stations: tuple[float, ...] = STATIONS, length: float = LINE_KM, step: float = 1.0) -> DataFrame:
    """(incident, drops array by station) to vertex and depth of the triangle that fits best.

    The depth has a closed form for each vertex, the vertices are a fixed short
    list, and all of it happens inside the row.
    """
    xs = F.array(*[F.lit(step * i) for i in range(1, int(length / step))])

    def tri(x):
        return [F.when(F.lit(k) <= x, F.lit(k) / x).otherwise((F.lit(length) - F.lit(k)) / (F.lit(length) - x)) for k in stations]

    def fit(x):
        t = tri(x)
        dt = sum((F.col("drops")[i] * t[i] for i in range(1, len(t))), F.col("drops")[0] * t[0])
        tt = sum((t[i] * t[i] for i in range(1, len(t))), t[0] * t[0])
        return F.struct(F.round(-dt * dt / tt, 6).alias("gain"), x.alias("x"), (dt / tt).alias("depth"))

    return drops.withColumn("m", F.array_min(F.transform(xs, fit))).select("incident", F.col("m.x").alias("x"), F.col("m.depth").alias("depth"))


def balance(hours: DataFrame, k: int, alarm: int, warm: int = WARM_HOURS) -> DataFrame:
    """(line, slot, inflow, outflow) plus the shortfall ``d`` beyond the learnt meter bias.

    The bias of a line is the mean shortfall of its normal hours so far (whole
    units, rounded down); its first ``warm`` hours only teach and have no
    shortfall. With S = max(0, S + d - k), an hour with S over ``alarm`` teaches
    nothing, so a tap is not learnt as the meter's fault. What is learnt decides
    what may be learnt next, which no window can say: the hours of a line, one row
    each, are folded in order.
    """
    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("slot")
        total = n = s = 0
        short = []
        for hour, raw in enumerate((part["inflow"] - part["outflow"]).tolist()):
            d = 0 if hour < warm or not n else raw - total // n
            s = max(0, s + d - k)
            if s <= alarm:
                total, n = total + raw, n + 1
            short.append(d)
        return part.assign(d=short)

    flat = hours.select(F.col("line").cast("int").alias("line"), F.col("slot").cast("bigint").alias("slot"),
                        F.col("inflow").cast("bigint").alias("inflow"), F.col("outflow").cast("bigint").alias("outflow"))
    return flat.groupBy("line").applyInPandas(fold, "line int, slot bigint, inflow bigint, outflow bigint, d bigint")


def cusum(df: DataFrame, keys: list[str], order: list[str], d: str, k: int, hot_rows: int | None = None) -> DataFrame:
    """Adds S = max(0, S + d - k) without a loop: P - min(0, running min of P), P the running sum."""
    scan = OrderedScan(df.withColumn("_x", F.col(d) - k), keys, order, hot_rows)
    scan.running({"_p": ("sum", "_x")}).running({"_m": ("min", "_p")})
    return scan.result().withColumn("s", F.col("_p") - F.least(F.lit(0), F.col("_m"))).drop("_x", "_p", "_m")


def nearest_mark(df: DataFrame, marks: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """Adds mark_before and mark_after: time of the nearest mark of the key on each side (one ordered pass)."""
    both = df.withColumn("_mark", F.lit(None).cast("bigint")).unionByName(
        marks.select(*keys, "us", F.col("us").alias("_mark")).withColumn("reading_id", F.lit(-1)), allowMissingColumns=True)
    both = both.withColumn("_kind", F.col("_mark").isNull().cast("int"))
    scan = OrderedScan(both, keys, ["us", "_kind", "reading_id"], hot_rows)
    scan.running({"mark_before": ("last", "_mark")}).running({"mark_after": ("last", "_mark")}, reverse=True)
    return scan.result().filter("_kind = 1").drop("_mark", "_kind")


def fill_gaps(df: DataFrame, keys: list[str], slot: int, max_gap: int, hot_rows: int | None = None) -> DataFrame:
    """One sample per slot: the last reading is repeated up to ``max_gap``; after a longer gap a new run starts.

    Every reading emits its own samples up to the next one, so no grid is joined.
    Output (keys, slot_us, value, repeated, run).
    """
    at = F.floor(F.col("us") / slot) * slot
    per_slot = df.groupBy(*keys, at.cast("bigint").alias("slot_us")).agg(F.max_by("centi", F.struct("us", "reading_id")).alias("value"))
    scan = OrderedScan(per_slot, keys, ["slot_us"], hot_rows).prev({"_before": "slot_us"}).next({"_after": "slot_us"})
    islands(scan, F.col("_before").isNull() | (F.col("slot_us") - F.col("_before") > max_gap), "run")
    stop = F.least(F.coalesce(F.col("_after") - slot, F.col("slot_us")), F.col("slot_us") + max_gap)
    stop = F.when(F.coalesce(F.col("_after") - F.col("slot_us") > max_gap, F.lit(True)), F.col("slot_us")).otherwise(stop)
    out = scan.result().select(*keys, "value", "run", F.col("slot_us").alias("_s"), F.explode(F.sequence("slot_us", stop, F.lit(slot))).alias("slot_us"))
    return out.select(*keys, "slot_us", "value", (F.col("slot_us") != F.col("_s")).alias("repeated"), "run")


def merge(incidents: DataFrame, keys: list[str], gap: int, hot_rows: int | None = None) -> DataFrame:
    """Incidents of one key closer than ``gap`` are one: (keys, start_us, end_us, n, km, first_id)."""
    scan = OrderedScan(incidents, keys, ["us", "incident_id"], hot_rows).prev({"_before": "us"})
    islands(scan, F.col("_before").isNull() | (F.col("us") - F.col("_before") > gap), "run")
    return scan.result().groupBy(*keys, "run").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"),
        F.min_by("km", F.struct("us", "incident_id")).alias("km"), F.min_by("incident_id", F.struct("us", "incident_id")).alias("first_id"))


def match_taps(incidents: DataFrame, taps: DataFrame, max_time: int, max_km: int) -> DataFrame:
    """Confirmed taps with their best incident within time and distance; full outer.

    Both sides are cut into time slots and km zones so that the join has an equi
    key; taps look into the neighbouring cells. Incidents were merged before, so
    a cell holds a bounded number of them.
    """
    cell_t, cell_k = (lambda c: F.floor(F.col(c) / max_time)), (lambda c: F.floor(F.col(c) / max_km))
    inc = incidents.select("first_id", "start_us", "km").withColumn("ct", cell_t("start_us")).withColumn("ck", cell_k("km"))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    tap = taps.select("tap_id", F.col("us").alias("tap_us"), F.col("km").alias("tap_km"))
    spread = tap.withColumn("i", F.explode(near)).withColumn("j", F.explode(near)).withColumn("ct", cell_t("tap_us") + F.col("i")).withColumn("ck", cell_k("tap_km") + F.col("j"))
    pairs = spread.join(inc, ["ct", "ck"]).filter((F.abs(F.col("start_us") - F.col("tap_us")) <= max_time) & (F.abs(F.col("km") - F.col("tap_km")) <= max_km))
    best = pairs.groupBy("tap_id").agg(F.min_by(F.struct("first_id", "start_us", "km"), F.struct(F.abs(F.col("start_us") - F.col("tap_us")), F.col("first_id"))).alias("b"))
    found = tap.join(best, "tap_id", "left").select("tap_id", "tap_us", "tap_km", F.col("b.first_id").alias("first_id"), F.col("b.start_us").alias("start_us"), F.col("b.km").alias("km"))
    extra = incidents.join(found.filter("first_id IS NOT NULL").select("first_id"), "first_id", "left_anti").select("first_id", "start_us", "km")
    out = found.unionByName(extra, allowMissingColumns=True)
    return out.withColumn("outcome", F.when(F.col("tap_id").isNull(), "extra").when(F.col("first_id").isNull(), "missed").otherwise("found"))


def classify(stations: Column, at_terminal: Column, logged: Column, shortfall: Column, long_shortfall: Column) -> Column:
    """What a front and a balance together mean."""
    front = stations > 0
    return (
        F.when(front & (stations == 1), "transmitter fault").when(front & (at_terminal | logged), "maneuver")
        .when(front & shortfall, "confirmed tap").when(front, "probable tap")
        .when(long_shortfall, "gradual extraction").when(shortfall, "re-packing").otherwise("normal"))
