"""Robust anomaly detection on KPI series, with an event calendar and alert episodes.

Input is a long series table (series, region, grain, d, value): days or weeks,
already aggregated, so a (series, region) group is bounded by the calendar and
plain windows are safe whatever the size of the facts.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import ratio

# Fixed values of the method.
WINDOW = {"daily": 28, "business": 20, "weekly": 8}
ANOMALY, CRITICAL, MAD_SCALE = 3.5, 6.0, 1.4826
AFTERMATH_DAYS = 14
WEEKLY_UNDER = 30  # orders a day

COUNTS = ("orders", "sales", "pickups")
BAD_DIRECTION = {
    "orders": -1, "sales": -1, "on_time": -1, "pickups": -1, "negative_reviews": 1, "late_dispatch": 1,
}
ALWAYS_WEEKLY = ("sales", "negative_reviews")
KEY = ["series", "region"]


@dataclass(frozen=True)
class Event:
    name: str
    kind: str  # planned | unplanned
    start: date
    end: date
    uplift: float | None = None
    series: tuple[str, ...] = ()


def touches(e: Event, after: int = 0) -> Column:
    """The period starting at ``d`` overlaps the event (plus ``after`` days)."""
    last = F.when(F.col("grain") == "weekly", F.date_add("d", 6)).otherwise(F.col("d"))
    return (F.col("d") <= F.lit(e.end + timedelta(days=after))) & (last >= F.lit(e.start))


def with_events(df: DataFrame, events: list[Event]) -> DataFrame:
    """planned, event (unplanned, while it lasts), suppressed, near_event (also in the aftermath)."""
    planned, suppressed = F.lit(False), F.lit(False)
    event, near = F.lit(None).cast("string"), F.lit(None).cast("string")
    for e in reversed(events):
        if e.kind == "planned":
            planned = planned | touches(e)
            suppressed = suppressed | (touches(e) & F.col("series").isin(*e.series))
        else:
            event = F.when(touches(e), F.lit(e.name)).otherwise(event)
        near = F.when(touches(e, AFTERMATH_DAYS if e.kind == "unplanned" else 0), F.lit(e.name)).otherwise(near)
    return df.withColumns({"planned": planned, "event": event, "suppressed": suppressed, "near_event": near})


def choose_grain(daily: DataFrame, floor: float = WEEKLY_UNDER) -> DataFrame:
    """(series, region, day, num, den, n) to days or weeks: low-volume regions go weekly.

    The choice is made on orders a day, over the days the series spans. Counts
    get a zero on days without a row; ratios keep only real observations.
    """
    span = daily.groupBy(*KEY).agg(F.min("day").alias("a"), F.max("day").alias("b"), F.sum("n").alias("rows"))
    span = span.withColumn(
        "grain",
        F.when(F.col("series").isin(*ALWAYS_WEEKLY) | (F.col("rows") / (F.datediff("b", "a") + 1) < floor), "weekly").otherwise("daily"),
    )
    grid = span.filter(F.col("series").isin(*COUNTS)).select(
        *KEY, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day")
    )
    filled = daily.join(grid, [*KEY, "day"], "full_outer")
    d = F.when(F.col("grain") == "weekly", F.date_trunc("week", "day").cast("date")).otherwise(F.col("day"))
    g = filled.join(span.select(*KEY, "grain"), KEY).groupBy(*KEY, "grain", d.alias("d")).agg(
        F.coalesce(F.sum("num").cast("double"), F.lit(0.0)).alias("num"), F.sum("den").cast("double").alias("den")
    )
    value = F.when(F.col("series").isin(*COUNTS), F.col("num")).otherwise(F.col("num") / F.col("den"))
    return g.withColumn("value", value).filter("value IS NOT NULL")


def weekday_factor(df: DataFrame) -> DataFrame:
    """Adds ``factor`` and ``adjusted``: daily counts over their weekday's usual share, from earlier days only."""
    before = Window.partitionBy(*KEY).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*KEY, F.weekday("d")).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    raw = F.avg("value").over(same) / F.avg("value").over(before)
    use = F.col("series").isin(*COUNTS) & (F.col("grain") == "daily") & (F.count("*").over(same) >= 4)
    factor = F.when(use & (raw > 0), raw).otherwise(F.lit(1.0))
    return df.withColumn("factor", factor).withColumn("adjusted", F.col("value") / F.col("factor"))


def array_median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    hi = F.get(s, F.floor(n / 2).cast("int"))
    lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
    return (lo + hi) / 2


def window_length() -> Column:
    return (
        F.when(F.col("grain") == "weekly", WINDOW["weekly"])
        .when(F.col("series") == "on_time", WINDOW["business"])
        .otherwise(WINDOW["daily"])
    )


def robust_z(df: DataFrame, events: list[Event]) -> DataFrame:
    """Adds n_base, median, mad and z over the last N valid earlier observations.

    Planned days never count; days of an unplanned event count except for the
    days of that same event. The frame is bounded: N plus all event days is
    enough to hold N valid ones.
    """
    longest = max(WINDOW.values()) + sum((e.end - e.start).days + 1 for e in events)
    # A fixed number of partitions: the groups are few and wide, and would else be coalesced into one task.
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    w = Window.partitionBy(*KEY).orderBy("d").rowsBetween(-longest, -1)
    past = F.collect_list(F.when(~F.col("planned"), F.struct(F.col("adjusted").alias("v"), F.col("event").alias("e")))).over(w)
    df = df.withColumn("_past", past).withColumn("_n", window_length())
    other = F.filter("_past", lambda b: b["e"].isNull() | (b["e"] != F.col("event")))
    df = df.withColumn("_v", F.when(F.col("event").isNull(), F.col("_past")).otherwise(other))
    df = df.withColumn("_v", F.slice("_v", F.greatest(F.size("_v") - F.col("_n") + 1, F.lit(1)), F.col("_n")))
    df = df.withColumn("_v", F.transform("_v", lambda b: b["v"]))
    df = df.withColumn("n_base", F.size("_v"))
    full = F.col("n_base") == F.col("_n")
    df = df.withColumn("median", F.when(full, array_median(F.col("_v"))))
    df = df.withColumn("mad", F.when(full, array_median(F.transform("_v", lambda x: F.abs(x - F.col("median"))))))
    z = F.when(F.col("mad") > 0, (F.col("adjusted") - F.col("median")) / (MAD_SCALE * F.col("mad")))
    return df.withColumn("z", F.round(z, 6)).drop("_past", "_v", "_n")


def not_judged(df: DataFrame, complete: DataFrame, holidays: list[str]) -> DataFrame:
    """Adds ``judged`` with incomplete months, holidays (daily) and the fading tail taken out."""
    usual = df.groupBy(*KEY).agg(F.expr("percentile(value, 0.5)").alias("usual"))
    df = df.join(usual, KEY)
    later = Window.partitionBy(*KEY).orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    tail = F.col("series").isin(*COUNTS) & (F.max(F.col("value") / F.nullif("usual", F.lit(0.0))).over(later) < 0.5)
    ym = (F.year("d") * 100 + F.month("d")).alias("ym")
    df = df.withColumn("tail", F.coalesce(tail, F.lit(False))).withColumn("ym", ym).join(complete, "ym", "left")
    off = (F.col("grain") == "daily") & F.date_format("d", "MM-dd").isin(*holidays)
    judged = ~F.col("tail") & F.coalesce("is_complete", F.lit(True)) & ~off
    return df.withColumn("judged", judged).drop("usual", "ym", "is_complete")


def severity(df: DataFrame) -> DataFrame:
    """Adds severity (ok, anomaly, critical, none), bad (in the KPI's bad direction) and flagged."""
    z = F.abs("z")
    sev = F.when(F.col("z").isNull() | ~F.col("judged"), "none").when(z >= CRITICAL, "critical").when(z > ANOMALY, "anomaly").otherwise("ok")
    sign = F.lit(0)
    for s, d in BAD_DIRECTION.items():
        sign = F.when(F.col("series") == s, d).otherwise(sign)
    return (
        df.withColumn("severity", sev)
        .withColumn("bad", F.coalesce(F.signum("z") == sign, F.lit(False)))
        .withColumn("flagged", F.col("severity").isin("anomaly", "critical") & F.col("bad") & ~F.col("suppressed"))
    )


def episodes(df: DataFrame) -> DataFrame:
    """Consecutive flagged periods are one episode; it is sent when critical or on its second period."""
    w = Window.partitionBy(*KEY).orderBy("d")
    was = F.coalesce(F.lag("flagged").over(w), F.lit(False))
    df = df.withColumn("_start", (F.col("flagged") & ~was).cast("int"))
    df = df.withColumn("episode", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("flagged")
    known = F.when(F.col("grain") == "weekly", F.date_add("d", 6)).otherwise(F.col("d"))
    pos = F.row_number().over(Window.partitionBy(*KEY, "episode").orderBy("d"))
    df = df.withColumn("_due", F.when((F.col("severity") == "critical") | (pos >= 2), known))
    peak = F.max_by(F.struct("value", "median", "factor", "z"), F.struct(F.abs("z"), F.col("d")))
    return (
        df.groupBy(*KEY, "grain", "episode")
        .agg(
            F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count("*").alias("periods"), peak.alias("p"),
            F.min("_due").alias("sent"), F.bool_or(F.col("severity") == "critical").alias("is_critical"),
            F.min("near_event").alias("near_event"),
        )
        .select(*KEY, "grain", "episode", "first_d", "last_d", "periods", "sent", "is_critical", "near_event",
                F.col("p.value").alias("value"), (F.col("p.median") * F.col("p.factor")).alias("expected"), F.col("p.z").alias("z"))
    )


def shuffled(df: DataFrame) -> DataFrame:
    """The same values on other periods (order of the hash of the date): noise with a known spread, no trend, no events."""
    by_day = Window.partitionBy(*KEY).orderBy("d")
    by_hash = Window.partitionBy(*KEY).orderBy(F.md5(F.col("d").cast("string")))
    place = df.select(*KEY, "grain", "d", F.row_number().over(by_day).alias("_i"))
    values = df.select(*KEY, "value", F.row_number().over(by_hash).alias("_i"))
    return place.join(values, [*KEY, "_i"]).drop("_i")


def judge(series: DataFrame, events: list[Event], complete: DataFrame, holidays: list[str]) -> DataFrame:
    s = with_events(weekday_factor(series), events)
    return severity(not_judged(robust_z(s, events), complete, holidays))


def detect(daily: DataFrame, events: list[Event], complete: DataFrame, holidays: list[str], floor: float = WEEKLY_UNDER) -> DataFrame:
    """The whole judgement, one row per series, region and period."""
    return judge(choose_grain(daily, floor), events, complete, holidays)


def alerts(judged: DataFrame) -> DataFrame:
    return episodes(judged).filter("sent IS NOT NULL")


def recipients(found: DataFrame, users: DataFrame) -> DataFrame:
    """(alert, user_name): who gets an alert.

    National: directors and analyst. Regional: its manager, and directors too
    when critical. A region without a manager falls back to directors and
    analyst. Sellers get none. ``users`` is configuration (user_name, role, region).
    """
    managed = users.filter("role = 'manager'").select("region").distinct().withColumn("_managed", F.lit(True))
    board = F.array(F.lit("director"), F.lit("analyst"))
    roles = F.when(F.col("region") == "ALL", board).when(
        F.col("_managed"), F.when(F.col("is_critical"), F.array(F.lit("manager"), F.lit("director"))).otherwise(F.array(F.lit("manager")))
    ).otherwise(board)
    asked = found.join(F.broadcast(managed), "region", "left").withColumn("role", F.explode(roles))
    people = users.select("user_name", "role", F.col("region").alias("_of"))
    sent = asked.join(F.broadcast(people), "role").filter((F.col("role") != "manager") | (F.col("_of") == F.col("region")))
    return sent.select(*found.columns, "user_name")


def impact(judged: DataFrame, events: list[Event]) -> DataFrame:
    """Actual against expected (median times weekday factor) over each event's periods, whole company."""
    out = None
    for e in events:
        part = judged.filter((F.col("region") == "ALL") & touches(e) & F.col("median").isNotNull()).groupBy("series").agg(
            F.count("*").alias("periods"), F.round(F.sum("value"), 4).alias("actual"),
            F.round(F.sum(F.col("median") * F.col("factor")), 4).alias("expected"),
        ).select(F.lit(e.name).alias("event"), "series", "periods", "actual", "expected")
        out = part if out is None else out.unionByName(part)
    change = F.round((F.col("actual") - F.col("expected")) / F.when(F.col("expected") != 0, F.col("expected")), 4)
    return out.withColumn("change", change)


def lead_times(found: DataFrame, leading: tuple[str, ...], lagging: str, within: int = 28) -> DataFrame:
    """(region, lagging, leading, lead_days): each late alert with the first early one of its region in the days before.

    Alerts without an early one have no lead. Early alerts go to the weeks they
    can matter for, so the join has an equi key in time too.
    """
    week = lambda c: F.floor(F.unix_date(c) / within)
    early = found.filter(F.col("series").isin(*leading)).select("region", F.col("sent").alias("leading"))
    early = early.withColumn("w", F.explode(F.array(week("leading"), week("leading") + 1)))
    late = found.filter(F.col("series") == lagging).select("region", F.col("sent").alias("lagging")).distinct()
    both = late.withColumn("w", week("lagging")).join(early, ["region", "w"])
    first = both.filter((F.col("leading") <= F.col("lagging")) & (F.col("leading") >= F.date_sub("lagging", within))).groupBy("region", "lagging").agg(F.min("leading").alias("leading"))
    return late.join(first, ["region", "lagging"], "left").withColumn("lead_days", F.datediff("lagging", "leading"))


def late_cost(judged: DataFrame, events: list[Event]) -> DataFrame:
    """Late deliveries of each event against what the judged baseline expected of as many deliveries.

    (event, periods, deliveries, actual_late, expected_late, extra_late, spread):
    expected are the deliveries of the period times one minus the usual on-time
    share; the spread is that of the baseline (scaled MAD) over the periods, taken
    as independent.
    """
    rows, out = judged.filter((F.col("series") == "on_time") & (F.col("region") == "ALL") & F.col("median").isNotNull()), None
    usual = F.col("median") * F.col("factor")
    actual, expected = F.sum(F.col("den") * (1 - F.col("value"))), F.sum(F.col("den") * (1 - usual))
    for e in events:
        part = rows.filter(touches(e)).agg(
            F.count("*").alias("periods"), F.sum("den").alias("deliveries"), F.round(actual, 4).alias("actual_late"), F.round(expected, 4).alias("expected_late"),
            F.round(actual - expected, 4).alias("extra_late"), F.round(F.sqrt(F.sum(F.pow(F.col("den") * MAD_SCALE * F.col("mad"), F.lit(2.0)))), 4).alias("spread"),
        ).select(F.lit(e.name).alias("event"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def rating_change(reviews: DataFrame, events: list[Event]) -> DataFrame:
    """(event, rating_before, rating_during) of the orders bought in an event and in as many days before it; one pass."""
    day, aggs = F.col("purchase_date"), []
    for i, e in enumerate(events):
        length = (e.end - e.start).days + 1
        during = day.between(F.lit(e.start), F.lit(e.end))
        before = (day >= F.date_sub(F.lit(e.start), length)) & (day < F.lit(e.start))
        aggs += [ratio(F.sum(F.when(w, F.col("score"))), F.count_if(w)).alias(f"{n}{i}") for n, w in (("b", before), ("d", during))]
    one = reviews.agg(*aggs)
    each = F.array(*[F.struct(F.lit(e.name).alias("event"), F.col(f"b{i}").alias("rating_before"), F.col(f"d{i}").alias("rating_during")) for i, e in enumerate(events)])
    return one.select(F.inline(each))


def covered_counts(intervals: DataFrame, keys: list[str], asked: DataFrame) -> DataFrame:
    """How many intervals [start, stop) of a key cover each asked day: (keys, day, n).

    Each interval is +1 on its first day and -1 on the day it stops (none while
    open). The changes are summed per day before the running total, so the
    running total sees calendar days, not intervals, and nothing is paired.
    """
    ok = intervals.filter(F.col("start").isNotNull() & (F.col("stop").isNull() | (F.col("stop") > F.col("start"))))
    change = ok.select(*keys, F.explode(F.array(
        F.struct(F.col("start").alias("day"), F.lit(1).alias("_d")), F.struct(F.col("stop").alias("day"), F.lit(-1).alias("_d"))
    )).alias("_c")).select(*keys, "_c.day", "_c._d").filter("day IS NOT NULL").groupBy(*keys, "day").agg(F.sum("_d").alias("_d"))
    marks = change.withColumn("_asked", F.lit(False)).unionByName(
        asked.select(*keys, "day").distinct().select(*keys, "day", F.lit(0).cast("bigint").alias("_d"), F.lit(True).alias("_asked"))
    ).groupBy(*keys, "day").agg(F.sum("_d").alias("_d"), F.bool_or("_asked").alias("_asked"))
    total = F.sum("_d").over(Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("n", total).filter("_asked").select(*keys, "day", "n")
