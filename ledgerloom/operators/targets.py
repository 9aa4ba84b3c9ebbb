"""Run-rate sales targets, planned uplift, attainment and the verdict per month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import dbl, ratio
from .kpi import month_index

GROWTH_PERCENT = 105  # fixed value: the target is the recent pace plus 5 %
FLOOR_ORDERS = 30  # fixed value: under 30 orders a month is not judged


def monthly(sales: DataFrame, complete: DataFrame, uplift: dict[int, float]) -> DataFrame:
    """Adds completeness and the base (sales without the planned uplift) to (region, ym, sales)."""
    factor = F.lit(1000)
    for ym, u in uplift.items():
        factor = F.when(F.col("ym") == ym, F.lit(round(u * 1000))).otherwise(factor)
    cents = F.round(F.col("sales") * 100).cast("decimal(28,0)")
    return (
        sales.join(complete, "ym", "left")
        .withColumn("is_complete", F.coalesce("is_complete", F.lit(False)))
        .withColumn("uplift", factor)
        .withColumn("_c", cents)
        # Whole cents, rounded half up: the same result on every engine.
        .withColumn("base", (F.expr("(_c * 2000 + uplift) div (2 * uplift)").cast("decimal(20,0)") / 100).cast("decimal(20,2)"))
        .withColumn("mi", month_index())
        .drop("_c")
    )


def run_rate(months: DataFrame, overrides: DataFrame) -> DataFrame:
    """(region, ym, target): mean of the three months before, plus growth; explicit overrides win.

    Each month hands its base to the three months after it, so one grouping
    replaces a window and gaps in the calendar give no target.
    """
    given = months.select("region", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ahead"), "mi", "base", "is_complete")
    past = given.groupBy("region", (F.col("mi") + F.col("ahead")).alias("mi")).agg(
        F.sum("base").alias("s"), F.count("*").alias("n"), F.bool_and("is_complete").alias("ok")
    )
    derived = (
        months.join(past, ["region", "mi"])
        .filter((F.col("n") == 3) & F.col("ok") & F.col("is_complete"))
        .withColumn("_c", (F.col("s") * 100).cast("decimal(28,0)"))
        .select("region", "ym", (F.expr(f"(_c * {2 * GROWTH_PERCENT} * uplift + 300000) div 600000").cast("double") / 100).alias("derived"))
    )
    out = derived.join(F.broadcast(overrides), ["region", "ym"], "full_outer")
    return out.select("region", "ym", F.coalesce("override", "derived").alias("target"))


def month_span(ym: Column) -> tuple[Column, Column]:
    first = F.make_date(F.floor(ym / 100).cast("int"), (ym % 100).cast("int"), F.lit(1))
    return first, F.last_day(first)


def prorated(targets: DataFrame, start: str, end: str) -> DataFrame:
    """Target of each month for the days of it that lie in [start, end]."""
    first, last = month_span(F.col("ym"))
    lo, hi = F.greatest(first, F.lit(start).cast("date")), F.least(last, F.lit(end).cast("date"))
    days = F.datediff(hi, lo) + 1
    return targets.withColumn("days", days).filter("days > 0").withColumn(
        "due", F.col("target") * F.col("days") / (F.datediff(last, first) + 1)
    )


def attainment(daily: DataFrame, targets: DataFrame, start: str, end: str) -> DataFrame:
    """Per region: sales on days with a target over the target of those days."""
    due = prorated(targets, start, end)
    sold = (
        daily.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy("region", "ym")
        .agg(F.sum("sales").alias("sales"))
    )
    return (
        due.join(sold, ["region", "ym"], "left")
        .groupBy("region")
        .agg(dbl(F.sum("sales")).alias("sales"), F.round(F.sum("due"), 2).alias("target_sales"))
        .withColumn("attainment", ratio("sales", "target_sales", 4))
    )


def verdict(value: Column, target: float, n_orders: Column, better: str = "up") -> Column:
    good = value >= target if better == "up" else value <= target
    return (
        F.when(n_orders < FLOOR_ORDERS, "not judged").when(value.isNull(), "no value").when(good, "pass").otherwise("fail")
    )
