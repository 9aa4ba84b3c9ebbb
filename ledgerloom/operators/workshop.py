"""Made-to-order metrics: close rate, stage pace, margin, late-order estimate and its backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import dbl, ratio

# Fixed values of the method.
RECENT_DAYS = 120
STALE_QUOTE_DAYS = 45
TIGHT_DAYS = 5
TYPICAL, SLOW = 0.5, 0.8
ROUTE = (1, 2, 3, 4, 5, 6, 7)


def close_rate() -> list[Column]:
    """Won over decided, by count and by money; open quotes do not count."""
    won, decided = F.col("status") == "F", F.col("status").isin("F", "P")
    return [
        F.count_if(decided).alias("decided"),
        ratio(F.count_if(won), F.count_if(decided)).alias("rate_count"),
        ratio(F.sum(F.when(won, F.col("total"))), F.sum(F.when(decided, F.col("total")))).alias("rate_money"),
    ]


def size_band(amount: str = "total") -> Column:
    return F.when(F.col(amount) < 100000, "small").when(F.col(amount) < 300000, "medium").otherwise("large")


def stage_observations(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """(stage, days, done): how long after the order each stage was done."""
    return (
        lines.join(orders.select("order_id", "purchase_date"), "order_id")
        .select(F.col("line_seq").alias("stage"), F.datediff("ship_date", "purchase_date").alias("days"), F.col("ship_date").alias("done"))
        .filter("days >= 0")
    )


def pace(obs: DataFrame, keys: list[str], shares: tuple[float, ...] = (TYPICAL,)) -> DataFrame:
    """Exact percentiles of days per key.

    Whole days have few distinct values, so they are counted first; the
    percentile then reads one row per distinct value, however many rows a stage has.
    """
    counted = obs.groupBy(*keys, "days").agg(F.count("*").alias("k"))
    cols = [F.expr(f"percentile(days, {s}D, k)").alias(n) for s, n in zip(shares, ("typical", "slow"))]
    return counted.groupBy(*keys).agg(*cols, F.sum("k").alias("n"))


def stage_dates(lines: DataFrame) -> DataFrame:
    """One row per order with the day each stage of the route was done (s1..s7)."""
    return lines.groupBy("order_id").agg(
        *[F.min(F.when(F.col("line_seq") == s, F.col("ship_date"))).alias(f"s{s}") for s in ROUTE], F.max("ship_date").alias("last_ship")
    )


def estimate(open_orders: DataFrame, as_of: Column) -> DataFrame:
    """Adds the stages left, the estimated finish and the reason text.

    A stage is done if its date is known by ``as_of``; later dates are not looked
    at. The rows carry the pace of each stage (p1..p7); where one that is left has
    none, there is no estimate, and ``no_pace`` counts such stages.
    """
    left = {s: F.col(f"s{s}").isNull() | (F.col(f"s{s}") > as_of) for s in ROUTE}
    days = sum((F.when(left[s], F.col(f"p{s}")).otherwise(F.lit(0.0)) for s in ROUTE[1:]), F.when(left[1], F.col("p1")).otherwise(F.lit(0.0)))
    no_pace = sum(((left[s] & F.col(f"p{s}").isNull()).cast("int") for s in ROUTE[1:]), (left[1] & F.col("p1").isNull()).cast("int"))
    n_left = sum((left[s].cast("int") for s in ROUTE[1:]), left[1].cast("int"))
    at = F.concat_ws(",", *[F.when(left[s], F.lit(str(s))) for s in ROUTE])
    out = open_orders.withColumn("no_pace", no_pace).withColumn("stages_left", n_left).withColumn("days_left", F.ceil(days).cast("int"))
    out = out.withColumn("estimated", F.date_add(as_of, F.col("days_left")))
    return out.withColumn("why", F.concat(F.lit("stages left: "), at, F.lit("; days at recent pace: "), F.coalesce(F.col("days_left").cast("string"), F.lit("unknown"))))


def wide_pace(obs: DataFrame, keys: list[str]) -> DataFrame:
    """The pace of each stage side by side (p1..p7) per as-of day."""
    p = pace(obs, [*keys, "stage"])
    return p.groupBy(*keys).agg(*[F.max(F.when(F.col("stage") == s, F.col("typical"))).alias(f"p{s}") for s in ROUTE])


def risk_status(as_of: Column) -> Column:
    return (
        F.when(F.col("promised_date") < as_of, "overdue")
        .when(F.col("estimated") > F.col("promised_date"), "running late")
        .when(F.datediff("promised_date", "estimated") < TIGHT_DAYS, "tight")
        .otherwise("on time")
    )


def backtest(orders: DataFrame, lines: DataFrame, as_ofs: list, today: Column) -> DataFrame:
    """Estimate vs outcome on past days, each using only what was known that day.

    The orders of a day are those placed by then and not finished then, whatever
    became of them: one that was finished later is late by its finish, one that is
    still open by ``today``, and one that was cancelled never.

    Every order and every stage observation meets only the as-of days it belongs
    to, so all days run in one grouped job.
    """
    days = F.array(*[F.lit(d).cast("date") for d in as_ofs])
    obs = stage_observations(lines, orders).withColumn("as_of", F.explode(F.filter(days, lambda d: (F.col("done") <= d) & (F.col("done") > F.date_sub(d, RECENT_DAYS)))))
    paces = wide_pace(obs, ["as_of"])
    known = orders.join(stage_dates(lines), "order_id", "left")
    open_on = lambda d: (F.col("purchase_date") <= d) & (F.col("last_ship").isNull() | (F.col("last_ship") > d))
    live = known.withColumn("as_of", F.explode(F.filter(days, open_on)))
    # One row per as-of day: the list of days bounds it.
    judged = estimate(live.join(F.broadcast(paces), "as_of"), F.col("as_of"))
    finished = F.when(F.col("status") == "F", F.col("last_ship"))
    late = F.when(F.col("status") == "P", F.lit(False)).otherwise(F.coalesce(finished, today) > F.col("promised_date"))
    return judged.withColumn("flagged", F.coalesce(F.col("estimated") > F.col("promised_date"), F.lit(False))).withColumn(
        "late", late).withColumn("error_days", F.abs(F.datediff("estimated", finished)))


def costed(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Adds the material cost of each piece; NULL where no cost was loaded (never 0)."""
    material = F.round(F.col("list_price") * F.col("quantity").cast("decimal(12,2)") * F.lit("0.6").cast("decimal(4,2)"), 2).cast("decimal(14,2)")
    return lines.join(products, "product_id").withColumn("material", F.when(F.col("product_id") % 10 != 0, material))


def spread(pieces: DataFrame, order_cost: Column) -> DataFrame:
    """Order-level cost shared over the order's pieces by price; the totals are joined back, not windowed."""
    totals = pieces.groupBy("order_id").agg(F.sum("price").alias("order_price"))
    share = order_cost * dbl("price") / F.when(F.col("order_price") != 0, dbl("order_price"))
    return pieces.join(totals, "order_id").withColumn("transport", F.round(share, 2))
