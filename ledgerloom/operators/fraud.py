"""Explainable fraud scoring, common point of compromise and complaint triage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import great_circle_km
from ..functions.money import dbl, ratio
from ..session import literals
from .ordered import OrderedScan, rolling

HOUR = 3_600_000_000
DAY = 24 * HOUR


@dataclass(frozen=True)
class Params:
    """Cut-offs and weights are ours; none is published for this kind of score."""

    speed_kmh: float = 900.0
    small: int = 500  # cents: a card-testing charge
    large: int = 10_000
    tests: int = 2
    night: tuple[int, int] = (0, 5)
    risky_categories: tuple[int, ...] = (3,)
    home_country: str = "MX"
    monthly_share: float = 0.5
    balance_share: float = 0.8
    compromise_days: float = 30.0
    block: int = 60
    review: int = 30
    complaint_days: int = 45


WEIGHTS = {
    "impossible travel": 35, "card testing": 30, "new city": 10, "new device": 15, "new beneficiary": 15,
    "night": 5, "risky category": 10, "foreign ip": 15, "high for the month": 20, "drains the balance": 25,
}


def place(city: Column) -> tuple[Column, Column]:
    """Coordinates of a city number (a rule, so that no coordinate table is needed)."""
    return F.lit(15.0) + city * 1.5, F.lit(-115.0) + city * 2.3


def first_seen(df: DataFrame, col: str, out: str) -> DataFrame:
    """``out`` is true where this customer shows ``col`` for the first time.

    The first (time, id) of each value comes from an aggregation that is combined
    before the shuffle, then is joined back.
    """
    first = df.groupBy("customer", col).agg(F.min(F.struct("us", "op_id")).alias("_f"))
    return df.join(first, ["customer", col]).withColumn(out, F.col("_f.op_id") == F.col("op_id")).drop("_f")


def too_fast(other: str, p: Params) -> Column:
    """Is the place of an operation too far from that of ``other`` (us, city) for the time between them?"""
    lat1, lon1 = place(F.col("city"))
    lat2, lon2 = place(F.col(f"{other}.city"))
    hours = F.abs(F.col("us") - F.col(f"{other}.us")) / HOUR
    return F.coalesce(great_circle_km(lat1, lon1, lat2, lon2) > hours * p.speed_kmh, F.lit(False))


def travel(ops: DataFrame, p: Params, hot_rows: int | None = None) -> DataFrame:
    """Adds ``impossible``: too far from the card-present operation before or after it. Both sides are flagged."""
    here = F.when(F.col("card_present"), F.struct("us", "city"))
    scan = OrderedScan(ops, ["customer"], ["us", "op_id"], hot_rows)
    scan.running({"_b": ("last", here), "_n": ("count", "op_id"),
                  "_nights": ("sum", is_night(p).cast("int")), "_foreign": ("sum", (F.col("ip_country") != p.home_country).cast("int"))}, inclusive=False)
    scan.running({"_a": ("last", here)}, reverse=True, inclusive=False)

    out = scan.result()
    return (
        out.withColumn("impossible", F.col("card_present") & (too_fast("_b", p) | too_fast("_a", p)))
        .withColumn("n_before", F.coalesce("_n", F.lit(0)))
        .withColumn("nights_before", F.coalesce("_nights", F.lit(0)))
        .withColumn("foreign_before", F.coalesce("_foreign", F.lit(0)))
        .drop("_a", "_b", "_n", "_nights", "_foreign")
    )


def is_night(p: Params) -> Column:
    return F.hour("ts").between(*p.night)


def spending(ops: DataFrame, p: Params, hot_rows: int | None = None) -> DataFrame:
    """Adds small_24h (tiny online charges before), spend_24h (with this one) and spend_30d (before)."""
    ops = ops.withColumn("_small", F.when((F.col("channel") == "online") & (F.col("amount") <= p.small), 1).otherwise(0))
    frames = {"small_24h": ("_small", DAY, 1), "spend_24h": ("amount", DAY, 0), "spend_30d": ("amount", 30 * DAY, 1)}
    return rolling(ops, ["customer"], "us", "op_id", frames, hot_rows).drop("_small")


def features(ops: DataFrame, balances: DataFrame, p: Params = Params(), hot_rows: int | None = None) -> DataFrame:
    out = spending(travel(ops, p, hot_rows), p, hot_rows)
    for col, name in (("city", "new_city"), ("device", "new_device"), ("beneficiary", "new_beneficiary")):
        out = first_seen(out, col, name)
    return out.join(balances, "customer", "left")


def rules(p: Params = Params()) -> dict[str, Column]:
    known = F.col("n_before") > 0
    return {
        "impossible travel": F.col("impossible"),
        "card testing": (F.col("small_24h") >= p.tests) & (F.col("channel") == "online") & (F.col("amount") >= p.large),
        "new city": known & F.col("card_present") & F.col("new_city"),
        "new device": known & (F.col("channel") != "pos") & F.col("new_device"),
        "new beneficiary": known & (F.col("channel") == "transfer") & F.col("new_beneficiary"),
        "night": is_night(p) & (F.col("nights_before") * 4 < F.col("n_before")),
        "risky category": F.col("category").isin(*p.risky_categories),
        "foreign ip": (F.col("ip_country") != p.home_country) & (F.col("foreign_before") * 4 < F.col("n_before")),
        "high for the month": (F.col("spend_30d") > 0) & (F.col("amount") > F.col("spend_30d") * p.monthly_share),
        "drains the balance": F.coalesce(F.col("amount") > F.col("balance") * p.balance_share, F.lit(False)),
    }


def score(feats: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds score 0-100, the rules that fired and the level (block, review, pass)."""
    fired = rules(p)
    total = sum((F.when(c, WEIGHTS[n]).otherwise(0) for n, c in fired.items()), F.lit(0))
    out = feats.withColumn("score", F.least(F.lit(100), total).cast("int"))
    out = out.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fired.items()])))
    return out.withColumn("level", F.when(F.col("score") >= p.block, "block").when(F.col("score") >= p.review, "review").otherwise("pass"))


def threshold_report(scored: DataFrame, cuts: list[int]) -> DataFrame:
    """Precision, recall (operations and amount) and share flagged per cut, in one pass over the scores."""
    g = scored.groupBy("score").agg(
        F.count("*").alias("n"), F.count_if("is_fraud").alias("f"), F.sum(F.when(F.col("is_fraud"), F.col("amount")).otherwise(0)).alias("a"))
    at = g.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts]))).withColumn("hit", F.col("score") >= F.col("cut"))
    hit = lambda c: F.sum(F.when(F.col("hit"), F.col(c)).otherwise(0))
    return at.groupBy("cut").agg(
        hit("n").alias("flagged"), ratio(hit("f"), hit("n")).alias("precision"), ratio(hit("f"), F.sum("f")).alias("recall"),
        ratio(hit("a"), F.sum("a")).alias("recall_amount"), ratio(hit("n"), F.sum("n")).alias("share_flagged"))


def exposed_use(ops: DataFrame, fraud: Column, p: Params = Params(), hot_rows: int | None = None) -> DataFrame:
    """Adds ``before_fraud``: this customer had a confirmed fraud within the days after this use.

    Only the next fraud matters, so each use looks it up in one ordered pass
    instead of being paired with every fraud of the customer.
    """
    scan = OrderedScan(ops, ["customer"], ["us", "op_id"], hot_rows)
    scan.running({"_next": ("last", F.when(fraud, F.col("us")))}, reverse=True, inclusive=False)
    gap = F.col("_next") - F.col("us")
    return scan.result().withColumn("before_fraud", F.coalesce(gap <= F.lit(int(p.compromise_days * DAY)), F.lit(False))).drop("_next")


def compromise(uses: DataFrame, min_ratio: float, min_victims: int) -> DataFrame:
    """Per shop: victims among its customers against the base rate of all customers."""
    shop = uses.groupBy("shop", "customer").agg(F.bool_or("before_fraud").alias("v")).groupBy("shop").agg(
        F.count("*").alias("customers"), F.count_if("v").alias("victims"))
    base = uses.groupBy("customer").agg(F.bool_or("before_fraud").alias("v")).agg(
        F.count("*").alias("all_customers"), F.count_if("v").alias("all_victims"))
    out = shop.withColumns(literals(base))
    rate = F.col("victims") * F.col("all_customers") / (F.col("customers") * F.nullif(F.col("all_victims"), F.lit(0)))
    return out.select("shop", "customers", "victims", F.round(dbl(rate), 6).alias("times_base"),
                      F.coalesce((rate >= min_ratio) & (F.col("victims") >= min_victims), F.lit(False)).alias("compromised"))


def triage(complaints: DataFrame, scored: DataFrame, shops: DataFrame, p: Params = Params()) -> DataFrame:
    """Each complaint with the score of its operation, a decision and its deadline."""
    s = scored.select(F.col("op_id").alias("about"), "score", "shop").join(shops.select("shop", "compromised"), "shop", "left")
    out = complaints.join(s, "about", "left")
    decision = (
        F.when((F.col("score") >= p.block) | F.coalesce("compromised", F.lit(False)), "refund now")
        .when(F.col("score") >= p.review, "investigate").when(F.col("score").isNull(), "investigate").otherwise("possible friendly fraud"))
    return out.withColumn("decision", decision).withColumn("deadline", F.date_add("filed", p.complaint_days))
