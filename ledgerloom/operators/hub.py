"""Integration hub: canonical mapping, reconciliation of two systems, idempotent apply, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import dbl

RISK_CLASSES = ("missing invoice", "cancelled but invoiced", "double billing", "currency mismatch", "amount mismatch")
TOLERANCE = "0.01"  # one cent: what rounding may differ by; ours


def to_canonical(df: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    """Vendor fields to canonical names: ``{canonical: vendor column or expression}``."""
    return df.select([(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()])


def rate(currency: str, rates: dict[str, float]) -> Column:
    out = F.lit(None).cast("decimal(10,4)")
    for c, r in rates.items():
        out = F.when(F.col(currency) == c, F.lit(str(r)).cast("decimal(10,4)")).otherwise(out)
    return out


def reconcile(payments: DataFrame, invoices: DataFrame, rates: dict[str, float]) -> DataFrame:
    """One row per reference with its class, cause and money at risk in the base currency.

    payments (ref, amount, currency, cancelled); invoices (ref, document, amount,
    currency). Each side is brought to one row per reference before the join, so
    a reference with very many documents is combined before the shuffle.
    """
    base = lambda: F.round(F.col("amount") * rate("currency", rates), 2).cast("decimal(18,2)")
    pay = payments.withColumn("b", base()).groupBy("ref").agg(
        F.sum("b").alias("paid"), F.min("currency").alias("pay_ccy"), F.bool_or("cancelled").alias("cancelled"))
    inv = invoices.withColumn("b", base()).groupBy("ref", "document").agg(F.sum("b").alias("b"), F.min("currency").alias("c"), F.max("copies").alias("copies")).groupBy("ref").agg(
        F.sum("b").alias("billed"), F.min("c").alias("inv_ccy"), F.max("copies").alias("copies"))
    j = pay.join(inv, "ref", "full_outer")
    gap = F.abs(F.coalesce("paid", F.lit(0)) - F.coalesce("billed", F.lit(0)))
    kind = (
        F.when(F.col("billed").isNull() & ~F.col("cancelled"), "missing invoice")
        .when(F.col("billed").isNull(), "matched")
        .when(F.coalesce("cancelled", F.lit(True)), "cancelled but invoiced")
        .when(F.col("copies") > 1, "double billing")
        .when(F.col("pay_ccy") != F.col("inv_ccy"), "currency mismatch")
        .when(gap > F.lit(TOLERANCE).cast("decimal(18,2)"), "amount mismatch")
        .otherwise("matched"))
    out = j.withColumn("class", kind)
    risk = (
        F.when(F.col("class") == "missing invoice", F.col("paid")).when(F.col("class") == "cancelled but invoiced", F.col("billed"))
        .when(F.col("class") == "matched", F.lit(0)).otherwise(gap))
    cause = (
        F.when(F.col("class") == "missing invoice", "the event never reached accounting").when(F.col("class") == "cancelled but invoiced", "the cancellation was not passed on")
        .when(F.col("class") == "double billing", "the same delivery was applied twice").when(F.col("class") == "currency mismatch", "currency mapping differs")
        .when(F.col("class") == "amount mismatch", "edited on one side only").otherwise(""))
    return out.withColumn("at_risk", risk.cast("decimal(18,2)")).withColumn("cause", cause)


def apply_once(deliveries: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(applied, log): the first delivery per key is applied; the log counts the replays.

    The first one is picked by aggregation, so a key replayed very often is
    combined before the shuffle.
    """
    rest = [c for c in deliveries.columns if c != key]
    g = deliveries.groupBy(key).agg(
        F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("m"), F.count("*").alias("n"))
    applied = g.select(key, *[F.col(f"m.{c}").alias(c) for c in rest])
    return applied, g.select(key, (F.col("n") - 1).alias("duplicates"))


def upsert(target: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """The target after the batch: the newest version of each key, however often the batch is run."""
    both = target.unionByName(batch)
    rest = [c for c in target.columns if c not in (key, version)]
    pick = both.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("m"))
    return pick.select(*[key if c == key else F.col(f"m.{c}").alias(c) for c in target.columns])


def route(df: DataFrame, mapping: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(mapped, dead letters): rows without a mapping go to the dead-letter table with the reason."""
    dead = df.join(mapping, key, "left_anti").withColumn("reason", F.concat(F.lit(f"no mapping for {key} "), F.col(key).cast("string")))
    return df.join(mapping, key), dead
