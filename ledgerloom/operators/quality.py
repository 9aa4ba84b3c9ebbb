"""Quality checks, quarantine with cascade, reconciliation and the gated publish.

A check returns the rows it flags as (check_id, severity, row_key, detail). Its
severity says what happens: ``quarantine`` rows leave, the others stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import point_to, pointed_at
SEVERITIES = ("quarantine", "fixed", "warning", "informative", "guard")


@dataclass(frozen=True)
class Check:
    """A condition (SQL text) on one base relation; ``key`` and ``detail`` name the flagged row."""

    id: str
    severity: str
    base: str
    when: str
    key: str
    detail: str = "NULL"


def flagged(check: Check, base: DataFrame) -> DataFrame:
    """The rows a check flags: (row_key, detail)."""
    return base.filter(check.when).select(
        F.expr(check.key).cast("string").alias("row_key"), F.expr(check.detail).cast("string").alias("detail")
    )


def report(checks: list[Check], bases: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Rows per check. All checks of a base relation are counted in one pass over it."""
    severities = F.create_map(*[F.lit(x) for c in checks for x in (c.id, c.severity)])
    out = None
    for base in dict.fromkeys(c.base for c in checks):
        ids = [c.id for c in checks if c.base == base]
        wide = bases[base]().agg(*[F.count_if(F.expr(c.when)).alias(c.id) for c in checks if c.base == base])
        long = wide.unpivot([], ids, "check_id", "n")
        out = long if out is None else out.unionByName(long)
    return out.select("check_id", severities[F.col("check_id")].alias("severity"), "n")


def split_valid(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``: the messages of the rules a row breaks. ``rules`` maps message to "row is bad"."""
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(msg)) for msg, bad in rules.items()])))


def quarantine_reason() -> Column:
    return F.when((F.col("status") == "F") & F.col("last_ship").isNull(), "delivered without delivery date").when(
        (F.col("status") == "P") & F.col("has_delivered_line"), "cancelled with delivery date"
    )


def quarantine(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders that contradict themselves, with the reason."""
    facts = lines.groupBy("order_id").agg(
        F.max("ship_date").alias("last_ship"), F.bool_or(F.col("line_status") == "F").alias("has_delivered_line")
    )
    return (
        orders.join(facts, "order_id", "left")
        .withColumn("has_delivered_line", F.coalesce("has_delivered_line", F.lit(False)))
        .withColumn("reason", quarantine_reason())
        .filter("reason IS NOT NULL")
        .drop("last_ship", "has_delivered_line")
    )


def cascade(children: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, held): children follow their quarantined parent."""
    ids = held.select(key)
    return children.join(ids, key, "left_anti"), children.join(ids, key, "left_semi")


def reconcile(staging: DataFrame, marts: DataFrame, held: DataFrame, amount: str, name: str) -> DataFrame:
    """One row: rows and money of staging against marts plus quarantine, to the cent."""
    def part(df: DataFrame, sign: int, side: str):
        return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(30,2)").alias("m")).select(
            F.lit(side).alias("side"), F.lit(sign).alias("sign"), "n", "m"
        )
    parts = part(staging, 1, "staging").unionByName(part(marts, -1, "marts")).unionByName(part(held, -1, "quarantine"))
    return parts.groupBy().agg(
        F.lit(name).alias("fact"),
        *[F.sum(F.when(F.col("side") == s, F.col("n"))).alias(f"n_{s}") for s in ("staging", "marts", "quarantine")],
        *[F.sum(F.when(F.col("side") == s, F.col("m"))).alias(f"m_{s}") for s in ("staging", "marts", "quarantine")],
        ((F.sum(F.col("n") * F.col("sign")) == 0) & (F.sum(F.col("m") * F.col("sign")) == 0)).alias("balanced"),
    )


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` missing from ``b`` and the reverse, duplicates counted; empty when equal."""
    return (
        a.exceptAll(b).withColumn("side", F.lit("left"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    )


class PublishRefused(RuntimeError):
    """A check found rows; the published table stays as it was."""


def publish(df: DataFrame, table_dir: str, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> str:
    """Write aside, check what was written, then add a pointer to it.

    Each build goes to a folder of its own, so a failed or repeated load never
    mixes with what readers see; the pointer is one small file written last.
    """
    spark = df.sparkSession
    build = f"{table_dir}/build-{uuid.uuid4().hex}"
    df.write.parquet(build)
    written = spark.read.schema(df.schema).parquet(build)
    broken = [name for name, check in checks.items() if not check(written).isEmpty()]
    if broken:
        raise PublishRefused(", ".join(broken))
    point_to(spark, table_dir, build)
    return build


def published(spark, table_dir: str) -> DataFrame:
    return spark.read.parquet(pointed_at(spark, table_dir))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
