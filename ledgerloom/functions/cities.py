"""Cleaning of hand-typed city names, in three ordered rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

MIN_SIMILARITY = 0.9


def cut(city, codes: list[str]) -> Column:
    """Rule 1: drop what follows ``/``, ``,``, `` - `` or ``(``, then a trailing state code."""
    c = F.col(city) if isinstance(city, str) else city
    c = F.trim(F.regexp_replace(F.lower(c), r"(/|,| - |\().*$", ""))
    return F.trim(F.regexp_replace(c, rf"\s+({'|'.join(codes)})$", ""))


def not_a_city(city, state_name, codes: list[str]) -> Column:
    """Rule 2 test: a pure number, an e-mail address, a state code or the row's own state name."""
    c = F.col(city)
    return c.rlike(r"^[0-9]+$") | c.contains("@") | c.isin(*codes) | (c == F.lower(F.col(state_name)))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with the common-prefix bonus (prefix up to 4, weight 0.1, from 0.7 on)."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used = [False] * lb
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(lb) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def usual_city(geo: DataFrame) -> DataFrame:
    """The most common city of each ZIP; ties go to the first name."""
    n = geo.groupBy("zip", "city").agg(F.count("*").alias("n"))
    best = F.min_by("city", F.struct(-F.col("n"), F.col("city")))
    return n.groupBy("zip").agg(best.alias("zip_city"))


def clean(df: DataFrame, geo: DataFrame, codes: list[str]) -> DataFrame:
    """Adds ``city_clean`` and ``rule`` to rows with (city, zip, state).

    ``geo`` holds (zip, city, state). The similarity function runs only on the
    distinct pairs that rules 1 and 2 leave open.
    """
    known = geo.select("city", "state").distinct().withColumn("is_known", F.lit(True))
    first = df.withColumn("_c1", cut("city", codes)).join(usual_city(geo), "zip", "left")
    first = first.join(known.withColumnRenamed("city", "_c1"), ["_c1", "state"], "left").withColumn(
        "is_known", F.coalesce("is_known", F.lit(False))
    )
    junk = not_a_city("_c1", "state", codes) & ~F.col("is_known") & F.col("zip_city").isNotNull()
    second = first.withColumn("_junk", junk)
    open_pairs = (
        second.filter(~F.col("_junk") & ~F.col("is_known") & F.col("zip_city").isNotNull())
        .select("_c1", "zip_city")
        .distinct()
    )
    alike = open_pairs.withColumn("_sim", similarity("_c1", "zip_city")).filter(F.col("_sim") >= MIN_SIMILARITY)
    third = second.join(alike, ["_c1", "zip_city"], "left")
    return third.select(
        *df.columns,
        F.when(F.col("_junk") | F.col("_sim").isNotNull(), F.col("zip_city")).otherwise(F.col("_c1")).alias("city_clean"),
        F.when(F.col("_junk"), "not a city")
        .when(F.col("_sim").isNotNull(), "typo")
        .when(F.col("_c1") != F.lower("city"), "cut")
        .otherwise("kept")
        .alias("rule"),
    )
