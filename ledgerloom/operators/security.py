"""Row and column security. Every metric and every row read starts from ``relation``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

IDENTIFYING = ("customer_id", "customer_name")
ORDER_TOTALS = ("total", "items_value", "freight_value", "n_sellers")


@dataclass(frozen=True)
class User:
    name: str
    role: str
    region: str | None = None
    seller_id: int | None = None


USERS = {
    u.name: u
    for u in [
        User("director", "director"),
        User("analyst", "analyst"),
        User("manager.asia", "manager", region="ASIA"),
        User("manager.europe", "manager", region="EUROPE"),
        User("seller.7", "seller", seller_id=7),
    ]
}


def rows_for(user: str, df: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Rows ``user`` may use, all columns: the base of metrics. An unknown user gets none.

    ``lines`` (order_id, seller_id) tells which orders hold a seller's lines; it
    is needed for datasets without a seller column.
    """
    u = USERS.get(user)
    if u is None:
        return df.filter(F.lit(False))
    if u.role in ("director", "analyst"):
        return df
    if u.role == "manager":
        return df.filter(F.col("region") == u.region)
    if "seller_id" in df.columns:
        return df.filter(F.col("seller_id") == u.seller_id)
    own = lines.filter(F.col("seller_id") == u.seller_id).select("order_id")
    return df.join(own, "order_id", "left_semi")


def relation(user: str, df: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Rows and columns ``user`` may read. Hidden columns are absent, not NULL."""
    u = USERS.get(user)
    df = rows_for(user, df, lines)
    if u is None or u.role == "seller":
        return df.drop(*ORDER_TOTALS, *IDENTIFYING)
    if u.role == "analyst":
        return df.drop(*IDENTIFYING)
    return df


# What each area of the workshop may read; a column not listed is not there.
AREA_COLUMNS = {
    "sales": ["order_id", "line_seq", "customer_id", "seller_id", "brand", "price", "status", "promised_date"],
    "shop": ["order_id", "line_seq", "brand", "line_status", "ship_date", "promised_date"],
    "administration": ["order_id", "line_seq", "brand", "price", "cost", "status"],
}


def area_view(area: str, df: DataFrame, seller_id: int | None = None) -> DataFrame:
    """Allow-list of columns per area; ``seller_id`` narrows sales to one seller's clients."""
    if area not in AREA_COLUMNS:
        return df.filter(F.lit(False)).select(*[])
    if seller_id is not None:
        df = df.filter(F.col("seller_id") == seller_id)
    return df.select(*[c for c in AREA_COLUMNS[area] if c in df.columns])


def seller_grain(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per (order, seller) without order totals, for per-seller row filters."""
    pairs = lines.groupBy("order_id", "seller_id").agg(
        F.count("*").alias("n_lines"), F.sum("price").alias("price"), F.sum("freight").alias("freight")
    )
    return pairs.join(orders.drop(*ORDER_TOTALS, "n_lines"), "order_id")


def permissions(users: list[User], spark) -> DataFrame:
    """(UserName, customer_region, seller_id); an empty cell means all."""
    rows = [(u.name, u.region or "", "" if u.seller_id is None else str(u.seller_id)) for u in users]
    return spark.createDataFrame(rows, "UserName string, customer_region string, seller_id string")
