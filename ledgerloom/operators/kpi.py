"""The declared KPI registry and the one engine that evaluates it.

A KPI is a numerator and, for ratios, a denominator; both are aggregates over
one wide dataset. Ratios are sum over sum of the selected rows, never a mean of
means. All KPIs of a dataset come out of one ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import dbl, ratio
from ..sources import domain
from ..sources.tables import Tables


@dataclass(frozen=True)
class Kpi:
    name: str
    dataset: str
    num: str
    den: str | None = None
    unit: str = "count"
    better: str = "up"
    target: float | None = None


REGISTRY: dict[str, Kpi] = {
    k.name: k
    for k in [
        Kpi("sales", "sales", "sum(CASE WHEN status <> 'P' THEN price END)", unit="money"),
        Kpi("ticket", "sales", "sum(CASE WHEN status <> 'P' THEN price END)",
            "count(DISTINCT CASE WHEN status <> 'P' THEN order_id END)", unit="money"),
        Kpi("freight_share", "sales", "sum(CASE WHEN status <> 'P' THEN freight END)",
            "sum(CASE WHEN status <> 'P' THEN price END)", unit="share", better="down", target=0.20),
        Kpi("active_sellers", "sales", "count(DISTINCT CASE WHEN status <> 'P' THEN seller_id END)"),
        Kpi("orders", "orders", "count_if(status <> 'P')"),
        Kpi("on_time", "orders", "count_if(on_time)", "count(delivered_date)", unit="share", target=0.90),
        Kpi("delivery_days", "orders", "sum(delivery_days)", "count(delivery_days)", unit="days", better="down"),
        Kpi("cancel_rate", "orders", "count_if(status = 'P')", "count(*)", unit="share", better="down", target=0.02),
        Kpi("customers", "customers", "count(*)"),
        Kpi("repurchase", "customers", "count_if(n_orders >= 2)", "count(*)", unit="share"),
        Kpi("rating", "reviews", "sum(score)", "count(score)", unit="score", target=4.0),
        Kpi("negative_reviews", "reviews", "count_if(score <= 2)", "count(score)", unit="share", better="down",
            target=0.15),
    ]
}


def datasets(t: Tables, dims: tuple[str, ...] = ("customer",)) -> dict[str, Callable[[], DataFrame]]:
    """The wide datasets, each built only when a KPI needs it."""
    return {
        "sales": lambda: domain.v_sales(t, dims),
        "orders": lambda: domain.v_orders(t, tuple(d for d in dims if d == "customer")),
        "reviews": lambda: domain.v_reviews(t, tuple(d for d in dims if d == "customer")),
    }


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """``{column: value | list | (from, to)}``; a tuple is an inclusive range. An unknown column raises."""
    for c, want in (filters or {}).items():
        if c not in df.columns:
            raise ValueError(f"cannot filter by {c}: the data has {', '.join(df.columns)}")
        if isinstance(want, tuple):
            lo, hi = want
            df = df.filter(F.col(c).between(F.lit(lo).cast(df.schema[c].dataType), F.lit(hi).cast(df.schema[c].dataType)))
        elif isinstance(want, (list, set)):
            df = df.filter(F.col(c).isin(*want))
        else:
            df = df.filter(F.col(c) == want)
    return df


def value(k: Kpi) -> Column:
    num = F.expr(k.num)
    return (ratio(num, F.expr(k.den)) if k.den else F.round(dbl(num), 6)).alias(k.name)


def customer_counts(orders: DataFrame, by: list[str]) -> DataFrame:
    """One row per cut and customer with the number of orders that count."""
    return orders.filter(F.col("status") != "P").groupBy(*by, "customer_id").agg(F.count("*").alias("n_orders"))


def evaluate_wide(df: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """KPIs of one dataset side by side."""
    return df.groupBy(*by).agg(*[value(REGISTRY[n]) for n in names])


def kpis(
    rel: dict[str, Callable[[], DataFrame]],
    names: list[str] | None = None,
    by: list[str] = (),
    filters: dict | None = None,
) -> DataFrame:
    """Long table (cuts, kpi, value, target, met).

    Filters and cuts that only order lines have (category, seller, product) reach
    the KPIs of orders, customers and reviews over their lines: an order counts if
    a line of it matches, and under each value of a cut that one of its lines has.
    What no dataset has raises; nothing is left out or ignored.
    """
    by, filters = list(by), dict(filters or {})
    wanted = [REGISTRY[n] for n in (names or REGISTRY)]
    out = None
    for ds in dict.fromkeys(k.dataset for k in wanted):
        ready = ds in rel  # per-customer counts may be there already
        base = rel[ds if ready else "orders"]()
        base = _reach_lines(base, rel, by, filters)
        if ds == "customers" and not ready:
            base = customer_counts(base, by)
        group = [k.name for k in wanted if k.dataset == ds]
        wide = evaluate_wide(base, group, by)
        long = wide.unpivot(by, group, "kpi", "value")
        out = long if out is None else out.unionByName(long)
    return judge(out)


def _reach_lines(base: DataFrame, rel: dict[str, Callable[[], DataFrame]], by: list[str], filters: dict) -> DataFrame:
    """``base`` filtered, with the cuts it lacks from the lines of its orders (one row per order and cut value)."""
    own = {c: v for c, v in filters.items() if c in base.columns}
    from_lines = {c: v for c, v in filters.items() if c not in own}
    cuts = [c for c in by if c not in base.columns]
    base = apply_filters(base, own)
    if not from_lines and not cuts:
        return base
    if "order_id" not in base.columns or "sales" not in rel:
        raise ValueError(f"cannot filter or cut by {', '.join([*from_lines, *cuts])} here")
    lines = apply_filters(rel["sales"](), from_lines)
    missing = [c for c in cuts if c not in lines.columns]
    if missing:
        raise ValueError(f"cannot cut by {', '.join(missing)}")
    return base.join(lines.select("order_id", *cuts).distinct(), "order_id")


#: Type of the stored sums: whole counts, days and scores, or cents.
PART = "decimal(38,2)"


def parts(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Numerator and denominator of KPIs per ``keys``: (keys, kpi, num, den).

    They may be added up over keys of which a counted thing has one only: an order
    has one region and one month, so distinct orders add up over these.
    """
    of = [F.struct(F.lit(n).alias("kpi"), F.expr(REGISTRY[n].num).cast(PART).alias("num"),
                   F.expr(REGISTRY[n].den or "NULL").cast(PART).alias("den")) for n in names]
    return df.groupBy(*keys).agg(F.array(*of).alias("_parts")).select(*keys, F.inline("_parts"))


def evaluate_parts(df: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """KPIs side by side from stored ``parts``; equal to ``evaluate_wide`` on the rows behind them."""
    def of(n: str) -> Column:
        num, den = (F.sum(F.when(F.col("kpi") == n, F.col(c))) for c in ("num", "den"))
        if REGISTRY[n].den:
            return ratio(num, den).alias(n)
        return F.round(dbl(F.coalesce(num, F.lit(0)) if REGISTRY[n].unit == "count" else num), 6).alias(n)

    return df.groupBy(*by).agg(*[of(n) for n in names])


def judge(df: DataFrame) -> DataFrame:
    """Adds the target and whether it is met, missed or absent."""
    goal, met = F.lit(None).cast("double"), F.lit("no target")
    for k in REGISTRY.values():
        if k.target is None:
            continue
        here = F.col("kpi") == k.name
        goal = F.when(here, F.lit(k.target)).otherwise(goal)
        good = F.col("value") >= k.target if k.better == "up" else F.col("value") <= k.target
        met = F.when(here, F.when(good, "met").otherwise("missed")).otherwise(met)
    return df.withColumn("target", goal).withColumn("met", met)


def change(df: DataFrame, keys: list[str], period: str, value_col: str, lags: dict[str, int]) -> DataFrame:
    """Relative change against earlier periods (``period`` a month number without gaps).

    The comparison is a join on the shifted period, so a missing month gives
    NULL and not the month before it. Input is one row per key and period.
    """
    out = df
    for name, n in lags.items():
        past = df.select(*keys, (F.col(period) + n).alias(period), F.col(value_col).alias("_past"))
        out = out.join(past, [*keys, period], "left").withColumn(
            name, F.round((dbl(value_col) - dbl("_past")) / F.when(dbl("_past") != 0, dbl("_past")), 6)
        ).drop("_past")
    return out


def month_index(ym: str = "ym") -> Column:
    """Months counted from year 0, so that differences are month distances."""
    return (F.floor(F.col(ym) / 100) * 12 + F.col(ym) % 100 - 1).cast("int")
