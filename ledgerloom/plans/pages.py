"""The load that materialises the wide tables, and the report pages that read them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.money import dbl, ratio
from ..operators import anomalies as A, kpi as K, quality as Q, security as S, targets as G
from ..session import settle, shuffles_deleted
from ..sources import domain as D
from ..sources.tables import Tables
from . import alerts, kpis, quality
from .marts import Warehouse, audit, steps, wave
from .registry import query


def load(t: Tables, root: str) -> Warehouse:
    """staging, quality, star, wide tables, targets, anomalies, alerts.

    Readers see the new tables when all are written and the audit has passed.
    """
    w = Warehouse(t, root)
    with shuffles_deleted(t.spark):
        tables(w)
    w.release()
    return w


def tables(w: Warehouse) -> None:
    """Writes the tables of a load; these steps are ordered by what they read."""
    t = w.t
    wave(steps(w))
    so, ss = w.get("v_orders"), w.get("v_sales")
    complete = alerts.complete_months(t)
    at = D.ym("purchase_date")

    def seller_tables():
        # Lines go to their order once, for the sums and for the join.
        own = ss.select("order_id", "seller_id", "price").repartition("order_id").groupBy("order_id", "seller_id").agg(
            F.count("*").alias("n_lines"), F.sum("price").alias("price"))
        kept = D.order_rows(w.get("staging_orders")).drop(*S.ORDER_TOTALS, "n_lines")
        w.put("orders_by_seller", own.join(kept, "order_id"), True, ("seller_id",), at, lambda df: D.order_columns(t, df))

    def plan():
        w.put("agg_sales_daily", ss.filter("status <> 'P'").groupBy(F.col("purchase_date").alias("day"), "ym", "region", "category").agg(
            F.sum("price").alias("sales"), F.count("*").alias("n_lines"), F.sum("freight").alias("freight")))
        month = w.get("agg_sales_daily").groupBy("region", "ym").agg(F.sum("sales").alias("sales"))
        w.put("targets", G.run_rate(G.monthly(month, complete, alerts.UPLIFT), t.rows("region string, ym int, override double", alerts.OVERRIDES)))
        k = K.evaluate_wide(so, ["orders", "on_time"], ["ym", "region"])
        att = month.join(w.get("targets"), ["region", "ym"]).select("region", "ym", ratio("sales", "target", 4).alias("attainment"))
        w.put("verdicts", k.join(att, ["region", "ym"], "left").select(
            "ym", "region", "orders", "on_time", "attainment", G.verdict(F.col("on_time"), 0.9, F.col("orders")).alias("on_time_verdict"),
            G.verdict(F.col("attainment"), 0.9, F.col("orders")).alias("target_verdict")))

    def reviews():
        w.put("v_reviews", D.order_columns(t, D.latest_reviews(t).join(D.order_rows(w.get("staging_orders")), "order_id")))
        r = w.get("v_reviews")
        w.put("judged", A.detect(settle(alerts.daily_series(t, so, r.select("region", "review_ts", "score"))), alerts.EVENTS, complete, alerts.HOLIDAYS, alerts.FLOOR))
        w.put("alerts", A.alerts(w.get("judged")))

    wave({
        "audit": lambda: audit(w), "reviews": reviews, "plan": plan, "sellers": seller_tables,
        "weekly": lambda: w.put("agg_delivery_weekly", so.groupBy(F.date_trunc("week", "promised_date").cast("date").alias("week"), "region").agg(
            F.count("delivered_date").alias("delivered"), F.count_if("on_time").alias("on_time"))),
        "customers": lambda: w.put("customer_orders", K.customer_counts(so, ["region"])),
        "quality": lambda: w.put("quality_report", Q.report(quality.CHECKS, quality.bases(t))),
    })
    rs = w.get("v_reviews")

    def seller_parts():
        own = w.get("orders_by_seller").select("order_id", "seller_id")
        w.put("reviews_by_seller", own.join(rs.drop(*S.ORDER_TOTALS, "n_lines", *D.PROMISE, *D.DELIVERY), "order_id"), True, ("seller_id",), at,
              lambda df: D.with_delivery(D.with_promise(df)))
        own, key = w.get("orders_by_seller"), ["seller_id"]
        w.put("kpi_parts_by_seller", all_parts({"sales": ss, "orders": own, "reviews": w.get("reviews_by_seller"), "customers": K.customer_counts(own, key)}, key, NAMES).orderBy(*key))

    def region_parts():
        customers = w.get("customer_orders").withColumn("ym", F.lit(None).cast("int"))
        data = {"sales": ss, "orders": so, "reviews": rs, "customers": customers}
        w.put("kpi_parts", all_parts(data, ["region", "ym"], [n for n in NAMES if n != "active_sellers"]).coalesce(1))

    kept, by_seller = ss.filter("status <> 'P'"), w.get("orders_by_seller").filter("status <> 'P'")
    wave({
        "seller parts": seller_parts, "region parts": region_parts,
        "sellers": lambda: w.put("agg_sales_sellers", kept.groupBy("region", "seller_id").agg(F.sum("price").alias("sales"))),
        # Sent once, in the order of the files; a seller with very many lines is split by month.
        "sales by seller": lambda: w.put("agg_sales_by_seller", kept.select("seller_id", "ym", "region", "category", "price").repartitionByRange("seller_id", "ym").groupBy(
            "seller_id", "ym", "region", "category").agg(F.sum("price").alias("sales"), F.count("*").alias("n_lines")).sortWithinPartitions("seller_id")),
        # One row per order (and seller) is there already: counted, not told apart again among the lines.
        "payments by seller": lambda: w.put("agg_payments_by_seller", by_seller.groupBy("seller_id", "payment_type").agg(
            F.count("*").alias("orders"), F.sum("price").cast(SUM).alias("sales")).orderBy("seller_id")),
        "payments": lambda: w.put("agg_sales_payments", so.filter("status <> 'P' AND n_lines > 0").groupBy("region", "payment_type").agg(
            F.count("*").alias("orders"), F.sum("items_value").cast(SUM).alias("sales")).coalesce(1)),
        "delay": lambda: w.put("agg_delay", rs.filter("days_late IS NOT NULL").groupBy("region", F.expr(kpis.LATE_BUCKET).alias("bucket")).agg(
            F.count("*").alias("n"), F.sum("score").alias("score"), F.count("score").alias("scores")).coalesce(1)),
    })


NAMES = list(K.REGISTRY)
#: Type of a sum of cents of lines.
SUM = "decimal(22,2)"


def all_parts(data: dict[str, DataFrame], keys: list[str], names: list[str]) -> DataFrame:
    """The stored numerators and denominators of KPIs of several datasets."""
    each = [K.parts(df, [n for n in names if K.REGISTRY[n].dataset == ds], keys) for ds, df in data.items()]
    return reduce(DataFrame.unionByName, each)


def collect(parts: dict[str, DataFrame]) -> dict:
    """The small results of a page; its queries do not depend on each other and run side by side."""
    with ThreadPoolExecutor(len(parts)) as pool:
        jobs = {n: pool.submit(d.toPandas) for n, d in parts.items()}
        return {n: j.result() for n, j in jobs.items()}


def is_seller(user: str) -> bool:
    return user in S.USERS and S.USERS[user].role == "seller"


def rows(w: Warehouse, user: str, name: str) -> DataFrame:
    """Rows of a written table that ``user`` may use. Region and seller are columns of each, so security is a scan filter."""
    return S.rows_for(user, w.get(name))


def summary(w: Warehouse, user: str) -> dict[str, DataFrame]:
    if is_seller(user):
        wide = K.evaluate_parts(rows(w, user, "kpi_parts_by_seller"), NAMES)
        return {"kpis": K.judge(wide.unpivot([], NAMES, "kpi", "value")), "trend": K.evaluate_wide(rows(w, user, "v_sales"), ["sales"], ["ym"])}
    added = [n for n in NAMES if n != "active_sellers"]
    kept = rows(w, user, "kpi_parts")
    sellers = rows(w, user, "agg_sales_sellers").agg(dbl(F.count_distinct("seller_id")).alias("active_sellers"))
    long = K.evaluate_parts(kept, added).unpivot([], added, "kpi", "value").unionByName(sellers.unpivot([], ["active_sellers"], "kpi", "value"))
    return {
        "kpis": K.judge(long), "trend": K.evaluate_parts(kept.filter("kpi = 'sales'"), ["sales"], ["ym"]),
        "verdicts": rows(w, user, "verdicts").filter("on_time_verdict = 'fail' OR target_verdict = 'fail'"),
    }


def sales(w: Warehouse, user: str) -> dict[str, DataFrame]:
    if is_seller(user):
        daily, paid = rows(w, user, "agg_sales_by_seller"), rows(w, user, "agg_payments_by_seller")
        sellers = daily
    else:
        daily, sellers, paid = (rows(w, user, f"agg_sales_{n}") for n in ("daily", "sellers", "payments"))
    return {
        "months": daily.groupBy("ym", "region").agg(dbl(F.sum("sales")).alias("sales"), F.sum("n_lines").alias("n")),
        "categories": daily.groupBy("category").agg(dbl(F.sum("sales")).alias("sales")).orderBy(F.desc("sales"), "category").limit(10),
        "sellers": sellers.groupBy("seller_id").agg(dbl(F.sum("sales")).alias("sales")).orderBy(F.desc("sales"), "seller_id").limit(10),
        "payment": paid.groupBy("payment_type").agg(F.sum("orders").alias("orders"), dbl(F.sum("sales")).alias("sales")),
    }


def operations(w: Warehouse, user: str) -> dict[str, DataFrame]:
    names = ["orders", "on_time", "delivery_days", "cancel_rate"]
    if is_seller(user):
        o = rows(w, user, "orders_by_seller")
        regions, months = K.evaluate_wide(o, names, ["region"]), K.evaluate_wide(o, ["on_time"], ["ym"])
        late = rows(w, user, "reviews_by_seller").filter("days_late IS NOT NULL").select(
            F.expr(kpis.LATE_BUCKET).alias("bucket"), F.lit(1).alias("n"), "score", F.col("score").isNotNull().cast("int").alias("scores"))
    else:
        o = rows(w, user, "kpi_parts").filter(F.col("kpi").isin(names))
        regions, months = K.evaluate_parts(o, names, ["region"]), K.evaluate_parts(o.filter("kpi = 'on_time'"), ["on_time"], ["ym"])
        late = rows(w, user, "agg_delay")
    return {"regions": regions, "months": months,
            "delay": late.groupBy("bucket").agg(F.sum("n").alias("n"), ratio(F.sum("score"), F.sum("scores")).alias("rating"))}


PAGES = {"summary": summary, "sales": sales, "operations": operations}


@query("s17d_load_and_summary", "SELECT region, CAST(sum(price) FILTER (status <> 'P') AS DOUBLE) AS sales FROM x_vsales GROUP BY region")
def _(t: Tables):
    from .files import scratch
    w = load(t, scratch(t, "warehouse"))
    return K.evaluate_wide(S.rows_for("director", w.get("v_sales")), ["sales"], ["region"])
