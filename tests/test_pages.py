"""Report pages from the written small tables equal the same numbers taken from the wide rows."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.money import dbl, ratio
from ledgerloom.operators import kpi as K, security as S
from ledgerloom.plans import catalog, kpis, pages
from ledgerloom.sources.tables import Tables

catalog.load()


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    return pages.load(Tables(spark, "/root/testdata/sf0.001"), str(tmp_path_factory.mktemp("warehouse")))


def wide(w, user):
    """The parts of all pages from lines, orders and reviews."""
    of = {n: S.rows_for(user, w.get(n if user != "seller.7" else s)) for n, s in
          [("v_sales", "v_sales"), ("v_orders", "orders_by_seller"), ("v_reviews", "reviews_by_seller")]}
    sales, orders, reviews = of.values()
    base = sales.filter("status <> 'P'")
    return {
        "kpis": K.kpis({"sales": lambda: sales, "orders": lambda: orders, "reviews": lambda: reviews}),
        "trend": K.evaluate_wide(sales, ["sales"], ["ym"]),
        "sales months": base.groupBy("ym", "region").agg(dbl(F.sum("price")).alias("sales"), F.count("*").alias("n")),
        "categories": base.groupBy("category").agg(dbl(F.sum("price")).alias("sales")).orderBy(F.desc("sales"), "category").limit(10),
        "sellers": base.groupBy("seller_id").agg(dbl(F.sum("price")).alias("sales")).orderBy(F.desc("sales"), "seller_id").limit(10),
        "payment": base.groupBy("payment_type").agg(F.count_distinct("order_id").alias("orders"), dbl(F.sum("price")).alias("sales")),
        "regions": K.evaluate_wide(orders, ["orders", "on_time", "delivery_days", "cancel_rate"], ["region"]),
        "operations months": K.evaluate_wide(orders, ["on_time"], ["ym"]),
        "delay": reviews.filter("days_late IS NOT NULL").groupBy(F.expr(kpis.LATE_BUCKET).alias("bucket")).agg(
            F.count("*").alias("n"), ratio(F.sum("score"), F.count("*")).alias("rating")),
    }


def same(a, b):
    return sorted(map(str, (tuple(r) for r in a.collect()))) == sorted(map(str, (tuple(r) for r in b.select(*a.columns).collect())))


@pytest.mark.parametrize("user", ["director", "manager.asia", "seller.7", "nobody"])
def test_pages_equal_the_wide_rows(warehouse, user):
    got = {}
    for page, build in pages.PAGES.items():
        for name, df in build(warehouse, user).items():
            got[f"{page} {name}" if name == "months" else name] = df
    want = wide(warehouse, user)
    assert {n for n in want if not same(want[n], got[n])} == set()
    assert set(got) - set(want) <= {"verdicts"}


def test_opened_tables_are_listed_once_and_anew_when_written(warehouse):
    assert warehouse.get("agg_delay") is warehouse.get("agg_delay")
    before = warehouse.get("verdicts")
    warehouse.put("verdicts", before.where("region = 'ASIA'").checkpoint())
    assert warehouse.get("verdicts").where("region <> 'ASIA'").count() == 0
