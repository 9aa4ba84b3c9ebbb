"""What a load sends and leaves on disk, and that its tables stay the same."""

import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import marts
from ledgerloom.sources import domain as D
from ledgerloom.sources.tables import SCHEMAS, Tables


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def texts(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Doubled, unknown and missing keys: an order twice, one without lines, a line without an order, a nation nobody knows."""
    folder = str(tmp_path_factory.mktemp("odd"))
    day = datetime(1997, 3, 5)
    rows = {
        "region": [(0, "ASIA")], "nation": [(1, "NATION_1", 0), (2, "NATION_2", 7)],
        "customer": [(1, "a", 1, 0.0, "x"), (2, "b", 2, 0.0, "x"), (3, "c", None, 0.0, "x")],
        "supplier": [(1, "s1", 1, 0.0), (2, "s2", 9, 0.0), (3, None, 1, 0.0)],
        "part": [(1, "p", "Brand#1", "SMALL", 1, 9.0)],
        "orders": [(1, 1, "F", 10.0, day, "5-LOW"), (2, 2, "O", 20.0, day, "2-HIGH"), (2, 3, "O", 21.0, day, "ODD"), (3, 8, "O", 30.0, day, "5-LOW"),
                   (4, 1, "F", 40.0, day, "5-LOW"), (5, None, "P", 50.0, None, None), (None, 1, "O", 1.0, day, "5-LOW")],
        "lineitem": [(k, p, s, n, 1.0, 100.0 * (n or 7), 0.1, 0.02, "N", status, at) for k, p, s, n, status, at in [
            (1, 1, 1, 1, "F", day), (1, 1, 1, 1, "F", datetime(1997, 3, 9)), (1, 2, 2, 2, "O", None), (2, 1, 3, 1, "O", day), (2, 1, 5, None, "O", day),
            (3, 1, 1, 1, "O", day), (5, 1, 1, 1, "F", day), (9, 1, 1, 1, "O", day), (None, 1, 1, 1, "O", day)]],
    }
    for name, data in rows.items():
        spark.createDataFrame(data, SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, folder)


def test_staging_is_made_in_one_pass_and_equals_the_separate_ones(tables, odd, tmp_path, capsys):
    for t in (tables, odd):
        w = marts.Warehouse(t, str(tmp_path))
        w.put_staging(D.examined(t))
        lines, orders, alone = w.get("staging_lines"), w.get("staging_orders"), D.examined_lines(t)
        assert texts(lines, *alone.columns) == texts(alone, *alone.columns)
        want = D.examined_orders(t)
        assert texts(orders, *want.columns) == texts(want, *want.columns)
        assert {f.name: f.dataType for f in want.schema}.items() <= {f.name: f.dataType for f in orders.schema}.items()
    assert plan(D.examined(tables), capsys).count("Exchange hashpartitioning(order_id") <= 2
    assert "Exchange" not in plan(D.order_columns(tables, D.order_rows(orders)), capsys).replace("BroadcastExchange", "").replace("ReusedExchange", "")


def test_marts_from_staging_equal_those_from_the_tables(odd):
    sales = D.v_sales(odd)
    assert texts(D.v_sales(odd, examined=D.examined_lines(odd)), *sales.columns) == texts(sales, *sales.columns)
    staged = D.examined(odd).filter("grain = 'orders'").select(*D.STAGING["orders"])
    want = D.v_orders(odd)
    got = D.order_columns(odd, D.order_rows(staged))
    assert sorted(got.columns) == sorted(want.columns) and texts(got, *want.columns) == texts(want, *want.columns)


def test_a_load_sends_no_names_that_follow_from_numbers(tables, capsys):
    rows = D.sales_rows(tables, D.examined_lines(tables))
    assert not {"ym", "promised_date", "state", "region", "seller_state", "seller_region"} & set(rows.columns)
    assert "hashpartitioning(seller_id" not in plan(rows, capsys)


def shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    return {f for top in env.blockManager().diskBlockManager().localDirs() for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_a_load_leaves_no_shuffle_files(spark, tables, tmp_path):
    before = shuffle_files(spark)
    marts.load_marts(tables, str(tmp_path))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.5)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") != "true"


def test_a_whole_load_leaves_no_shuffle_files_and_counts_orders_once(spark, tables, tmp_path):
    from ledgerloom.operators import security as S
    from ledgerloom.plans import pages

    before = shuffle_files(spark)
    w = pages.load(tables, str(tmp_path))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.5)
    assert not left
    sales = w.get("v_sales")
    kept = sales.filter("status <> 'P'")
    for name, keys in (("agg_payments_by_seller", ["seller_id", "payment_type"]), ("agg_sales_payments", ["region", "payment_type"])):
        want = kept.groupBy(*keys).agg(F.count_distinct("order_id").alias("orders"), F.sum("price").alias("sales"))
        assert w.schemas[name] == want.schema or [f.dataType for f in w.schemas[name]] == [f.dataType for f in want.schema]
        assert texts(w.get(name), *want.columns) == texts(want, *want.columns)
    want = kept.groupBy("seller_id", "ym", "region", "category").agg(F.sum("price").alias("sales"), F.count("*").alias("n_lines"))
    assert texts(w.get("agg_sales_by_seller"), *want.columns) == texts(want, *want.columns)
    own = sales.groupBy("order_id", "seller_id").agg(F.count("*").alias("n_lines"), F.sum("price").alias("price"))
    want = own.join(w.get("v_orders").drop(*S.ORDER_TOTALS, "n_lines"), "order_id")
    assert texts(w.get("orders_by_seller"), *want.columns) == texts(want, *want.columns)
    reviews = D.latest_reviews(tables).join(w.get("v_orders"), "order_id")
    assert texts(w.get("v_reviews"), *reviews.columns) == texts(reviews, *reviews.columns)
    want = own.select("order_id", "seller_id").join(reviews.drop(*S.ORDER_TOTALS, "n_lines"), "order_id")
    assert texts(w.get("reviews_by_seller"), *want.columns) == texts(want, *want.columns)


def test_a_session_setting_is_put_back(spark):
    from ledgerloom.session import setting

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with pytest.raises(ValueError):
        with setting(spark, name, "2"):
            assert spark.conf.get(name) == "2"
            raise ValueError
    assert spark.conf.get(name) == before
