"""Hand-made fixtures with every answer known."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cities
from ledgerloom.operators import anomalies as A, kpi as K, quality as Q, security as S, targets as G, workshop as W
from ledgerloom.plans import alerts
from ledgerloom.sources import domain as D, templates as T


def d(s):
    return date.fromisoformat(s)


ORDERS = "order_id long, customer_id long, status string, purchase_date date, ym int, total decimal(12,2), payment_type string, promised_date date"
LINES = "order_id long, line_seq int, seller_id long, price decimal(12,2), freight decimal(12,2), line_status string, ship_date date"


@pytest.fixture(scope="module")
def shop(spark):
    """Four delivered orders, three on time; one cancelled with a delivered line; one delivered without lines."""
    o = [(i, i % 3, "F", d("2020-01-01"), 202001, Decimal("10.00"), "card", d("2020-01-10")) for i in range(1, 5)]
    o += [(5, 1, "P", d("2020-01-02"), 202001, Decimal("7.00"), "card", d("2020-01-12")), (6, 2, "F", d("2020-01-03"), 202001, Decimal("9.00"), "card", d("2020-01-13"))]
    l = [(1, 1, 1, Decimal("4.00"), Decimal("1.00"), "F", d("2020-01-05")), (1, 2, 2, Decimal("6.00"), Decimal("1.00"), "F", d("2020-01-06")),
         (2, 1, 1, Decimal("10.00"), Decimal("1.00"), "F", d("2020-01-10")), (3, 1, 1, Decimal("10.00"), Decimal("1.00"), "F", d("2020-01-04")),
         (4, 1, 2, Decimal("10.00"), Decimal("1.00"), "F", d("2020-01-11")), (5, 1, 2, Decimal("7.00"), Decimal("1.00"), "F", d("2020-01-05"))]
    return spark.createDataFrame(o, ORDERS), spark.createDataFrame(l, LINES)


def test_on_time_is_exactly_three_of_four(shop):
    orders, lines = shop
    last = lines.groupBy("order_id").agg(F.max("ship_date").alias("last_ship"))
    v = D.with_delivery(orders.join(last, "order_id", "left"))
    got = K.evaluate_wide(v, ["on_time", "orders", "cancel_rate"]).first()
    assert (got.on_time, got.orders) == (0.75, 5.0)
    assert got.cancel_rate == round(1 / 6, 6)


def test_ratio_is_sum_over_sum(spark):
    df = spark.createDataFrame([("a", "F", Decimal("90.00"), Decimal("9.00")), ("b", "F", Decimal("10.00"), Decimal("5.00"))], "region string, status string, price decimal(12,2), freight decimal(12,2)")
    assert K.evaluate_wide(df, ["freight_share"]).first().freight_share == 0.14


def test_quarantine_cascade_and_balance(shop):
    orders, lines = shop
    held = Q.quarantine(orders, lines)
    assert {r.order_id: r.reason for r in held.collect()} == {5: "cancelled with delivery date", 6: "delivered without delivery date"}
    kept, out = Q.cascade(lines, held, "order_id")
    assert out.count() == 1 and kept.count() == 5
    row = Q.reconcile(lines, kept, out, "price", "lines").first()
    assert row.balanced and row.m_staging == Decimal("47.00")
    assert not Q.reconcile(lines, kept.limit(4), out, "price", "lines").first().balanced


def test_publish_refuses_and_keeps_last_good(spark, tmp_path, shop):
    orders, _ = shop
    checks = {"duplicate orders": lambda x: Q.duplicate_keys(x, "order_id")}
    Q.publish(orders, str(tmp_path), checks)
    with pytest.raises(Q.PublishRefused):
        Q.publish(orders.union(orders), str(tmp_path), checks)
    assert Q.published(spark, str(tmp_path)).count() == 6


def test_rejects_keep_reasons(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, 200)], "id int, q int")
    out = Q.split_valid(df, {"negative": F.col("q") < 0, "too many": F.col("q") > 100})
    assert {r.id: r.reasons for r in out.collect()} == {1: [], 2: ["negative"], 3: ["too many"]}


def test_templates_accept_local_formats_and_report_rows(spark):
    df = spark.createDataFrame([("1", "$12,500.00", "15/03/2026", "ACTIVÓ"), ("2", "abc", "46096", "activo"), ("3", "7", "2026-03-15", "otro")], "`Fólio` string, IMPORTE string, fecha string, estado string")
    spec = [T.Field("folio", "folio", "int"), T.Field("amount", "importe", "money"), T.Field("day", "Fecha", "date"), T.Field("state", "estado", "option", ("Activo",))]
    rows = {r.folio: r for r in T.read_template(df, spec).collect()}
    assert rows[1].amount == Decimal("12500.00") and rows[1].day == d("2026-03-15") and rows[1].state == "Activo" and rows[1].reasons == []
    assert rows[2].day == d("2026-03-15") and rows[2].reasons == ["importe: not a valid money"]
    assert rows[3].reasons == ["estado: not a valid option"]
    with pytest.raises(ValueError):
        T.read_template(df.drop("fecha"), spec)


def test_city_rules(spark):
    geo = spark.createDataFrame([("z1", "riverside", "sp state"), ("z2", "greenfield", "minas")], "zip string, city string, state string")
    df = spark.createDataFrame(
        [(1, "Riverside - SP", "z1", "sp state"), (2, "04482255", "z1", "sp state"), (3, "greenfeld", "z2", "minas"), (4, "minas", "z2", "minas"),
         (5, "kilometre 9 settlement", "z2", "minas"), (6, "shop@x.com", "z1", "sp state"), (7, "novo, brasil", "z2", "minas")], "id int, city string, zip string, state string")
    got = {r.id: (r.city_clean, r.rule) for r in cities.clean(df, geo, ["sp", "mg"]).collect()}
    assert got[1] == ("riverside", "cut") and got[2] == ("riverside", "not a city") and got[3] == ("greenfield", "typo")
    assert got[4] == ("greenfield", "not a city") and got[5] == ("kilometre 9 settlement", "kept") and got[6] == ("riverside", "not a city") and got[7] == ("novo", "cut")


@pytest.mark.parametrize("a,b,want", [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("abc", "xyz", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler_known_values(a, b, want):
    assert round(cities.jaro_winkler(a, b), 6) == want


def test_manager_sees_only_the_region_and_seller_no_totals(tables):
    v = D.v_orders(tables)
    assert {r.region for r in S.relation("manager.asia", v).select("region").distinct().collect()} == {"ASIA"}
    mine = S.relation("seller.7", v, D.lines(tables))
    assert not {"total", "items_value", "customer_id"} & set(mine.columns)
    assert S.relation("nobody", v).count() == 0
    assert "customer_id" not in S.relation("analyst", v).columns


def test_run_rate_needs_three_complete_months(spark):
    months = spark.createDataFrame([("A", 202000 + m, 100.0 * m) for m in range(1, 7)], "region string, ym int, sales double")
    complete = spark.createDataFrame([(202000 + m, m != 2) for m in range(1, 7)], "ym int, is_complete boolean")
    over = spark.createDataFrame([("A", 202001, 5.0)], "region string, ym int, override double")
    got = {r.ym: r.target for r in G.run_rate(G.monthly(months, complete, {}), over).collect()}
    assert got == {202001: 5.0, 202006: round((300 + 400 + 500) / 3 * 1.05, 2)}


def series(spark, values, start="2020-01-06", name="orders", region="ALL"):
    rows = [(name, region, i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, region string, o int, num double")
    return df.select("series", "region", F.date_add(F.lit(d(start)), F.col("o")).alias("day"), F.col("num").cast("decimal(20,2)").alias("num"), F.lit(None).cast("decimal(20,2)").alias("den"), F.lit(100).alias("n"))


def test_planted_dip_is_one_alert_and_planned_peak_is_silent(spark):
    values = [100 + (i * 7) % 11 for i in range(90)]
    values[60] = values[61] = 20
    values[70] = 400
    ev = [A.Event("sale", "planned", d("2020-03-16"), d("2020-03-16"), 1.2, ("orders",))]
    none = spark.createDataFrame([], "ym int, is_complete boolean")
    judged = A.detect(series(spark, values), ev, none, [])
    found = A.alerts(judged).collect()
    assert [(r.first_d, r.last_d, r.periods, r.sent) for r in found] == [(d("2020-03-06"), d("2020-03-07"), 2, d("2020-03-06"))]
    peak = judged.filter("d = DATE '2020-03-16'").first()
    assert peak.z > 20 and peak.suppressed and not peak.flagged


def test_end_of_data_is_not_a_drop(spark):
    values = [100 + (i * 7) % 11 for i in range(60)] + [30, 20, 10, 5]
    none = spark.createDataFrame([], "ym int, is_complete boolean")
    judged = A.detect(series(spark, values), [], none, [])
    assert A.alerts(judged).count() == 0 and judged.filter("tail").count() == 4


def test_every_alert_has_a_recipient_and_sellers_none(spark):
    found = spark.createDataFrame([(1, "ALL", False), (2, "ASIA", False), (3, "ASIA", True), (4, "AFRICA", False)], "id int, region string, is_critical boolean")
    users = spark.createDataFrame(alerts.USERS, "user_name string, role string, region string")
    got = {}
    for r in A.recipients(found, users).collect():
        got.setdefault(r.id, set()).add(r.user_name)
    assert got == {1: {"director", "analyst"}, 2: {"manager.asia"}, 3: {"manager.asia", "director"}, 4: {"director", "analyst"}}


def test_covered_counts(spark):
    spans = spark.createDataFrame([("a", d("2020-01-01"), d("2020-01-04")), ("a", d("2020-01-03"), None), ("a", d("2020-01-05"), d("2020-01-05"))], "k string, start date, stop date")
    asked = spark.createDataFrame([("a", d(f"2020-01-0{i}")) for i in (1, 3, 4, 9)], "k string, day date")
    assert {r.day.day: r.n for r in A.covered_counts(spans, ["k"], asked).collect()} == {1: 1, 3: 2, 4: 1, 9: 1}


def test_backtest_reads_nothing_after_the_day(spark, shop):
    orders, lines = shop
    as_of = [d("2020-01-05")]
    before = W.backtest(orders, lines, as_of, F.lit(None).cast("date")).select("order_id", "estimated").collect()
    moved = lines.withColumn("ship_date", F.when(F.col("ship_date") > d("2020-01-05"), F.date_add("ship_date", 400)).otherwise(F.col("ship_date")))
    after = W.backtest(orders, moved, as_of, F.lit(None).cast("date")).select("order_id", "estimated").collect()
    assert sorted(before) == sorted(after) and before


def test_filters_reach_every_kpi_or_raise(tables):
    from ledgerloom.operators import kpi as K

    rel = K.datasets(tables, ("customer", "product"))
    whole = {r.kpi: r.value for r in K.kpis(rel).collect()}
    promo = {r.kpi: r.value for r in K.kpis(rel, filters={"category": "PROMO"}).collect()}
    assert set(whole) == set(promo)
    assert promo["orders"] < whole["orders"] and promo["customers"] < whole["customers"] and promo["rating"] != whole["rating"]
    sales = rel["sales"]().filter("category = 'PROMO' AND status <> 'P'")
    assert promo["orders"] == sales.select("order_id").distinct().count()
    by = {(r.category, r.kpi): r.value for r in K.kpis(rel, by=["category"]).collect()}
    assert by["PROMO", "orders"] == promo["orders"] and by["PROMO", "rating"] == promo["rating"]
    for wrong in ({"colour": "red"}, {"category": "PROMO", "colour": "red"}):
        with pytest.raises(ValueError):
            K.kpis(rel, filters=wrong)
    with pytest.raises(ValueError):
        K.kpis(rel, by=["colour"])


def test_a_stage_without_pace_gives_no_estimate(spark):
    from ledgerloom.operators import workshop as W

    done = {f"s{s}": None for s in W.ROUTE}
    row = {"order_id": 1, "promised_date": d("2024-02-01"), "as_of": d("2024-01-01"), **done, **{f"p{s}": 2.0 for s in W.ROUTE}}
    cols = "order_id int, promised_date date, as_of date, " + ", ".join(f"s{s} date" for s in W.ROUTE) + ", " + ", ".join(f"p{s} double" for s in W.ROUTE)
    known = W.estimate(spark.createDataFrame([tuple(row.values())], cols), F.col("as_of")).first()
    assert (known.days_left, known.no_pace) == (14, 0)
    row["p3"] = None
    unknown = W.estimate(spark.createDataFrame([tuple(row.values())], cols), F.col("as_of")).first()
    assert (unknown.days_left, unknown.estimated, unknown.no_pace) == (None, None, 1)


def test_reconciliation_is_exact_to_the_cent(spark):
    from ledgerloom.operators import hub as H

    pay = spark.createDataFrame([(1, Decimal("100.00"), "BRL", False), (2, Decimal("100.00"), "BRL", False)], "ref int, amount decimal(12,2), currency string, cancelled boolean")
    inv = spark.createDataFrame([(1, 1, Decimal("100.01"), "BRL", 1), (2, 1, Decimal("80.00"), "BRL", 1)], "ref int, document int, amount decimal(12,2), currency string, copies int")
    got = {r.ref: (r["class"], r.at_risk) for r in H.reconcile(pay, inv, {"BRL": 1.0}).collect()}
    assert got == {1: ("matched", 0), 2: ("amount mismatch", Decimal("20.00"))}


def test_the_load_refuses_lost_and_doubled_rows(tables, tmp_path):
    from ledgerloom.plans import marts

    w = marts.load_marts(tables, str(tmp_path))
    held = {r.order_id for r in w.get("quarantine_orders").collect()}
    assert held and not held & {r.order_id for r in w.get("v_orders").select("order_id").collect()}
    assert not held & {r.order_id for r in w.get("v_sales").select("order_id").collect()}
    assert all(r.balanced for r in marts.balance(w).collect())
    released = marts.published(tables, str(tmp_path), "v_sales").count()
    for broken in (lambda df: df.limit(df.count() - 1), lambda df: df.unionByName(df.limit(1))):
        bad = marts.Warehouse(tables, str(tmp_path))
        for step in marts.steps(bad).values():
            step()
        lines = w.get("v_sales")
        bad.put("v_sales", broken(lines), True)
        with pytest.raises(Q.PublishRefused):
            marts.audit(bad)
    assert marts.published(tables, str(tmp_path), "v_sales").count() == released


def test_unknown_keys_keep_their_rows(spark):
    facts = spark.createDataFrame([(1, 7), (2, 8)], "order_id int, customer_id int")
    names = spark.createDataFrame([(7, "ASIA")], "customer_id int, region string")
    got = {r.order_id: r.region for r in D.with_dimension(facts, names, "customer_id").collect()}
    assert got == {1: "ASIA", 2: "unknown"}


def test_lines_are_sent_by_order_once_and_know_whether_they_are_held(spark, tables, capsys):
    held = D.held_orders(tables)
    want = sorted(map(str, D.staged_lines(tables).join(held.select("order_id", "reason"), "order_id").select("order_id", "line_seq", "price", "reason").collect()))
    lines = D.examined_lines(tables)
    assert sorted(map(str, lines.filter("reason IS NOT NULL").select("order_id", "line_seq", "price", "reason").collect())) == want and want
    a, b = D.v_sales(tables, examined=lines), D.v_sales(tables)
    assert set(a.columns) == set(b.columns)
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    capsys.readouterr()
    lines.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(order_id") <= 2  # the lines and the orders, each once
    D.summarised(D.lines(tables)).explain()
    assert capsys.readouterr().out.count("Exchange") == 1
