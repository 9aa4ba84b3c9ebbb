"""Sensors, fraud, hub, airline and office on planted stories."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import airline as L, fraud as R, hub as H, office as O, sensors as N
from ledgerloom.plans import airline as LP, fraud as RP
from ledgerloom.sources import domain as D


def test_triangulation_finds_the_tap(spark):
    rows = [(1, k, 100.0 + abs(k - 47.3) / N.WAVE_KM_S, math.exp(-abs(k - 47.3) / 60)) for k in N.STATIONS]
    got = N.triangulate(spark.createDataFrame(rows, "wave int, km double, arrival_s double, amplitude double")).first()
    assert abs(got.x - 47.3) < 1e-6 and got.n == 7


def test_profile_fit_finds_the_vertex(spark):
    tri = lambda k, x: k / x if k <= x else (120.0 - k) / (120.0 - x)
    df = spark.createDataFrame([(1, [3.0 * tri(k, 94.0) for k in N.STATIONS])], "incident int, drops array<double>")
    got = N.profile_fit(df).first()
    assert got.x == 94.0 and abs(got.depth - 3.0) < 1e-9


@pytest.mark.parametrize("hot", [None, 10])
def test_cusum_equals_the_loop(spark, hot):
    vals = [(1, i, (i * 37) % 23 - 9) for i in range(80)] + [(2, i, 5) for i in range(5)]
    got = {(r.line, r.slot): r.s for r in N.cusum(spark.createDataFrame(vals, "line int, slot int, d long"), ["line"], ["slot"], "d", 2, hot).collect()}
    for line in (1, 2):
        s = 0
        for _, i, v in [x for x in vals if x[0] == line]:
            s = max(0, s + v - 2)
            assert got[(line, i)] == s


def test_long_gap_restarts_and_short_gap_repeats(spark):
    df = spark.createDataFrame([(1, "a", 0, 10), (2, "a", 1, 11), (3, "a", 4, 14), (4, "a", 20, 30)], "reading_id long, tag string, us long, centi long")
    got = [(r.slot_us, r.value, r.repeated, r.run) for r in N.fill_gaps(df, ["tag"], 1, 3).orderBy("slot_us").collect()]
    assert got == [(0, 10, False, 1), (1, 11, False, 1), (2, 11, True, 1), (3, 11, True, 1), (4, 14, False, 1), (20, 30, False, 2)]


def test_taps_found_missed_and_extra(spark):
    inc = spark.createDataFrame([(1, 1000, 50), (2, 1010, 51), (3, 9000, 10)], "incident_id long, us long, km int").withColumn("zone", F.lit(0))
    merged = N.merge(inc, ["zone"], 100)
    assert merged.count() == 2
    taps = spark.createDataFrame([(7, 990, 48), (8, 5000, 50)], "tap_id long, us long, km int")
    got = {(r.tap_id, r.first_id, r.outcome) for r in N.match_taps(merged, taps, 60, 5).collect()}
    assert got == {(7, 1, "found"), (8, None, "missed"), (None, 3, "extra")}


@pytest.mark.parametrize("row,want", [((1, False, False, False, False), "transmitter fault"), ((4, True, False, True, False), "maneuver"), ((4, False, False, True, False), "confirmed tap"),
                                      ((3, False, False, False, False), "probable tap"), ((0, False, False, True, True), "gradual extraction"), ((0, False, False, True, False), "re-packing")])
def test_fusion_table(spark, row, want):
    df = spark.createDataFrame([row], "n int, t boolean, l boolean, s boolean, g boolean")
    assert df.select(N.classify(*[F.col(c) for c in "ntlsg"]).alias("c")).first().c == want


def ops(spark, rows):
    """rows of (id, customer, hours, shop, city, card_present, channel, cents, fraud)"""
    t0 = datetime(2024, 1, 1, 12)
    data = [(i, c, t0 + timedelta(hours=h), int(h * R.HOUR), s, city, 0, 0, 0, "MX", cp, ch, a, f, False) for i, c, h, s, city, cp, ch, a, f in rows]
    from ledgerloom.plans.streams import OPS
    return spark.createDataFrame(data, OPS)


def test_impossible_travel_flags_both_sides(spark):
    o = ops(spark, [(1, 1, 0.0, 1, 0, True, "pos", 100, False), (2, 1, 0.2, 1, 11, True, "pos", 100, False), (3, 1, 100.0, 1, 11, True, "pos", 100, False)])
    assert {r.op_id for r in R.travel(o, R.Params()).filter("impossible").collect()} == {1, 2}


def test_card_testing_and_every_alert_explains_itself(spark):
    rows = [(i, 1, i * 0.1, 1, 0, False, "online", 100, False) for i in range(3)] + [(9, 1, 1.0, 1, 0, False, "online", 50_000, True)]
    s = R.score(R.features(ops(spark, rows), spark.createDataFrame([(1, 60_000)], "customer long, balance long"))).collect()
    big = next(r for r in s if r.op_id == 9)
    assert "card testing" in big.reasons and "drains the balance" in big.reasons and big.level in ("review", "block")
    assert all(r.reasons for r in s if r.level != "pass")


def test_hot_customer_gives_the_same_scores(tables):
    one = D.operations(tables).withColumn("customer", F.when(F.col("op_id") % 3 == 0, 1).otherwise(F.col("customer")))
    want = R.score(R.features(one, RP.balances(tables), RP.P), RP.P).select("op_id", "score").collect()
    got = R.score(R.features(one, RP.balances(tables), RP.P, 50), RP.P).select("op_id", "score").collect()
    assert sorted(want) == sorted(got)


def test_compromised_shop_is_found(spark):
    rows, i = [], 0
    for c in range(40):
        rows.append((i, c, 0.0, 13 if c < 10 else 5, 0, True, "pos", 100, False)); i += 1
        rows.append((i, c, 1.0, 6, 0, True, "pos", 100, False)); i += 1
        if c < 10:
            rows.append((i, c, 48.0, 99, 0, False, "online", 9000, True)); i += 1
    used = R.exposed_use(ops(spark, rows), F.col("is_fraud"))
    got = {r.shop: (r.times_base, r.compromised) for r in R.compromise(used, 2.0, 5).collect()}
    assert got[13] == (4.0, True) and not got[5][1] and not got[6][1]


def test_each_discrepancy_class_once(spark):
    pay = spark.createDataFrame([(i, Decimal("100.00"), "USD" if i == 4 else "BRL", i == 2) for i in (1, 2, 3, 4, 5, 6)], "ref long, amount decimal(12,2), currency string, cancelled boolean")
    inv = spark.createDataFrame([(2, 1, Decimal("100.00"), "BRL", 1), (3, 1, Decimal("200.00"), "BRL", 2), (4, 1, Decimal("100.00"), "BRL", 1), (5, 1, Decimal("10.00"), "BRL", 1), (6, 1, Decimal("100.00"), "BRL", 1)],
                                "ref long, document int, amount decimal(12,2), currency string, copies long")
    got = {r.ref: (r["class"], float(r.at_risk)) for r in H.reconcile(pay, inv, {"BRL": 1.0, "USD": 5.0}).collect()}
    assert got == {1: ("missing invoice", 100.0), 2: ("cancelled but invoiced", 100.0), 3: ("double billing", 100.0), 4: ("currency mismatch", 400.0), 5: ("amount mismatch", 90.0), 6: ("matched", 0.0)}


def test_replay_is_logged_and_not_applied_twice(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (2, 1, 5)], "id int, attempt int, v int")
    applied, log = H.apply_once(df, "id", ["attempt"])
    assert sorted((r.id, r.attempt) for r in applied.collect()) == [(1, 1), (2, 1)] and {r.id: r.duplicates for r in log.collect()} == {1: 1, 2: 0}


def test_short_delay_breaks_connection(spark):
    legs = spark.createDataFrame([(1, 1, 0, 175), (1, 2, 215, 300)], "passenger int, leg int, dep int, arr int")
    assert [r.missed for r in L.missed_connections(legs).orderBy("leg").collect()] == [True, False]


def test_no_flight_is_oversold_and_nobody_flies_twice(tables):
    fl = LP.flights(tables)
    asks = LP.stranded(tables)
    g = L.allocate(asks, fl)
    used = g.groupBy("flight_id").agg(F.count("*").alias("n")).join(fl, "flight_id")
    assert g.count() > 0 and used.filter("n > seats").count() == 0 and g.groupBy("ask_id").count().filter("count > 1").count() == 0
    # Served one by one in the order of the queue: the same, so nobody is left who could be placed.
    free = {r.flight_id: r.seats for r in fl.collect()}
    by_pair = {}
    for r in sorted(fl.collect(), key=lambda r: (r.dep, r.flight_id)):
        by_pair.setdefault((r.o, r.z), []).append(r)
    want = {}
    for p in sorted(asks.collect(), key=lambda p: (p["at"], p.ask_id)):
        f = next((f for f in by_pair.get((p.o, p.z), []) if f.dep >= p["at"] and free[f.flight_id] > 0), None)
        if f:
            free[f.flight_id] -= 1
            want[p.ask_id] = f.flight_id
    assert {r.ask_id: r.flight_id for r in g.collect()} == want


def test_claims_pay_what_is_owed(spark):
    c = spark.createDataFrame([(1, Decimal("0.00"), Decimal("10.00")), (2, Decimal("50.00"), Decimal("10.00")), (3, Decimal("5.00"), Decimal("10.00"))], "id int, owed decimal(14,2), claimed decimal(14,2)").withColumn("filed", F.lit("2024-01-01").cast("date"))
    got = {r.id: (r.verdict, float(r.pay), float(r.overpayment), str(r.deadline)) for r in L.adjudicate(c).collect()}
    assert got == {1: ("not owed", 0.0, 10.0, "2024-01-11"), 2: ("valid", 10.0, 0.0, "2024-01-11"), 3: ("partial", 5.0, 5.0, "2024-01-11")}


def test_conflicts_equal_the_pairs(spark):
    import random
    rng = random.Random(3)
    m = [(i, i % 2, s, s + rng.randrange(1, 30)) for i in range(60) for s in [rng.randrange(300)]]
    got = {r.meeting_id: r.overlaps for r in O.conflicts(spark.createDataFrame(m, "meeting_id long, owner int, start long, end long")).collect()}
    for i, o, s, e in m:
        assert got[i] == sum(1 for j, p, a, b in m if j != i and p == o and a < e and s < b)


def test_meter_bias_is_learnt_from_normal_hours_only(spark):
    """A steady bias is learnt, a tap is not, whatever the year; compared with a loop over the hours."""
    hours = []
    for line, bias in ((1, 700), (2, -300)):
        for h in range(120):
            tap = 1500 if line == 1 and 60 <= h < 90 else 0
            hours.append((line, 3_000_000 + h, 10_000 + bias + tap + (h * 37) % 11, 10_000))
    got = {(r.line, r.slot): r.d for r in N.balance(spark.createDataFrame(hours[::-1], "line int, slot long, inflow long, outflow long"), 100, 2000).collect()}
    want = {}
    for line in (1, 2):
        learnt, s = [], 0
        for i, (_, slot, a, b) in enumerate(h for h in hours if h[0] == line):
            d = 0 if i < 24 else (a - b) - sum(learnt) // len(learnt)
            s = max(0, s + d - 100)
            learnt += [a - b] if s <= 2000 else []
            want[line, slot] = d
    assert got == want
    assert all(1430 <= got[1, 3_000_000 + h] <= 1530 for h in range(62, 90)) and abs(got[2, 3_000_100]) < 20


def test_seats_on_direct_flights_and_connections(spark):
    """No leg oversold, every way feasible, nobody left for whom a way with seats remains; compared with all ways there are."""
    import random
    rnd = random.Random(8)
    cities, horizon = range(5), 6
    flights = {i: (*rnd.sample(cities, 2), rnd.randrange(12), rnd.randint(1, 2)) for i in range(60)}
    asks = {100 + i: (*rnd.choice([(0, 1), (0, 1), (2, 3), (4, 0), (1, 3)]), rnd.randrange(8)) for i in range(45)}
    f = spark.createDataFrame([(i, *v) for i, v in flights.items()], "flight_id long, o int, z int, dep int, seats int")
    a = spark.createDataFrame([(i, *v) for i, v in asks.items()], "ask_id long, o int, z int, at int")
    got = {r.ask_id: r for r in L.reaccommodate(a, f, horizon).collect()}
    taken = {i: 0 for i in flights}
    for i, r in got.items():
        o, z, at = asks[i]
        way = [flights[k] for k in (r.first, r.second) if k is not None]
        assert way[0][0] == o and way[-1][1] == z and way[0][2] >= at and way[-1][2] == r.arrive <= at + horizon
        assert len(way) == 1 or (way[0][1] == way[1][0] == r.hub and way[1][2] > way[0][2])
        for k in (r.first, r.second):
            if k is not None:
                taken[k] += 1
    assert all(taken[i] <= flights[i][3] for i in flights) and {r.kind for r in got.values()} == {"direct", "via"}
    free = [flights[i] for i in flights if taken[i] < flights[i][3]]
    for i, (o, z, at) in asks.items():
        if i not in got:
            in_time = [x for x in free if at <= x[2] <= at + horizon]
            assert not any(x[0] == o and x[1] == z for x in in_time)
            assert not any(x[0] == o and y[1] == z and x[1] == y[0] and y[2] > x[2] for x in in_time for y in in_time)
    assert 0 < len(got) < len(asks)


def test_extra_late_deliveries_of_an_event(spark):
    from datetime import date

    from ledgerloom.operators import anomalies as A
    e = [A.Event("storm", "unplanned", date(2030, 5, 10), date(2030, 5, 12)), A.Event("nothing", "planned", date(2031, 1, 1), date(2031, 1, 2))]
    rows = [("on_time", "ALL", "daily", date(2030, 5, d), 90.0 - 10 * (d in (10, 11)), 100.0, 0.9 - 0.1 * (d in (10, 11)), 0.9, 0.01, 1.0) for d in range(8, 15)]
    df = spark.createDataFrame(rows, "series string, region string, grain string, d date, num double, den double, value double, median double, mad double, factor double")
    df = df.withColumn("d_last", F.col("d"))
    got = {r.event: r for r in A.late_cost(df, e).collect()}
    assert (got["storm"].periods, got["storm"].deliveries, got["storm"].actual_late, got["storm"].expected_late, got["storm"].extra_late) == (3, 300.0, 50.0, 30.0, 20.0)
    assert got["storm"].spread == round(math.sqrt(3) * 1.4826, 4) and got["nothing"].periods == 0 and got["nothing"].extra_late is None
    reviews = spark.createDataFrame([(date(2030, 5, 6), 1), (date(2030, 5, 7), 5), (date(2030, 5, 9), 4), (date(2030, 5, 12), 2), (date(2030, 5, 13), 5)], "purchase_date date, score int")
    rated = {r.event: (r.rating_before, r.rating_during) for r in A.rating_change(reviews, e).collect()}
    assert rated == {"storm": (4.5, 2.0), "nothing": (None, None)}


def test_rotations_are_the_best_feasible_chains(spark):
    rng = random.Random(3)
    legs = [(1 + i % 2, rng.randrange(6), i, rng.randrange(4), rng.randrange(4), rng.randrange(20), rng.choice((0, 30, 60, 200))) for i in range(90)]
    df = spark.createDataFrame(legs, "period int, tail int, flight_id long, o int, z int, dep int, booked long")
    by_id = {x[2]: x for x in legs}

    def best(mine):
        top = {}
        for x in sorted(mine, key=lambda x: (x[5], x[2])):
            top[x[2]] = min(x[6], 100) + max([top[y[2]] for y in mine if y[2] in top and y[4] == x[3] and y[5] + L.TURN <= x[5]], default=0)
        return max(top.values())

    found = L.rotations(df, 100)
    rows = found.collect()
    assert {(r.period, r.tail): r.recovered for r in rows} == {k: best([x for x in legs if x[:2] == k]) for k in {x[:2] for x in legs}}
    for r in rows:
        chain = [by_id[f] for f in r.flights]
        assert all(x[:2] == (r.period, r.tail) for x in chain) and sum(min(x[6], 100) for x in chain) == r.recovered
        assert all(a[4] == b[3] and a[5] + L.TURN <= b[5] for a, b in zip(chain, chain[1:]))
    assert max(len(r.flights) for r in rows) > 3
    cost = {(r.period, r.spares): r for r in L.cost_of_spares(df, found, [2, 3, 4], 10).collect()}
    for p in (1, 2):
        got = sorted((r.recovered for r in rows if r.period == p), reverse=True)
        assert [cost[p, k].recovered for k in (2, 3, 4)] == [sum(got[:k]) for k in (2, 3, 4)]
        assert cost[p, 2].cost > cost[p, 3].cost > cost[p, 4].cost
        assert cost[p, 2].cost == 10 * (sum(x[6] for x in legs if x[0] == p) - sum(got[:2]))
    assert L.rotations(df.limit(0), 100).count() == 0
