"""Disruption handling: missed connections, entitlement, re-accommodation under capacity, claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import dbl, ratio
from ..session import settle
from .ordered import OrderedScan

# Fixed values of the law; delay thresholds are ours.
DISCOUNT, INDEMNITY, PAY_DAYS = 0.075, 0.25, 10
FOOD_MIN, REFUND_MIN, HOTEL_MIN = 60, 240, 480
MIN_CONNECTION = 45  # minutes
TURN = 1  # days from a departure to the next one of the same aircraft

CAUSES = {"1-URGENT": ("engine recall", True), "2-HIGH": ("crew", True), "3-MEDIUM": ("weather", False),
          "4-NOT SPECIFIED": ("airspace", False), "5-LOW": ("maintenance", True)}


def missed_connections(legs: DataFrame) -> DataFrame:
    """(passenger, leg, dep, arr with delay) plus next_dep and missed; any delay counts that breaks the connection."""
    scan = OrderedScan(legs, ["passenger"], ["leg"]).next({"next_dep": "dep"})
    return scan.result().withColumn("missed", F.coalesce(F.col("arr") + MIN_CONNECTION > F.col("next_dep"), F.lit(False)))


def cause(col: str) -> tuple[Column, Column]:
    name, owed = F.lit("other"), F.lit(False)
    for k, (n, a) in CAUSES.items():
        name, owed = F.when(F.col(col) == k, n).otherwise(name), F.when(F.col(col) == k, a).otherwise(owed)
    return name, owed


def entitlement(df: DataFrame) -> DataFrame:
    """Adds what is owed to rows with (fare, delay minutes, cancelled, attributable)."""
    long = F.col("cancelled") | (F.col("delay") >= REFUND_MIN)
    part = lambda share: F.round(F.col("fare") * F.lit(str(share)).cast("decimal(5,3)"), 2).cast("decimal(12,2)")
    nil = F.lit(0).cast("decimal(12,2)")
    df = df.withColumns({
        "food": (F.col("delay") >= FOOD_MIN) | F.col("cancelled"),
        "hotel": F.col("attributable") & (F.col("delay") >= HOTEL_MIN),
        "discount": F.when(F.col("attributable") & ~long & (F.col("delay") >= FOOD_MIN), part(DISCOUNT)).otherwise(nil),
        "refund": F.when(long, F.col("fare")).otherwise(nil),
        "indemnity": F.when(F.col("attributable") & long, part(INDEMNITY)).otherwise(nil)})
    return df.withColumn("owed", (F.col("discount") + F.col("refund") + F.col("indemnity")).cast("decimal(14,2)"))


def adjudicate(claims: DataFrame) -> DataFrame:
    """Adds verdict, amount to pay, overpayment, deadline and reason to rows with (owed, claimed, filed)."""
    verdict = F.when(F.col("owed") == 0, "not owed").when(F.col("claimed") <= F.col("owed"), "valid").otherwise("partial")
    pay = F.least("owed", "claimed")
    return claims.withColumns({
        "verdict": verdict, "pay": pay, "overpayment": F.col("claimed") - pay, "deadline": F.date_add("filed", PAY_DAYS),
        "reason": F.when(F.col("owed") == 0, "the cause or the delay gives no right").when(F.col("claimed") > F.col("owed"), "claims more than the law gives").otherwise("as owed")})


def next_departure(asks: DataFrame, flights: DataFrame, keys: list[str], out: str, fields: list[str]) -> DataFrame:
    """Adds ``out``: the first flight of the pair leaving at or after ``at`` (one ordered pass, no pairing).

    On one pair flights take equally long, so the first to leave is the first to arrive.
    """
    f = flights.select(*keys, F.col("dep").alias("at"), F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in fields]).alias("_f"), F.col("flight_id").alias("_id"))
    a = asks.withColumn("_kind", F.lit(0)).withColumn("_f", F.lit(None).cast(f.schema["_f"].dataType)).withColumn("_id", F.col("ask_id"))
    scan = OrderedScan(a.unionByName(f, allowMissingColumns=True), keys, ["at", "_kind", "_id"])
    scan.running({out: ("last", "_f")}, reverse=True)
    return scan.result().filter("_kind = 0").drop("_kind", "_f", "_id")


def choices(asks: DataFrame, flights: DataFrame, horizon: int) -> DataFrame:
    """Ways from where a passenger is to the final destination: the first direct flight, and the first over each hub.

    asks (ask_id, o, z, at), flights (flight_id, o, z, dep), times in days; gives
    (ask_id, kind, hub, first, second, arrive) within the horizon. For each hub
    only the first connecting flights matter, so an ask yields at most one
    candidate per airport.
    """
    in_time = lambda c: F.col(c) <= F.col("at0") + horizon
    nothing = F.lit(None).cast(flights.schema["flight_id"].dataType)
    asks, flights = settle(asks.select("ask_id", "o", "z", "at", F.col("at").alias("at0"))), settle(flights)
    fields = ["dep", "flight_id"]
    direct = next_departure(asks, flights, ["o", "z"], "f1", fields).select(
        "ask_id", "at0", F.lit("direct").alias("kind"), F.lit(-1).alias("hub"), F.col("f1.flight_id").alias("first"), nothing.alias("second"), F.col("f1.dep").alias("arrive"))
    pairs = flights.select("o", "z").distinct()
    hubs = asks.join(pairs.select("o", F.col("z").alias("h")), "o").filter("h <> z").join(pairs.select(F.col("o").alias("h"), "z"), ["h", "z"], "left_semi")
    first = hubs.select("ask_id", "o", F.col("h").alias("z"), "at", "at0", F.col("z").alias("final"))
    first = settle(next_departure(first, flights, ["o", "z"], "f1", fields).filter("f1 IS NOT NULL"))
    second = first.select("ask_id", F.col("z").alias("o"), F.col("final").alias("z"), (F.col("f1.dep") + 1).alias("at"), "at0", F.col("z").alias("hub"), F.col("f1.flight_id").alias("first"))
    second = next_departure(second, flights, ["o", "z"], "f2", fields).select(
        "ask_id", "at0", F.lit("via").alias("kind"), "hub", "first", F.col("f2.flight_id").alias("second"), F.col("f2.dep").alias("arrive"))
    return direct.unionByName(second).filter(F.col("arrive").isNotNull() & in_time("arrive")).drop("at0")


def options(asks: DataFrame, flights: DataFrame, horizon: int) -> DataFrame:
    """The best of a passenger's ``choices``, and their number."""
    best = F.min(F.struct("arrive", "kind", "hub"))
    return choices(asks, flights, horizon).groupBy("ask_id").agg(best.alias("m"), F.count("*").alias("n_options")).select("ask_id", "n_options", "m.*")


def allocate(asks: DataFrame, flights: DataFrame) -> DataFrame:
    """(ask_id, flight_id): each passenger gets the first flight that has a seat for them.

    Passengers of a pair queue by the time they ask, then by id (the priority is
    ours). Up to flight j so many have been taken as had asked by then or as all
    seats so far allow: S(j) = min(A(j), S(j - 1) + seats(j)), which is
    C(j) + min(0, min over i <= j of A(i) - C(i)) with A the passengers who have
    asked and C the seats so far. All of it is running sums and minima, in no
    rounds; the n-th in the queue gets the first flight with S >= n. No flight is
    oversold, and no passenger is left for whom a later flight has a seat.
    """
    keys = ["o", "z"]
    points = asks.select(*keys, "at", F.lit(0).alias("_kind"), F.col("ask_id").alias("_id"), F.lit(1).alias("_ask"), F.lit(0).alias("_seats")).unionByName(
        flights.select(*keys, F.col("dep").alias("at"), F.lit(1).alias("_kind"), F.col("flight_id").alias("_id"), F.lit(0).alias("_ask"), F.col("seats").alias("_seats")))
    scan = OrderedScan(points, keys, ["at", "_kind", "_id"]).running({"asked": ("sum", "_ask"), "seats": ("sum", "_seats")})
    scan.with_columns({"_gap": F.when(F.col("_kind") == 1, F.col("asked") - F.col("seats"))}).running({"_low": ("min", "_gap")})
    line = settle(scan.result())
    queue = line.filter("_kind = 0").select(F.col("_id").alias("ask_id"), *keys, F.col("asked").alias("at"))
    taken = F.col("seats") + F.least(F.lit(0), F.col("_low"))
    # Of flights with the same number taken, only the first took anybody.
    first = line.filter("_kind = 1").groupBy(*keys, taken.alias("dep")).agg(F.min(F.struct("at", "_id")).alias("m"))
    got = next_departure(queue, first.select(*keys, "dep", F.col("m._id").alias("flight_id")), keys, "f", ["flight_id"])
    return got.filter("f IS NOT NULL").select("ask_id", F.col("f.flight_id").alias("flight_id"))


def reaccommodate(asks: DataFrame, flights: DataFrame, horizon: int) -> DataFrame:
    """(ask_id, kind, hub, first, second, arrive): seats on direct flights and on connections, all within the horizon.

    Direct seats come from ``allocate``. Who has none asks for a way with seats
    left, the n-th in the queue of a pair for the n-th best, so that few ask for
    the same; a flight takes those who asked first, and a connection holds if both
    legs take it. Rejected passengers ask again for what is left, until nobody has
    a way with seats. In each round whoever asked first of all is placed, so
    rounds end; what is given is written after each. No leg is oversold.
    """
    asks, flights = settle(asks.select("ask_id", "o", "z", "at")), settle(flights.select("flight_id", "o", "z", "dep", "seats"))
    nothing = F.lit(None).cast(flights.schema["flight_id"].dataType)
    direct = allocate(asks, flights).join(flights.select("flight_id", "dep"), "flight_id").join(asks.select("ask_id", "at"), "ask_id").filter(F.col("dep") <= F.col("at") + horizon)
    done = settle(direct.select("ask_id", F.lit("direct").alias("kind"), F.lit(-1).alias("hub"), F.col("flight_id").alias("first"), nothing.alias("second"), F.col("dep").alias("arrive")))
    legs = lambda df, *more: df.select(*more, "ask_id", F.explode(F.array_compact(F.array("first", "second"))).alias("flight_id"))
    while True:
        taken = legs(done).groupBy("flight_id").agg(F.count("*").alias("taken"))
        left = settle(flights.join(taken, "flight_id", "left").withColumn("left", F.col("seats") - F.coalesce("taken", F.lit(0))).filter("left > 0"))
        open_asks = asks.join(done.select("ask_id"), "ask_id", "left_anti")
        found = settle(choices(open_asks, left.groupBy("o", "z", "dep").agg(F.min("flight_id").alias("flight_id")), horizon))
        if found.isEmpty():
            return done
        who = asks.join(found.select("ask_id").distinct(), "ask_id", "left_semi")
        queue = who.withColumn("turn", F.row_number().over(Window.partitionBy("o", "z").orderBy("at", "ask_id")) - 1).select("ask_id", "at", "turn")
        mine = Window.partitionBy("ask_id")
        ranked = found.withColumn("nth", F.row_number().over(mine.orderBy("arrive", "kind", "hub")) - 1).withColumn("of", F.count("*").over(mine))
        asked = settle(ranked.join(queue, "ask_id").filter("nth = turn % of").drop("nth", "of", "turn"))
        place = F.row_number().over(Window.partitionBy("flight_id").orderBy("at", "ask_id"))
        held = legs(asked, "at").withColumn("place", place).join(left.select("flight_id", "left"), "flight_id").filter("place <= left")
        both = held.groupBy("ask_id").agg(F.count("*").alias("n"))
        got = asked.join(both, "ask_id").filter(F.col("n") == F.when(F.col("second").isNull(), 1).otherwise(2))
        done = settle(done.unionByName(got.select(*done.columns)))


def rotations(legs: DataFrame, capacity: int) -> DataFrame:
    """(period, tail, recovered, flights): of each grounded aircraft the chain of legs that recovers most passengers.

    legs (period, tail, flight_id, o, z, dep, booked). One spare flies a chain:
    each leg leaves from where the last one landed, ``TURN`` after it left at the
    earliest, and takes as many of its booked passengers as the spare has seats.
    Legs go by in order of departure; per airport only the best chain that has
    landed there is kept. Of equal chains the one that ends first (then the
    smaller flight) stays. What one call holds is the legs of one aircraft in one
    period, which a timetable bounds.
    """
    def best(pdf):
        pdf = pdf.sort_values(["dep", "flight_id"])
        landed: dict[int, tuple[int, tuple]] = {}  # airport: (recovered, chain)
        flying: list[tuple[int, int, int, tuple]] = []  # (ready, airport, recovered, chain), in order
        top, at = (-1, ()), 0
        for f, o, z, dep, booked in zip(pdf["flight_id"], pdf["o"], pdf["z"], pdf["dep"], pdf["booked"]):
            while at < len(flying) and flying[at][0] <= dep:
                _, place, got, chain = flying[at]
                if place not in landed or got > landed[place][0]:
                    landed[place] = got, chain
                at += 1
            got, chain = landed.get(o, (0, ()))
            got, chain = got + min(int(booked), capacity), (f, chain)
            flying.append((dep + TURN, z, got, chain))
            if got > top[0]:
                top = got, chain
        flights, chain = [], top[1]
        while chain:
            flights.append(int(chain[0]))
            chain = chain[1]
        return pd.DataFrame({"period": pdf["period"].iloc[:1].values, "tail": pdf["tail"].iloc[:1].values, "recovered": [top[0]], "flights": [flights[::-1]]})

    kinds = {f.name: f.dataType.simpleString() for f in legs.schema}
    schema = f"period {kinds['period']}, tail {kinds['tail']}, recovered bigint, flights array<bigint>"
    return legs.select("period", "tail", "flight_id", "o", "z", "dep", "booked").groupBy("period", "tail").applyInPandas(best, schema)


def assigned(found: DataFrame, spares: int) -> DataFrame:
    """The rotations that ``spares`` aircraft fly in each period: the best ones, each of another grounded aircraft; with their rank."""
    w = Window.partitionBy("period").orderBy(F.desc("recovered"), "tail")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= spares)


def cost_of_spares(legs: DataFrame, found: DataFrame, spares: list[int], per_passenger: int) -> DataFrame:
    """(period, spares, stranded, recovered, cost): what is left to pay in each period with so many spare aircraft."""
    top = assigned(found, max(spares)).groupBy("period").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("recovered"))).alias(f"_{k}") for k in spares])
    all_of = legs.groupBy("period").agg(F.sum("booked").cast("bigint").alias("stranded")).join(top, "period")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("spares"), F.col(f"_{k}").alias("recovered")) for k in spares]))
    return all_of.select("period", "stranded", each.alias("e")).select(
        "period", "e.spares", "stranded", "e.recovered", ((F.col("stranded") - F.col("e.recovered")) * per_passenger).alias("cost"))
