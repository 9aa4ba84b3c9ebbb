"""Ordered scans must give the same result whether or not a key is split over chunks."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import OrderedScan, islands, rolling


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than a third of the rows; values have NULLs and times have ties."""
    rng = random.Random(7)
    rows = []
    for i in range(1200):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(12)}"
        rows.append((i, key, rng.randrange(2000), rng.choice([None, *range(-50, 50)])))
    return spark.createDataFrame(rows, "id long, key string, t long, v long").cache()


def both(make):
    plain = sorted(map(str, make(None).collect()))
    chunked = sorted(map(str, make(40).collect()))
    return plain, chunked


def test_running_and_neighbours(skewed):
    def make(hot):
        s = OrderedScan(skewed, ["key"], ["t", "id"], hot)
        assert (s.hot is not None) == (hot is not None)
        s.running({"total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v"), "n": ("count", "v"), "seen": ("last", "v")})
        s.running({"total_before": ("sum", "v"), "seen_before": ("last", "v"), "n_before": ("count", "id")}, inclusive=False)
        s.running({"after": ("last", "v")}, reverse=True, inclusive=False)
        s.prev({"pv": "v", "pid": "id"}).next({"nv": "v", "nid": "id"})
        r = s.result()
        return r.select("id", *sorted(c for c in r.columns if c != "id"))

    plain, chunked = both(make)
    assert plain == chunked


def test_running_against_loop(skewed):
    got = {r.id: r.total for r in OrderedScan(skewed, ["key"], ["t", "id"], 40).running({"total": ("sum", "v")}).result().collect()}
    totals = {}
    for r in sorted(skewed.collect(), key=lambda r: (r.key, r.t, r.id)):
        if r.v is not None:
            totals[r.key] = (totals.get(r.key) or 0) + r.v
        assert got[r.id] == totals.get(r.key)


def test_rolling_frames(skewed):
    def make(hot):
        r = rolling(skewed, ["key"], "t", "id", {"near": ("v", 100, 0), "before": ("v", 300, 101)}, hot)
        return r.select("id", "near", "before")

    plain, chunked = both(make)
    assert plain == chunked


def test_rolling_adds_each_row_once_a_bound(spark, skewed, capsys):
    """A frame with a start is added up anew for each row: quadratic in the rows of a key."""
    odd = skewed.withColumn("t", F.when(F.col("id") % 50 != 0, F.col("t")))
    r = rolling(odd, ["key"], "t", "id", {"near": ("v", 100, 0), "before": ("v", 300, 101)})
    r.explain(True)
    frames = [f.split(")")[0] for f in capsys.readouterr().out.split("specifiedwindowframe(")[1:]]
    assert frames and all("unboundedpreceding" in f for f in frames)
    rows = odd.collect()
    at = lambda key, low, high: sum(o.v or 0 for o in rows if o.key == key and o.t is not None and low <= o.t <= high)
    none = lambda key: sum(o.v or 0 for o in rows if o.key == key and o.t is None)  # rows without a time are peers
    for g in r.filter("id % 5 = 0").collect():
        want = (at(g.key, g.t - 100, g.t), at(g.key, g.t - 300, g.t - 101)) if g.t is not None else (none(g.key), none(g.key))
        assert (g.near, g.before) == want


def test_islands(skewed):
    def make(hot):
        s = OrderedScan(skewed, ["key"], ["t", "id"], hot).prev({"pt": "t"})
        return islands(s, F.col("pt").isNull() | (F.col("t") - F.col("pt") > 20), "run").result().select("id", "run")

    plain, chunked = both(make)
    assert plain == chunked


def test_rolling_keeps_the_scale_of_decimals(skewed):
    money = skewed.withColumn("v", (F.col("v") * 0.25).cast("decimal(12,2)"))

    def make(hot):
        r = rolling(money, ["key"], "t", "id", {"near": ("v", 100, 0)}, hot)
        assert r.schema["near"].dataType.simpleString() == "decimal(22,2)"
        return r.select("id", "near")

    plain, chunked = both(make)
    assert plain == chunked and any("0.75" in r for r in plain)
    with pytest.raises(ValueError):
        rolling(skewed.withColumn("v", F.col("v").cast("double")), ["key"], "t", "id", {"near": ("v", 100, 0)})


def test_only_hot_keys_are_split(skewed):
    from ledgerloom.operators.ordered import split_hot

    nulls = skewed.withColumn("key", F.when(F.col("key") != "hot", F.col("key")))
    plain, hot, n = split_hot(nulls, ["key"], 200)
    assert {r.key for r in hot.select("key").distinct().collect()} == {None}
    assert hot.count() == n and plain.count() + n == nulls.count()
