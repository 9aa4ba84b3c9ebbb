"""Streams over several batches must equal the batch jobs."""

import time

import pytest
from pyspark.sql import Row, functions as F

from ledgerloom.operators import fraud as R, sensors as N
from ledgerloom.plans import fraud as RP
from ledgerloom.sources import domain as D
from ledgerloom.streaming import jobs as J, keyed as S


def feed(df, folder, n, order):
    """Write ``df`` as n files in the order of ``order``; the file times keep that order."""
    rows = df.count()
    from pyspark.sql import Window
    numbered = df.withColumn("_n", F.floor((F.row_number().over(Window.orderBy(order)) - 1) * n / rows)).cache()
    for i in range(n):
        numbered.filter(F.col("_n") == i).drop("_n").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return df.schema


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_cusum_over_batches(spark, tmp_path):
    df = spark.createDataFrame([(line, i, (i * 37 + line) % 23 - 9) for line in (1, 2) for i in range(60)], "line int, slot long, d long")
    schema = feed(df, str(tmp_path / "in"), 4, "slot")
    got = S.drain_keyed(S.cusum(stream(spark, str(tmp_path / "in"), schema), 2), J.work_folder(spark, "t"))
    want = N.cusum(df, ["line"], ["slot"], "d", 2).select("line", "slot", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


READINGS = [(1, "a", 100, 1), (2, "a", 200, 2), (3, "a", 90, 3), (4, "a", 195, 4), (5, "b", 10, 5), (6, "a", 140, 6), (7, "a", 150, 7), (8, "b", 300, 8), (9, "b", 249, 9)]


def test_late_readings_come_out_with_their_reason_also_after_a_restart(spark, tmp_path):
    df = spark.createDataFrame(READINGS, "reading_id long, tag string, us long, arrival long")
    want, mark = [], {}
    for i, tag, us, _ in READINGS:
        before = mark.get(tag, us)
        want.append((tag, i, us, before, "late" if us < before - 50 else None))
        mark[tag] = max(before, us)
    folder, work = str(tmp_path / "in"), J.work_folder(spark, "t")
    for part in (df.filter("arrival <= 5"), df.filter("arrival > 5")):  # stopped in between; the state goes on
        part.coalesce(1).write.mode("append").parquet(folder)
        got = S.drain_keyed(S.lateness(stream(spark, folder, df.schema), 50), work)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert [w[1] for w in want if w[4]] == [3, 6, 9]


def test_a_silent_source_is_told_once_by_timer_or_by_its_next_reading(spark, tmp_path):
    second = 1_000_000
    rows = [(1, 0), (2, 1), (1, 5), (2, 40), (1, 100), (2, 41), (1, 101), (1, 130)]  # 1 is back after 95 s, 2 after 39 s and then never
    df = spark.createDataFrame([(s, t) for s, t in rows], "source int, at long").withColumn("ts", F.timestamp_seconds("at"))
    for n in (1, 4):
        folder = str(tmp_path / f"in{n}")
        fed = J.feed(df, "at", n, folder)
        got = S.drain_keyed(S.silences(fed, 30 * second, "5 seconds"), J.work_folder(spark, "t"))
        found = sorted((r.source, r.last_us // second, r.down_us // second) for r in got.collect())
        assert found == [(1, 5, 35), (2, 1, 31), (2, 41, 71)]
        assert {r.source for r in got.filter("told_by = 'timer'").collect()} >= {2}


def test_replays_in_later_batches_are_logged(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "a"), (3, 1, "c")], "id long, attempt int, v string").withColumn("n", F.monotonically_increasing_id())
    df = spark.createDataFrame([(1, 1, "a", 1), (2, 1, "b", 2), (1, 2, "a", 3), (3, 1, "c", 4)], "id long, attempt int, v string, n int")
    schema = feed(df, str(tmp_path / "in"), 4, "n")
    applied, dup = J.apply_with_log(stream(spark, str(tmp_path / "in"), schema), "id", ["attempt"], J.work_folder(spark, "t"))
    assert sorted((r.id, r.attempt) for r in applied.collect()) == [(1, 1), (2, 1), (3, 1)] and [(r.id, r.duplicates) for r in dup.collect()] == [(1, 1)]


def test_sync_never_duplicates(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2), (2, "b", 1)], "id long, v string, version int").withColumn("n", F.col("version"))
    schema = feed(df, str(tmp_path / "in"), 2, "n")
    got = J.sync(stream(spark, str(tmp_path / "in"), schema), "id", "version", J.work_folder(spark, "t"))
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "c"), (2, "b")]


def test_stream_scores_have_the_history_of_the_customer(spark, tables, tmp_path):
    o = D.operations(tables).filter("customer < 8")
    feats = R.features(o, RP.balances(tables), RP.P)
    back = feats.join(R.OrderedScan(o, ["customer"], ["us", "op_id"]).running({"b": ("last", F.when(F.col("card_present"), F.struct("us", "city")))}, inclusive=False).result().select("op_id", "b"), "op_id")
    back = back.withColumn("impossible", F.col("card_present") & R.too_fast("b", RP.P))
    want = sorted((r.op_id, r.score, "; ".join(r.reasons)) for r in R.score(back, RP.P).collect())
    folder, work = str(tmp_path / "in"), J.work_folder(spark, "t")
    low, high = o.agg(F.min("us"), F.max("us")).first()
    for i in range(5):  # stopped after each batch: what is asked of the past is in the state alone
        o.filter(F.floor((F.col("us") - low) * 5 / (high + 1 - low)) == i).coalesce(1).write.mode("append").parquet(folder)
        got = S.drain_keyed(S.score(stream(spark, folder, o.schema), RP.balances(tables), RP.P), work)
    assert sorted(map(tuple, got.collect())) == want and len({w[1] for w in want}) > 3


def test_scores_are_revised_when_the_next_operation_is_known(spark, tables, tmp_path):
    o = D.operations(tables).filter("customer < 8")
    want = sorted((r.op_id, r.score, "; ".join(r.reasons)) for r in R.score(R.features(o, RP.balances(tables), RP.P), RP.P).collect())
    fed = J.feed(o, "us", 5, str(tmp_path / "in"))
    table = S.drain_keyed(S.score(fed, RP.balances(tables), RP.P, ahead=True), J.work_folder(spark, "t"))
    assert sorted(map(tuple, S.newest(table).collect())) == want
    assert table.filter("revised = 1").count() > 0 and table.filter("revised = 0").count() == len(want)


class Calls:
    """A handle, its state and its timers in one, which notes what is asked of it."""

    def __init__(self):
        self.value, self.asked, self.timers = None, [], set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.asked.append("get")
        return self.value

    def exists(self):
        self.asked.append("exists")
        return self.value is not None

    def update(self, value):
        self.asked.append("update")
        self.value = value

    def registerTimer(self, at):
        self.asked.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.asked.append("delete")
        self.timers.remove(at)

    def listTimers(self):
        self.asked.append("list")
        return iter(sorted(self.timers))


def test_a_source_costs_four_calls_of_the_state_a_batch():
    silence, calls = S.Silence(30_000_000), Calls()
    silence.init(calls)
    told = []
    for batch in ([5, 1], [20], [60, 61]):
        calls.asked.clear()
        told += [tuple(r) for r in silence.handleInputRows((7,), iter([Row(us=s * 1_000_000) for s in batch]), None)]
        assert len(calls.asked) <= 4 and calls.timers == {(max(batch) + 30) * 1000}
    assert told == [(7, 20_000_000, 50_000_000, "reading")]


def test_a_sync_reads_only_the_buckets_of_its_batch(spark, tmp_path):
    """Ten batches, each of 40 new keys and new versions of 10 old ones next to them."""
    rows = [(n * 40 + i, n, f"{n}") for n in range(10) for i in range(40)] + [(n * 40 + i - 10, n, f"again {n}") for n in range(1, 10) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, version int, v string")
    work = J.work_folder(spark, "t")
    fed = J.feed(df, "version", 10, str(tmp_path / "in"))
    got = J.sync(fed, "id", "version", work, F.floor(F.col("id") / 20))
    want = {}
    for i, n, v in sorted(rows, key=lambda r: r[1]):
        want[i] = (i, n, v)
    assert sorted(map(tuple, got.collect())) == sorted(want.values())
    target = J.Target(spark, f"{work}/target", df.schema, "id", "version", F.floor(F.col("id") / 20))
    read = [target.parts(n).agg(F.sum("was_read")).first()[0] for n in range(10)]
    assert read == [0] + [20] * 9  # of 360 rows at the end
    again = df.filter("version = 9")
    target.upsert(again, 9)  # a repeated batch
    assert sorted(map(tuple, target.rows().collect())) == sorted(want.values())
    hashed = J.sync(J.feed(df, "version", 3, str(tmp_path / "in3")), "id", "version", J.work_folder(spark, "t"))
    assert sorted(map(tuple, hashed.collect())) == sorted(want.values())


def test_the_log_of_replays_reads_no_former_batch(spark, tmp_path):
    rows = [(i % 7, i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, attempt int, n int")
    applied, dup = J.apply_with_log(J.feed(df, "n", 6, str(tmp_path / "in")), "id", ["attempt"], J.work_folder(spark, "t"))
    assert sorted(map(tuple, applied.collect())) == [(i, i, i) for i in range(7)]
    assert sorted(map(tuple, dup.collect())) == [(i, sum(r[0] == i for r in rows) - 1) for i in range(7)]
