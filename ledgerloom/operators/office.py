"""Calendar, follow-up and decoy analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import OrderedScan

MINUTE = 60_000_000
URGENT = r"\b(urgent|asap|immediately|error)\b"
SCHEDULE = r"\b(meet|meeting|schedule|calendar|appointment)\b"


def conflicts(meetings: DataFrame) -> DataFrame:
    """(meeting_id, owner, start, end) plus overlaps: how many meetings of the owner overlap this one.

    Overlaps = meetings that start before this one ends, minus those that ended by
    its start, minus itself. Both come from running counts over start and end
    points, so no pair of meetings is formed.
    """
    points = meetings.select("owner", "meeting_id", F.explode(F.array(
        F.struct(F.col("end").alias("at"), F.lit(0).alias("k"), F.lit("end").alias("what")),
        F.struct(F.col("start").alias("at"), F.lit(1).alias("k"), F.lit("ask start").alias("what")),
        F.struct(F.col("end").alias("at"), F.lit(1).alias("k"), F.lit("ask end").alias("what")),
        F.struct(F.col("start").alias("at"), F.lit(2).alias("k"), F.lit("start").alias("what")))).alias("p")).select("owner", "meeting_id", "p.*")
    scan = OrderedScan(points, ["owner"], ["at", "k", "meeting_id", "what"])
    scan.running({"ended": ("sum", (F.col("what") == "end").cast("int")), "started": ("sum", (F.col("what") == "start").cast("int"))})
    g = scan.result().groupBy("meeting_id").agg(
        F.max(F.when(F.col("what") == "ask end", F.col("started"))).alias("s"), F.max(F.when(F.col("what") == "ask start", F.col("ended"))).alias("e"))
    return meetings.join(g.select("meeting_id", (F.col("s") - F.col("e") - 1).alias("overlaps")), "meeting_id")


def free_slots(meetings: DataFrame, min_gap: int) -> DataFrame:
    """Gaps of an owner between the latest end so far and the next start, on one day."""
    scan = OrderedScan(meetings, ["owner"], ["start", "meeting_id"]).running({"busy_until": ("max", "end")}).next({"next_start": "start"})
    day = 24 * 60 * MINUTE
    same = F.floor(F.col("busy_until") / day) == F.floor(F.col("next_start") / day)
    return scan.result().filter((F.col("next_start") - F.col("busy_until") >= min_gap) & same).select(
        "owner", F.col("busy_until").alias("free_from"), F.col("next_start").alias("free_to"))


def encroaches(start: Column, end: Column, from_min: int, to_min: int) -> Column:
    """The meeting touches the daily focus block."""
    day = 24 * 60 * MINUTE
    base = F.floor(start / day) * day
    return (start < base + to_min * MINUTE) & (end > base + from_min * MINUTE)


def last_turns(messages: DataFrame) -> DataFrame:
    """The last turn of each thread, by aggregation."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max(F.struct("turn", "role", "text")).alias("m")).select("conv_id", "n_turns", "m.*")


def triage(text: Column, role: Column) -> Column:
    """Rules in order; the whole text is read."""
    t = F.lower(text)
    return (
        F.when(t.rlike(URGENT), "urgent").when(t.rlike(SCHEDULE), "schedule")
        .when(t.contains("?") | (role == "user"), "needs reply").otherwise("fyi"))
