"""Structured Streaming jobs. State and results live in tables of the shared folder, never on the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import hub as H
from ..session import checkpoint_dir


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/stream/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, folder: str, name: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def drain(stream: DataFrame, work: str) -> DataFrame:
    """Run an append-mode stream over what is there now into a Parquet table and return the table."""
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{work}/progress")
        .option("path", f"{work}/out").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{work}/out")


def drain_batches(stream: DataFrame, work: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream batch by batch. ``handle`` may be called again for a batch, so it writes by batch id."""
    q = (
        stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", f"{work}/progress")
        .trigger(availableNow=True).start())
    q.awaitTermination()


def put(df: DataFrame, table: str, batch: int) -> None:
    """Write one batch of a table; repeating the batch replaces it."""
    df.write.mode("overwrite").parquet(f"{table}/batch={batch}")


def stored(spark: SparkSession, table: str, schema, before: int | None = None) -> DataFrame:
    """A table written by ``put``; with ``before`` only the batches ahead of that one."""
    try:
        df = spark.read.schema(schema).option("basePath", table).parquet(table)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return df if before is None else df.filter(F.col("batch") < before)


def _with_batch(schema_ddl: str) -> str:
    return f"{schema_ddl}, batch int"


# ------------------------------------------------------------------ windows
def as_event_time(df: DataFrame, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def samples(readings: DataFrame, width: str, delay: str) -> DataFrame:
    """Tumbling samples per tag; late readings are waited for by source time up to ``delay``."""
    return as_event_time(readings, delay).groupBy(F.window("ts", width).alias("w"), "tag").agg(
        F.count("*").alias("n"), F.sum("centi").alias("centi")).select("tag", F.unix_micros("w.start").alias("slot"), "n", "centi")


def decoy_passes(changes: DataFrame, delay: str) -> DataFrame:
    """Touched decoys per machine in 15-minute passes."""
    return as_event_time(changes, delay).groupBy(F.window("ts", "15 minutes").alias("w"), "machine").agg(
        F.count("*").alias("alarms")).select("machine", F.unix_micros("w.start").alias("pass_us"), "alarms")


def apply_once(deliveries: DataFrame, key: str, delay: str) -> DataFrame:
    """Each delivery once; replays within the watermark are dropped."""
    return as_event_time(deliveries, delay).dropDuplicatesWithinWatermark([key])


def later_match(left: DataFrame, right: DataFrame, within: str, delay: str) -> DataFrame:
    """Operation to the later record that names it (left outer, both sides watermarked).

    left (op_id, ts), right (about, ts, other_id). The equi key is the operation
    itself, so no two unrelated rows of a customer are paired.
    """
    a = as_event_time(left, delay).alias("a")
    b = right.withColumn("other_ts", F.col("ts").cast("timestamp")).drop("ts").withWatermark("other_ts", delay).alias("b")
    on = (F.col("a.op_id") == F.col("b.about")) & (F.col("b.other_ts") >= F.col("a.ts")) & (F.col("b.other_ts") <= F.col("a.ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on, "left_outer").select("a.op_id", "a.ts", "b.other_id")


# ------------------------------------------------------------------ jobs with kept state
def apply_with_log(deliveries: DataFrame, key: str, order: list[str], work: str) -> tuple[DataFrame, DataFrame]:
    """(applied, duplicates): like ``apply_once``, and every replay is recorded.

    The state store holds a row per key, so a batch asks for its own keys and
    reads no table. All rows of a batch bear its time, so a key is new where its
    oldest and newest times are the same. What is written is a log of the keys a
    batch touched; a read keeps the row that was new and the largest total.
    """
    spark, schema = deliveries.sparkSession, deliveries.schema
    rest = [c for c in schema.names if c != key and c not in order]
    seen = deliveries.withColumn("_in", F.current_timestamp()).groupBy(key).agg(
        F.min(F.struct("_in", *order, *rest)).alias("_f"), F.max("_in").alias("_last"), F.count("*").alias("_n"))
    log = seen.select(key, *[F.col(f"_f.{c}").alias(c) for c in (*order, *rest)], (F.col("_f._in") == F.col("_last")).alias("_new"), (F.col("_n") - 1).alias("_again"))
    drain_batches(log, work, lambda batch, n: put(batch, f"{work}/touched", n), "update")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema)
    touched = stored(spark, f"{work}/touched", _with_batch(ddl))
    return (touched.filter("_new").select(*schema.names),
            touched.filter("_again > 0").groupBy(key).agg(F.max("_again").alias("duplicates")))


def feed(df: DataFrame, order: str, batches: int, folder: str) -> DataFrame:
    """``df`` as a stream of so many batches, in the order of a whole-number column: one file set after the other."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    for i in range(batches if low is not None else 0):
        at = lambda k: low + (high + 1 - low) * k // batches
        df.filter(F.col(order).between(at(i), at(i + 1) - 1)).coalesce(1).write.mode("append").parquet(folder)
    r = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return r.parquet(folder)


PARTS = "bucket bigint, version int, rows bigint, was_read bigint"


class Target:
    """A table in buckets of its keys, of which a batch reads and rewrites those it touches.

    ``parts`` names for each batch where each bucket is: the batch that wrote it
    last. A batch starts from the parts of the one before, so a repeated batch
    does what it did, and a reader sees the old parts until the new ones are
    written. Buckets are hashes of the key by default; with ``bucket`` they may be
    ranges, so that batches on recent keys leave the older buckets alone.
    """

    def __init__(self, spark: SparkSession, root: str, schema, key: str, version: str, bucket: Column | None = None, buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.version = spark, root, schema, key, version
        self.bucket = F.pmod(F.xxhash64(key), F.lit(buckets)) if bucket is None else bucket

    def newest(self, df: DataFrame) -> DataFrame:
        """The newest version per key; of equal ones the larger row, so that the order of arrival says nothing."""
        rest = [c for c in self.schema.names if c not in (self.key, self.version)]
        pick = df.groupBy(self.key).agg(F.max(F.struct(self.version, *rest)).alias("m"))
        return pick.select(*[self.key if c == self.key else F.col(f"m.{c}").alias(c) for c in self.schema.names])

    def parts(self, batch: int | None = None) -> DataFrame:
        """(bucket, version, rows, was_read) as of a batch, or the last one; a row per bucket."""
        all_parts = stored(self.spark, f"{self.root}/parts", _with_batch(PARTS))
        at = F.lit(batch) if batch is not None else F.lit(all_parts.agg(F.max("batch")).first()[0])
        return all_parts.filter(F.col("batch") == at).drop("batch")

    def files(self, parts: list) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/rows/version={p.version}/bucket={p.bucket}" for p in parts])

    def upsert(self, batch: DataFrame, n: int) -> None:
        batch = self.newest(batch).persist()
        before = self.parts(n - 1).collect()  # a row per bucket
        touched = {r[0] for r in batch.select(self.bucket.cast("bigint")).distinct().collect()}
        old = [p for p in before if p.bucket in touched]
        out = self.newest(self.files(old).unionByName(batch)).withColumn("bucket", self.bucket.cast("bigint"))
        folder = f"{self.root}/rows/version={n}"
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        batch.unpersist()
        sizes = {r.bucket: r["count"] for r in self.spark.read.schema(f"`{self.key}` {self.schema[self.key].dataType.simpleString()}, bucket bigint")
                 .parquet(folder).groupBy("bucket").count().collect()} if touched else {}
        was = {p.bucket: p.rows for p in old}
        now = [(b, n, k, was.get(b, 0)) for b, k in sizes.items()] + [(p.bucket, p.version, p.rows, 0) for p in before if p.bucket not in touched]
        put(self.spark.createDataFrame(now, PARTS).coalesce(1), f"{self.root}/parts", n)

    def rows(self) -> DataFrame:
        return self.files(self.parts().collect())


def sync(changes: DataFrame, key: str, version: str, work: str, bucket: Column | None = None) -> DataFrame:
    """Incremental sync that never duplicates: the target holds the newest version per key, see ``Target``."""
    target = Target(changes.sparkSession, f"{work}/target", changes.schema, key, version, bucket)
    drain_batches(changes, work, target.upsert)
    return target.rows()


def route(rows: DataFrame, mapping: DataFrame, key: str, work: str) -> tuple[DataFrame, DataFrame]:
    """(applied, dead letters) of a stream; a sweep re-reads the dead-letter table later."""
    spark = rows.sparkSession
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names = rows.schema.names

    def handle(batch: DataFrame, n: int) -> None:
        ok, dead = H.route(batch, mapping, key)
        put(ok.select(*names), f"{work}/applied", n)
        put(dead.select(*names, "reason"), f"{work}/dead", n)

    drain_batches(rows, work, handle)
    return (stored(spark, f"{work}/applied", _with_batch(ddl)).drop("batch"), stored(spark, f"{work}/dead", _with_batch(f"{ddl}, reason string")).drop("batch"))
