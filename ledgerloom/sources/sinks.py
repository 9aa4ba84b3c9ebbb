"""Writers: table replacement, export with manifest and DDL, wide tables by month, logs by day."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, StructType

SEVERITIES = ("critical", "high", "medium", "low")
#: Of the tables of a load.
COMPRESSION = "zstd"
PERSONAL = ("customer_id", "customer_name", "name", "email")


def replace_table(df: DataFrame, root: str, name: str) -> str:
    """Reloading one table replaces it; the others stay."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_monthly(df: DataFrame, path: str, month: str = "ym", order: tuple[str, ...] = (), at: Column | None = None,
                  together: tuple[str, ...] = (), later: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Wide table partitioned by month. Rows are sent to the tasks by month and a salt, so that
    a month makes few files and a very large month is still written by several tasks. In ``order``,
    files let a reader of one seller or region skip most of their pages.

    Columns that follow from others are added by ``later``, after the rows are sent; ``at`` is the month of a row before.
    Rows alike in ``together`` come to one file, where a reader can count them as one before it sends anything."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*(together or df.columns)), F.lit(max(1, n // 4)))
    sent = df.repartition(n, F.col(month) if at is None else at, salt)
    later(sent).sortWithinPartitions(month, *order).write.mode("overwrite").partitionBy(month).parquet(path, compression=COMPRESSION)


def point_to(spark: SparkSession, root: str, build: str) -> None:
    """Make ``build`` what readers of ``root`` see. A pointer is added and never replaced,
    so at no moment is there none; the newest one counts."""
    row = [(time.time_ns(), build)]
    spark.createDataFrame(row, "version bigint, location string").coalesce(1).write.mode("append").json(f"{root}/current")


def pointed_at(spark: SparkSession, root: str) -> str:
    pointers = spark.read.schema("version bigint, location string").json(f"{root}/current")
    return pointers.agg(F.max_by("location", "version")).first()[0]


def write_daily(df: DataFrame, path: str, first: str | None = None, last: str | None = None, day: str = "sent") -> None:
    """Log partitioned by day. A run from ``first`` to ``last`` replaces all days of that range,
    also those for which it has no row now; without a range it replaces the whole log."""
    spark = df.sparkSession
    if first is not None and last is not None:
        old = read_daily(spark, path)
        df = df.unionByName(old.filter(~F.col(day).between(first, last)).select(*[F.col(f.name).cast(f.dataType) for f in df.schema]))
    build = f"{path}/build-{uuid.uuid4().hex}"
    df.repartition(F.col(day)).write.partitionBy(day).parquet(build)
    point_to(spark, path, build)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(pointed_at(spark, path))


def write_findings(df: DataFrame, path: str) -> None:
    """Findings in order of severity, each with the note that a person has to review it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    rank = F.when(rank == 0, len(SEVERITIES) + 1).otherwise(rank)
    rest = [c for c in df.columns if c != "severity"]
    df.withColumn("note", F.lit("validate before delivery")).sort(rank, *rest).write.mode("overwrite").json(path)


def ddl_type(t: DataType) -> str:
    """Spark type to the warehouse type of the export."""
    if isinstance(t, DecimalType):
        return f"decimal({t.precision},{t.scale})"
    if isinstance(t, ArrayType):
        return f"array<{ddl_type(t.elementType)}>"
    return {"timestamp_ntz": "timestamp"}.get(t.simpleString(), t.simpleString())


def ddl(name: str, schema: StructType, location: str) -> str:
    cols = ",\n  ".join(f"`{f.name}` {ddl_type(f.dataType)}" for f in schema)
    return f"CREATE EXTERNAL TABLE {name} (\n  {cols}\n)\nSTORED AS PARQUET\nLOCATION '{location}'"


def manifest(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per table: name, rows, purpose, columns, columns about customers."""
    out = None
    for name, (df, purpose) in tables.items():
        personal = [c for c in df.columns if c in PERSONAL]
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(purpose).alias("purpose"), F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(personal)).alias("customer_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def export(tables: dict[str, tuple[DataFrame, str]], root: str) -> DataFrame:
    """One Parquet folder per table, a manifest and the DDL; returns the manifest."""
    spark: SparkSession = next(iter(tables.values()))[0].sparkSession
    written = {}
    for name, (df, purpose) in tables.items():
        path = replace_table(df, root, name)
        written[name] = (spark.read.schema(df.schema).parquet(path), purpose)
    m = manifest(written)
    m.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    texts = [(n, ddl(n, d.schema, f"{root}/{n}")) for n, (d, _) in tables.items()]
    spark.createDataFrame(texts, "table_name string, ddl string").coalesce(1).write.mode("overwrite").json(f"{root}/ddl")
    return spark.read.schema(m.schema).json(f"{root}/manifest")
