"""Session helpers. Library code never creates a session; tests, bench and scripts do."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a file, where a table is written in files of a size.
FILE_ROWS = 250_000


def local_session(cpus: int | str = 8, app: str = "ledgerloom", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` wins. A private folder is made only where the
    setting is absent and the session is local, as in tests; a cluster without
    the setting is a configuration error, because a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, about: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write an intermediate table once and go on from the written copy.

    For results that several later steps read (a series table, the judged
    series), so the facts behind them are read once. The copy lies in the shared
    checkpoint folder and survives the loss of executors; its retention is the
    folder's.

    Where it is known that there are ``about`` so many rows at most, the last step
    runs in tasks for ``file_rows`` each, one for each core at least, and not in as
    many as a shuffle has. Each file costs a listing and, on a local disk, a process
    of the executor's for each of its permissions, so small tables want few.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    if about is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-about // file_rows)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, as it was before afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_deleted(spark: SparkSession):
    """Within, the shuffle files of a step are deleted when it ends. Otherwise they lie on the disks of the executors
    until the driver's collector finds the plan gone, so those of a whole load add up."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def literals(one_row: DataFrame) -> dict[str, Column]:
    """The single row of an ungrouped aggregate as literal columns.

    A literal is pushed down to the scan, where a join with a one-row table is not.
    """
    row = one_row.first()
    return {f.name: F.lit(row[f.name]).cast(f.dataType) for f in one_row.schema}
