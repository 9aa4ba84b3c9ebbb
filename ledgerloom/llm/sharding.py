"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import parts_of, settle


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, bytes of the text plus one, and the CRC of its UTF-8 bytes; the text itself goes no further."""
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut the rows, in order of ``key``, into ``shards`` runs of near-equal bytes.

    Rows are range-partitioned in that order; the totals of the partitions, one
    row each, are summed up to offsets, and a running sum inside each partition
    adds the rest. A row goes to the shard in which the middle of its bytes
    falls, so a shard is off its target by less than one row at either end.

    Columns: doc_id, size, text_crc32, law, shard, slot (0.. inside the shard),
    grown_shard (null: the law is ``bytes``).
    Defined cases: a null text has size 1 and CRC 0; null keys come first; ties
    of the key are ordered by CRC, size and place in the input, so repeated rows
    all stay, and a key with very many rows is spread over partitions like any
    other; an empty table gives no rows; other columns are not read.
    """
    sized = settle(sizes(docs, key, text).withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "row"]
    ranged = settle(sized.repartitionByRange(parts_of(docs), *order).withColumn("part", F.spark_partition_id()))

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    middle = f"(2 * (bytes_before + upto) - size) * {int(shards)} div (2 * total)"
    placed = settle(
        ranged.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.count("*").over(inside))
        .join(F.broadcast(offsets), "part")  # one row for each partition
        .select(
            "doc_id", "size", "text_crc32",
            F.expr(middle).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("place"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
