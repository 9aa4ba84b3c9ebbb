"""Small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import settle

__all__ = ["settle", "read", "crc_class", "parts_of", "map_rows", "keep_rows", "told_apart"]

#: Words of 64 bits of the table by which rows are told apart before a join; it has so many rows at most, whatever the input.
WORDS = 1 << 18

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the folder with the columns it is known to have."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def crc_class(key: str, classes: int) -> Column:
    """crc32 of the id written as text, modulo ``classes``; null ids fall into class -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % classes, F.lit(-1))


def parts_of(df: DataFrame) -> int:
    """Partitions for a wide step: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
         "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
         "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def map_rows(df: DataFrame, fn: Callable[..., Iterable[tuple]], at_once: int = 1000, begin: Callable[[], object] | None = None,
             **columns: str) -> DataFrame:
    """Rows, ``at_once`` at a time, through ``fn``, which gets each column as a list and gives rows of ``columns``.

    Lists keep nulls as None and 64-bit integers whole. What ``begin`` makes at
    the start of a task is given to ``fn`` first, and goes with the task.
    """
    schema = pa.schema([(name, ARROW[kind]) for name, kind in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (begin(),) if begin else ()
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                rows = list(fn(*state, *(c.to_pylist() for c in batch.slice(k, at_once).columns)))
                values = zip(*rows) if rows else ([] for _ in schema)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    return df.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in columns.items()))


def keep_rows(df: DataFrame, column: str, wanted: Callable[[list], list[bool]], at_once: int = 1000) -> DataFrame:
    """The rows whose value of ``column`` is wanted, ``at_once`` asked at a time; all columns as they were."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                part = batch.slice(k, at_once)
                yield part.filter(pa.array(wanted(part.column(place).to_pylist()), pa.bool_()))

    place = df.columns.index(column)
    return df.mapInArrow(run, df.schema)


def told_apart(df: DataFrame, key: Column, few: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` as rows whose ``key`` may be in column ``name`` of ``few``, and rows whose key surely is not.

    Each row is in one of the two. Hashes of the keys of ``few`` set bits in a
    table of fixed size, which is broadcast; so of a wide table only what a join
    may concern has to be shuffled. With many keys more rows come out as "may be",
    and the join that follows stays exact.
    """
    word, bit = (lambda h: F.pmod(F.shiftrightunsigned(h, 6), F.lit(WORDS))), (lambda h: h.bitwiseAND(F.lit(63)).cast("int"))
    own = few.select(F.xxhash64(name).alias("_hash"))
    table = own.select(word(F.col("_hash")).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("_hash"))).alias("_bit"))
    table = table.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    hashed = df.withColumn("_hash", F.xxhash64(key)).withColumn("_word", word(F.col("_hash")))
    maybe = F.coalesce(F.getbit("_bits", bit(F.col("_hash"))) == 1, F.lit(False))
    marked = hashed.join(F.broadcast(table), "_word", "left")
    return marked.where(maybe).select(*df.columns), marked.where(~maybe).select(*df.columns)
