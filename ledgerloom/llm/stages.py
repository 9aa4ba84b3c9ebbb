"""The stages of the corpus pipeline: (spark, docs, folder) -> DataFrame.

All but the last return the columns of ``docs``. Rows equal in doc_id and text
stay or go together; a row without a doc_id is judged by its text like any other.
Null and empty texts pass the filters of toxicity and benchmark; of all rows
without a text, the near-duplicate stage keeps the first. Texts of any length go
whole through every stage; an empty table stays empty; columns of other names
are handed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import lines, pieces, simhash, tiling, toxicity
from .common import read, settle, told_apart
from .queries import PIECES


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents scored toxic go. The labels, and the texts they mark, are those of the folder."""
    model = toxicity.fit(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return toxicity.without_toxic(docs, model)


def without_boilerplate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Boilerplate lines go; every document stays, with its number of characters put right."""
    out = lines.drop_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-copies, verified at five words and 0.8, the document with the smallest doc_id stays."""
    gone = simhash.near_copies(docs).where(~F.col("kept")).select(F.col("page").alias("gone_page"), F.col("doc_id").alias("gone_id")).distinct()
    gone = settle(gone, docs.count())
    maybe, stays = told_apart(docs, simhash.page_of("text"), gone, "gone_page")  # texts that surely stay are not shuffled
    same = (simhash.page_of("text") == gone.gone_page) & maybe["doc_id"].eqNullSafe(gone.gone_id)
    return stays.unionAll(maybe.join(gone, same, "left_anti").select(*docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return tiling.clean(docs, read(spark, folder, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The ids of what is left, and the digests of the ids and of what they decode to."""
    return pieces.encode_documents(docs, PIECES, ids=True)
