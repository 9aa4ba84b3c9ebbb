"""A corpus pipeline of the text operators: toxicity, line dedup, near-dedup, decontamination, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import stages
from ledgerloom.session import checkpoint_dir

#: Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
STAGES = [
    ("toxicity", stages.without_toxic),
    ("line_dedup", stages.without_boilerplate),
    ("simhash_near_dedup", stages.one_of_each_group),
    ("decontamination", stages.without_benchmark),
    ("sentencepiece", stages.encoded),
]

#: The stages learn, hash and tokenise, which SQL cannot say; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
