"""Stages of the pipeline, each on its own input, and the whole run."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from ledgerloom.llm import pieces, queries, stages, tiling, toxicity
from ledgerloom.llm.common import read, told_apart

from test_text_operators import ODD, brute_groups, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    docs = table(spark, ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert stages.encoded(spark, docs.limit(0), SF).count() == 0


def test_the_run_equals_its_stages_by_hand(spark):
    docs = {r.doc_id: r for r in read(spark, SF, "documents").collect()}
    model = toxicity.fit(read(spark, SF, "documents"), read(spark, SF, "labels"))
    left = {k: r for k, r in docs.items() if model.score(r.text) < 0.3}
    hosts, held = {}, {}
    for r in left.values():
        hosts.setdefault(r.source, set()).add(r.text)
        for line in r.text.split("\n"):
            held.setdefault((r.source, line.strip(" ")), set()).add(r.text)

    def cut(r):
        bad = {x for x in r.text.split("\n") if x.strip(" ") and len(held[r.source, x.strip(" ")]) >= 5
               and len(held[r.source, x.strip(" ")]) > 0.05 * len(hosts[r.source])}
        return "\n".join(x for x in r.text.split("\n") if x not in bad)

    texts = {k: cut(r) for k, r in left.items()}
    groups = brute_groups(texts)
    texts = {k: t for k, t in texts.items() if groups[k] == k}
    items = [re.findall(r"\w+", r.text.lower()) for r in read(spark, SF, "benchmark").collect()]
    block = tiling.Items([(i, " ".join(w)) for i, w in enumerate(items)], tiling.MIN_TILE, tiling.COVERAGE)
    texts = {k: t for k, t in texts.items() if not any(block.search(t))}
    model = pieces.Model(queries.PIECES)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts) and 0 < len(got) < len(docs)
    for k, t in texts.items():
        assert got[k].ids == [model.begin, *model.encode(t), model.end] and got[k].decoded == t.replace("▁", " ")


def test_texts_that_no_join_concerns_are_told_apart(spark):
    few = spark.range(0, 3000, 3).selectExpr("md5(cast(id as string)) as name")
    docs = spark.range(20_000).selectExpr("id", "md5(cast(id as string)) as text", "1 as _x").unionAll(spark.sql("SELECT -1L, NULL, 1"))
    maybe, surely_not = told_apart(docs, F.col("text"), few, "name")
    assert maybe.columns == surely_not.columns == docs.columns
    a, b = ([r.id for r in x.collect()] for x in (maybe, surely_not))
    assert sorted(a + b) == list(range(-1, 20_000)) and set(range(0, 3000, 3)) <= set(a) and len(a) < 1200
    maybe, surely_not = told_apart(docs, F.col("text"), few.limit(0), "name")
    assert maybe.isEmpty() and surely_not.count() == 20_001


def test_small_tables_of_near_dedup_are_few_files(spark, monkeypatch):
    """As many files as there are rows for, not as a shuffle has partitions: each one costs a listing and processes of the executor's."""
    written, write = [], type(spark.range(0).write).parquet
    monkeypatch.setattr(type(spark.range(0).write), "parquet", lambda self, path, *a, **b: (written.append(path), write(self, path, *a, **b))[1])
    text = " ".join(f"word{k}" for k in range(60))
    docs = table(spark, [(k, f"{text} {'more ' * (k % 3)}{k // 6}") for k in range(60)])
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        kept = {r.doc_id for r in stages.one_of_each_group(spark, docs, SF).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert kept == {k for k, root in brute_groups({r.doc_id: r.text for r in docs.collect()}).items() if k == root} and len(kept) < 60
    files = [len(spark.read.parquet(p).inputFiles()) for p in written]
    assert len(files) > 10 and max(files) <= spark.sparkContext.defaultParallelism, files
