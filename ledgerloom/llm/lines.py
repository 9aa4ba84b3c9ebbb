"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle

#: Share of a site's pages from which a line is boilerplate.
RATIO = 0.05
#: Pages that must hold a line before its share means anything.
MIN_PAGES = 5


def _key(line: Column) -> Column:
    """128 bits of a line without the spaces around it."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row for each site with boilerplate: ``site`` and the array ``drop`` of its line keys.

    A line is boilerplate if more than ``ratio`` of the site's pages, and
    ``min_pages`` at least, contain it. Pages with one and the same text are one
    page, or a much mirrored page would be boilerplate from end to end. A page
    counts a line once. Both counts are combined before the shuffle, so a site
    with most of the pages or a line on all of them is one row for each task.
    The array is bounded: a page of L lines holds L boilerplate lines at most, so
    a site has less than (mean lines of a page) / ratio of them.
    """
    pages = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(host), F.lit("")).alias("site"), F.md5(text).alias("page"), F.col(text).alias("text"))
    totals = pages.groupBy("site").agg(F.count_distinct("page").alias("pages"))
    held = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))
    lines = pages.select("site", "page", F.explode(held).alias("line"))
    seen = lines.groupBy("site", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_pages)
    return (
        seen.join(totals, "site")
        .where(F.col("n") > ratio * F.col("pages"))
        .groupBy("site").agg(F.collect_list("line").alias("drop"))
    )


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines cut out of ``text``; adds ``n_lines`` and ``n_dropped``.

    The few boilerplate keys are written first, so Spark knows their size and
    broadcasts them only below its threshold; else it joins by site and splits a
    hot site. Texts never pass through a grouping.
    Defined cases: a null text stays null with no lines; an empty text has one
    line, which is blank; blank lines are never dropped; null and empty hosts are
    one site; columns of these names in ``docs`` are replaced, others kept.
    """
    found = settle(boilerplate(docs, host, text, ratio, min_pages), docs.count())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.coalesce(F.col(host), F.lit("")).alias("site"))
    split = F.split(F.col(f"d.{text}"), "\n")
    kept = F.when(F.col("drop").isNull(), split).otherwise(
        F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), _key(x))))
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    return (
        rows.join(found, "site", "left")
        .withColumn("kept", kept)
        .select(
            *[F.col(f"d.`{c}`").alias(c) for c in others],
            F.when(F.col("drop").isNull(), F.col(f"d.{text}")).otherwise(F.array_join("kept", "\n")).alias(text),
            F.coalesce(F.size(split), F.lit(0)).alias("n_lines"),
            F.coalesce(F.size(split) - F.size("kept"), F.lit(0)).alias("n_dropped"),
        )
    )
