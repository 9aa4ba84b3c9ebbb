"""Readers: typed CSV, incremental extract, rate fallback, tax-invoice XML, histories."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StringType, StructType


def read_flat(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Typed CSV with a header; rows that do not fit keep their raw text in ``_bad``."""
    return (
        spark.read.schema(f"{schema}, _bad string")
        .options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", encoding=encoding)
        .csv(path)
    )


def extract_since(df: DataFrame, column: str, watermark) -> tuple[DataFrame, DataFrame]:
    """(rows after the watermark, new watermark). The filter reaches the Parquet or JDBC scan."""
    fresh = df.filter(F.col(column) > F.lit(watermark))
    return fresh, fresh.agg(F.coalesce(F.max(column), F.lit(watermark).cast(df.schema[column].dataType)).alias("watermark"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, bounds: list[str], **options) -> DataFrame:
    """Parallel extract: one predicate per slice of ``column``."""
    preds = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(bounds, bounds[1:])]
    return spark.read.jdbc(url, table, predicates=preds, properties=options)


def first_available(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first source that has the key: live, then cache, then fallback."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("_rank", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in sources[0].columns if c not in keys]
    return out.groupBy(*keys).agg(F.min_by(F.struct("_rank", *rest), "_rank").alias("m")).select(
        *keys, *[F.col(f"m.{c}").alias(c) for c in rest], F.col("m._rank").alias("source_rank"))


def last_known(days: DataFrame, rates: DataFrame) -> DataFrame:
    """(day, rate): the day's rate or the last one before it.

    Works on distinct days, a calendar, so the window is small however many
    facts share a day; facts then join by day.
    """
    both = days.select("day").distinct().withColumn("rate", F.lit(None).cast("decimal(10,4)")).withColumn("asked", F.lit(True)).unionByName(
        rates.select("day", F.col("rate").cast("decimal(10,4)").alias("rate"), F.lit(False).alias("asked")))
    per_day = both.groupBy("day").agg(F.max("rate").alias("rate"), F.bool_or("asked").alias("asked"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.withColumn("rate", F.last("rate", ignorenulls=True).over(w)).filter("asked").select("day", "rate")


INVOICE = (
    "_Version string, _Serie string, _Folio string, _Fecha string, _Moneda string, _TipoCambio double, _Total double, _TipoDeComprobante string, "
    "Complemento struct<TimbreFiscalDigital: struct<_UUID: string>>"
)


def invoices_from_xml(df: DataFrame, column: str = "xml") -> DataFrame:
    """Tax-invoice XML (versions 3.3 and 4.0 share these attributes) to one typed row each."""
    i = F.from_xml(F.col(column), INVOICE, {"ignoreNamespace": "true", "rowTag": "Comprobante"})
    return df.withColumn("i", i).select(
        *[c for c in df.columns if c != column],
        F.col("i._Version").alias("version"), F.col("i._Serie").alias("serie"), F.col("i._Folio").alias("folio"),
        F.col("i.Complemento.TimbreFiscalDigital._UUID").alias("uuid"), F.col("i._TipoDeComprobante").alias("type"),
        F.col("i._Moneda").alias("currency"), F.coalesce("i._TipoCambio", F.lit(1.0)).alias("rate"), F.col("i._Total").alias("total"),
        F.to_date(F.substring("i._Fecha", 1, 10)).alias("date"))


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml) of loose XML files and of XML files inside ZIP archives."""
    return unpacked(spark.read.format("binaryFile").load(path))


UNPACKED = 4_000_000  # characters that leave a task together


def _texts(pdf: pd.DataFrame) -> Iterator[tuple[str, str]]:
    for p, content in zip(pdf["path"], pdf["content"]):
        if p.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for n in z.namelist():
                    if n.lower().endswith(".xml"):
                        yield f"{p}!{n}", z.read(n).decode("utf-8")
        else:
            yield p, content.decode("utf-8")


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # An archive is many times smaller than its texts, so they go out by size and not by batch of files.
    for pdf in batches:
        out, size = [], 0
        for row in _texts(pdf):
            out.append(row)
            size += len(row[1])
            if size >= UNPACKED:
                yield pd.DataFrame(out, columns=["path", "xml"])
                out, size = [], 0
        yield pd.DataFrame(out, columns=["path", "xml"])


def unpacked(files: DataFrame) -> DataFrame:
    """(path, xml) of files (path, content): loose XML as it is, archives unpacked; other entries are passed over."""
    return files.select("path", "content").mapInPandas(_unpack, StructType([StructField("path", StringType()), StructField("xml", StringType())]))


def archives(entries: DataFrame, archive: str) -> DataFrame:
    """(path, content): the entries (``archive``, name, text) of each archive as one ZIP file, in the order of their names."""
    def pack(pdf):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in sorted(zip(pdf["name"], pdf["text"])):
                z.writestr(name, text)
        return pd.DataFrame({"path": [f"{pdf[archive].iloc[0]}.zip"], "content": [out.getvalue()]})

    return entries.select(archive, "name", "text").groupBy(archive).applyInPandas(pack, "path string, content binary")


def normalise_invoices(inv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(booked, skipped): credit notes (E) subtract, payment receipts (P) are skipped, foreign totals at the invoice's rate."""
    sign = F.when(F.col("type") == "E", -1).otherwise(1)
    booked = inv.filter("type <> 'P'").withColumn("amount", F.round(F.col("total").cast("decimal(14,2)") * F.col("rate").cast("decimal(10,4)") * sign, 2).cast("decimal(14,2)"))
    return booked, inv.filter("type = 'P'")
