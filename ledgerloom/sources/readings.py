"""Sensor payloads: a list of tag readings, or a snapshot of one instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LISTED = "lecturas array<struct<etiqueta: string, ts: double, valor: double>>"
SNAPSHOT = "ts double, presiones map<string, double>, q_entrada double, q_salida double"


def from_payloads(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies of either shape to (tag, ts, value); works on batch and streaming input alike."""
    both = df.select(F.from_json(body, LISTED).alias("l"), F.from_json(body, SNAPSHOT).alias("s"))
    flows = F.map_filter(F.create_map(F.lit("q_entrada"), F.col("s.q_entrada"), F.lit("q_salida"), F.col("s.q_salida")), lambda _, v: v.isNotNull())
    shot = F.transform(F.map_entries(F.map_concat(F.coalesce("s.presiones", F.create_map().cast("map<string,double>")), flows)),
                       lambda e: F.struct(e["key"].alias("etiqueta"), F.col("s.ts").alias("ts"), e["value"].alias("valor")))
    rows = both.select(F.explode(F.coalesce("l.lecturas", shot)).alias("r"))
    return rows.select(F.col("r.etiqueta").alias("tag"), F.timestamp_seconds("r.ts").alias("ts"), F.col("r.valor").alias("value"))


def confirmed_taps(spark: SparkSession, path: str, utc_offset_hours: float = 0) -> DataFrame:
    """(tap_id, us, km, caudal, descripcion) of taps confirmed in the field: a CSV of ``t_inicio,km[,caudal,descripcion]``.

    The start is written by the clock of the field crew, so many hours from that
    of the readings; it becomes UTC here. The two last columns may be missing.
    Rows without a start or a place that can be read are no taps; rows that say
    the same are one tap, known by its content.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    has = {c.strip().lower(): c for c in raw.columns}
    text = lambda c: F.trim(F.col(f"`{has[c]}`")) if c in has else F.lit(None).cast("string")
    shift = F.lit(round(utc_offset_hours * 3_600_000_000)).cast("bigint")
    flow = F.coalesce(text("caudal").try_cast("double"), text("caudal_m3h").try_cast("double"))
    rows = raw.select((F.unix_micros(text("t_inicio").try_cast("timestamp")) - shift).alias("us"), text("km").try_cast("double").alias("km"), flow.alias("caudal"), text("descripcion").alias("descripcion"))
    rows = rows.filter("us IS NOT NULL AND km IS NOT NULL").distinct()
    return rows.select(F.xxhash64("us", "km", "caudal", F.coalesce("descripcion", F.lit(""))).alias("tap_id"), "*")
