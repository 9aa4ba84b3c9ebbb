"""Template ingest: tolerant headers, local number and date formats, row-level rejects."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Field:
    name: str
    header: str
    kind: str  # text | int | money | date | option
    options: tuple[str, ...] = ()
    required: bool = True


def plain(text: str) -> str:
    """Header without accents, case and outer blanks. Headers are few and known on the driver."""
    n = unicodedata.normalize("NFKD", text)
    return "".join(c for c in n if not unicodedata.combining(c)).strip().casefold()


def amount(c: Column) -> Column:
    """``$12,500.00`` to decimal; NULL when unreadable."""
    return F.regexp_replace(F.trim(c), r"[$,\s]", "").try_cast("decimal(12,2)")


def local_date(c: Column) -> Column:
    """``15/03/2026``, ``2026-03-15`` or an Excel day number; NULL when unreadable."""
    serial = F.when(F.trim(c).rlike(r"^[0-9]{1,6}$"), F.date_add(F.lit("1899-12-30").cast("date"), F.trim(c).try_cast("int")))
    return F.coalesce(serial, F.try_to_date(F.trim(c), "dd/MM/yyyy"), F.try_to_date(F.trim(c), "yyyy-MM-dd"))


def option(c: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed value equal to ``c`` but for case and accents."""
    out = F.lit(None).cast("string")
    for a in allowed:
        out = F.when(F.collate(F.trim(c), "UNICODE_CI_AI") == F.collate(F.lit(a), "UNICODE_CI_AI"), F.lit(a)).otherwise(out)
    return out


def parse(f: Field, c: Column) -> Column:
    return {
        "text": lambda: F.trim(c),
        "int": lambda: F.trim(c).try_cast("bigint"),
        "money": lambda: amount(c),
        "date": lambda: local_date(c),
        "option": lambda: option(c, f.options),
    }[f.kind]()


def read_template(df: DataFrame, spec: list[Field]) -> DataFrame:
    """Typed columns plus ``reasons``; rows with reasons are to be rejected, the rest load."""
    heads = {plain(c): c for c in df.columns}
    missing = [f.header for f in spec if f.required and plain(f.header) not in heads]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cols, reasons = [], []
    for f in spec:
        src = heads.get(plain(f.header))
        raw = F.col(f"`{src}`") if src else F.lit(None).cast("string")
        val = parse(f, raw)
        cols.append(val.alias(f.name))
        empty = raw.isNull() | (F.trim(raw) == "")
        if f.required:
            reasons.append(F.when(empty, F.lit(f"{f.header}: empty")))
        reasons.append(F.when(~empty & val.isNull(), F.lit(f"{f.header}: not a valid {f.kind}")))
    return df.select(*cols, F.array_compact(F.array(*reasons)).alias("reasons"))
