"""Where the named queries live: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, text: str) -> None:
    """Declare a named relation the oracle texts may use; names start with ``x_``."""
    CTES[name] = text.strip()


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\bx_\w+", text):
        if name in CTES and name not in seen:
            _needed(CTES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def oracle_text(name: str) -> str:
    """The oracle with the relations it uses in front of it."""
    body = ORACLES[name]
    heads = [f"{n} AS (\n{CTES[n]}\n)" for n in _needed(body, [])]
    if not heads:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(heads) + ",\n" + body[5:]
    return "WITH " + ",\n".join(heads) + "\n" + body


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return QUERIES[name](Tables(spark, folder))
