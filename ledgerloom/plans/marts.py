"""Staging to published tables: duplicates and contradictory orders leave, the money is checked, then readers switch."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import quality as Q
from ..session import setting, shuffles_deleted
from ..sources import domain as D, sinks as W
from ..sources.tables import Tables


class Warehouse:
    """The tables of one load. They lie in a folder of their own, which readers see after ``release``."""

    def __init__(self, t: Tables, root: str):
        self.t, self.root, self.schemas = t, root, {}
        self.opened: dict[str, DataFrame] = {}
        self.build = f"{root}/build-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, monthly: bool = False, order: tuple[str, ...] = (), at: Column | None = None,
            later: Callable[[DataFrame], DataFrame] = lambda df: df, together: tuple[str, ...] = ()) -> None:
        """Writes ``df``, or what ``later`` makes of it after it is sent by month (``at``)."""
        path = f"{self.build}/{name}"
        if monthly:
            W.write_monthly(df, path, order=order, at=at, together=together, later=later)
        else:
            df.write.mode("overwrite").parquet(path, compression=W.COMPRESSION)
        self.schemas[name] = later(df).schema
        self.opened.pop(name, None)

    def put_staging(self, df: DataFrame) -> None:
        """``examined`` in one pass as two tables, staging_lines and staging_orders, each with its own columns."""
        # Both files of a task are open at a time, so its rows need no sorting by table.
        with setting(self.t.spark, "spark.sql.maxConcurrentOutputFileWriters", str(len(D.STAGING))):
            df.write.partitionBy("grain").parquet(f"{self.build}/staging", compression=W.COMPRESSION)
        for grain, columns in D.STAGING.items():
            name = f"staging_{grain}"
            self.schemas[name] = df.select(*columns).schema
            self.opened[name] = self.t.spark.read.schema(self.schemas[name]).parquet(f"{self.build}/staging/grain={grain}")

    def get(self, name: str) -> DataFrame:
        """A written table. A build is never changed once written, so its folders are listed once and not by each reader."""
        if name not in self.opened:
            self.opened[name] = self.t.spark.read.schema(self.schemas[name]).parquet(f"{self.build}/{name}")
        return self.opened[name]

    def release(self) -> None:
        W.point_to(self.t.spark, self.root, self.build)


def published(t: Tables, root: str, name: str) -> DataFrame:
    """A table of the newest released load."""
    return t.spark.read.parquet(f"{W.pointed_at(t.spark, root)}/{name}")


def steps(w: Warehouse) -> dict:
    """Writes staging, from which the rest is read, and returns what comes next; these steps do not depend on each other."""
    t = w.t
    w.put_staging(D.examined(t))
    lines, orders = w.get("staging_lines"), w.get("staging_orders")
    held = D.held_orders(t, orders)
    return {
        "sales": lambda: w.put("v_sales", D.sales_rows(t, lines), True, ("seller_id",), D.ym("purchase_date"), lambda df: D.sales_columns(t, df), ("order_id",)),
        "orders": lambda: w.put("v_orders", D.order_rows(orders), True, ("region",), D.ym("purchase_date"), lambda df: D.order_columns(t, df)),
        "held orders": lambda: w.put("quarantine_orders", held),
        "held lines": lambda: w.put("quarantine_lines", lines.filter("reason IS NOT NULL").select("order_id", "line_seq", *D.LINE_ORDER, "reason")),
    }


def wave(jobs: dict) -> None:
    """Steps that do not depend on each other; Spark runs their jobs side by side."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for job in [pool.submit(f) for f in jobs.values()]:
            job.result()


def balance(w: Warehouse) -> DataFrame:
    """Staging against the written marts and the written quarantine: one row for orders, one for lines."""
    orders = Q.reconcile(D.orders(w.t), w.get("v_orders"), w.get("quarantine_orders"), "total", "orders")
    return orders.unionByName(Q.reconcile(w.get("staging_lines"), w.get("v_sales"), w.get("quarantine_lines"), "price", "lines"))


def audit(w: Warehouse) -> None:
    """Refuse the load if rows or cents were lost or doubled on the way, or a key of a fact is not unique."""
    bad = [r["fact"] for r in balance(w).collect() if not r["balanced"]]
    if bad:
        raise Q.PublishRefused(f"{', '.join(bad)} do not balance")
    for name, keys in (("v_orders", ("order_id",)), ("v_sales", ("order_id", "line_seq"))):
        if not Q.duplicate_keys(w.get(name), *keys).isEmpty():
            raise Q.PublishRefused(f"{name} has doubled keys")


def load_marts(t: Tables, root: str) -> Warehouse:
    """The marts alone: written, audited, released."""
    w = Warehouse(t, root)
    with shuffles_deleted(t.spark):
        wave(steps(w))
        audit(w)
    w.release()
    return w
