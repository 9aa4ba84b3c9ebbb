"""Headline timings: ``python bench.py`` prints one JSON line.

The load builds the wide tables; each page is then read for the three roles,
first run and median of three. A few single operators are timed on the raw tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans import catalog, pages, registry
from ledgerloom.session import checkpoint_dir, local_session
from ledgerloom.sources.tables import Tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SINGLE = [
    "k00_kpi_by_region", "j01_wide_sales", "q20_reconciliation", "w03_robust_z", "m17_backtest", "j08_reconciliation",
    "f01_explained_score", "f03_compromise_ratio", "w21_triangulation", "w23_cusum", "w28_gap_fill", "w30_seat_allocation",
]
ROLES = {"director": "director", "manager": "manager.asia", "seller": "seller.7"}


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, "bench")
    catalog.load()
    t = Tables(spark, SF_DIR)
    took: dict[str, float] = {}
    registry.run("q01_delivered_without_date", spark, SF_DIR).count()  # start-up of the JVM is not measured
    root = f"{checkpoint_dir(spark)}/bench-{uuid.uuid4().hex}"
    start = time.perf_counter()
    w = pages.load(t, root)
    took["full_load"] = time.perf_counter() - start
    for role, user in ROLES.items():
        for page, build in pages.PAGES.items():
            took[f"page_{role}_{page}"] = statistics.median(timed(lambda: pages.collect(build(w, user))) for _ in range(3))
    for name in SINGLE:
        took[name] = timed(lambda: registry.run(name, spark, SF_DIR).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in took.items()}, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
