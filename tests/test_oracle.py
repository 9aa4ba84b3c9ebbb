"""Named queries against their SQL on the small tables.

The default is one query per family; ``ALL_QUERIES=1`` runs all of them (some
minutes), as does ``python tests/compare.py``.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"
SOME = ["k00_kpi_by_region", "k18_drill_region_state", "x02_seller_lines", "s12_permissions", "u04_leak_test", "q20_reconciliation", "q21_report", "p05_city_similar",
        "k14_run_rate_target", "w06_episodes", "m17_backtest", "j08_reconciliation", "f01_explained_score", "w28_gap_fill", "j15_incident_vs_tap", "j21_reaccommodation_options",
        "j22_calendar_conflicts", "s06_invoice_xml", "t06_hourly_samples"]


def names():
    q = list(entry.oracle_sql())
    return q if os.environ.get("ALL_QUERIES") else [n for n in q if n in SOME]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    assert sql is not None
    assert difference(got, con.execute(sql).df()) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_name_of_its_family():
    text = entry.text_queries()[0]
    assert all(n[0] in "kxsqpjmwtfhuczel" and n[1:3].isdigit() for n in entry.queries() if n not in text)
