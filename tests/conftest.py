import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", "4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from ledgerloom.plans import catalog
    from ledgerloom.sources.tables import Tables

    catalog.load()
    return Tables(spark, "/root/testdata/sf0.001")
