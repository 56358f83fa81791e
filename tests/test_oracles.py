import importlib
import os

import pytest

from oracle import database, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = ["graph_checks", "store_queries", "traversal_queries", "rank_queries", "search_queries", "quality_queries", "extract_queries", "io_queries"]
CASES = [(m, q) for m in MODULES for q in importlib.import_module(f"graphloom.plans.{m}").oracle_sql()]



@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return database(SF)


@pytest.mark.parametrize("module,name", CASES)
def test_same_as_sql(spark, con, module, name):
    m = importlib.import_module(f"graphloom.plans.{module}")
    same(spark, con, SF, m.queries()[name], m.oracle_sql()[name])


def test_entry(spark, con):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
