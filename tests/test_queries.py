"""Every registered query against its SQL, at the smallest scale; and plans that must not shuffle."""

import os
import threading

import pytest

import __spark_entry__ as entry
from compare import difference, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


OWN = [name for registry in entry._REGISTRIES for name in registry.queries]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    assert name in ORACLES
    assert difference(spark, con, name, entry.queries()[name], ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("name", ORACLES)
def test_sql_ends_with_a_limit_around_it(con, name):
    """Some plain joins hang in DuckDB under a LIMIT."""
    timer = threading.Timer(30, con.interrupt)
    timer.start()
    try:
        con.sql(f"SELECT * FROM ({ORACLES[name]}) LIMIT 100000").fetchall()
    finally:
        timer.cancel()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = ("b3_schema", "c1_tag_search", "c2_child_path", "c3_wildcard_path", "c4_child_pattern", "e3_content_exact",
          "e4_content_normalised", "e9_nesting_direct", "e10_nesting_any")


@pytest.mark.parametrize("name", NARROW)
def test_checks_on_rows_do_not_shuffle(spark, tmp_path_factory, name):
    # spread() adds an exchange for the tiny input of one split; with one core nothing is spread
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert text.count("Exchange hashpartitioning") <= text.count("REPARTITION_BY_NUM")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_merge_reads_the_texts_once_beside_the_index(spark):
    text = plan(entry.queries()["i4_merge_lookups"](spark, SF_DIR))
    assert text.count("Location: InMemoryFileIndex(1 paths)[file:" + os.path.abspath(SF_DIR) + "/documents.parquet]") == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns
