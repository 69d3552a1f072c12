import pytest

import __spark_entry__ as e
from tests.conftest import DATA
from tests.oracle import assert_same

SMALL = DATA / "sf0.001"
NAMES = [n for n in e.queries() if n in e.oracle_sql() and not n.startswith(("p2", "p5"))]


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_gives_rows(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    assert_same(e.queries()[name](spark, str(SMALL)), e.oracle_sql()[name], SMALL)


def test_every_query_without_sql_is_known():
    """Each of these is tested by hand-made cases, brute force or invariants."""
    assert {n for n in e.queries() if n not in e.oracle_sql() and not n.startswith(("p2", "p5", "p6", "p7", "p8"))} == {"p3_unified", "p3_columns", "p3_lines", "p3_table", "p4_tables", "p4_kinds", "p4_flat"}
