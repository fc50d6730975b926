"""Every query gives the rows of its SQL."""

import pytest

from tests.helpers import assert_same, oracle_rows
from trialforge.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), oracle_rows(ORACLE_SQL[name], sf))


def test_predictions_read_line_items_before_their_plan(spark, sf):
    """All eight share stored scores and rates, instead of medians of their own."""
    assert not [f for f in QUERIES["predictions"](spark, sf).inputFiles() if "lineitem" in f or "orders" in f]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
