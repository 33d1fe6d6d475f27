"""Every registered query of the menu side against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from platefold.plans import catalog
from tests.conftest import SF
from tests.oracle import assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert_same(catalog.queries()[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
