"""Every registered query against DuckDB on the smallest tables."""

import pytest

from evigraph.plans import catalog, catalog_runs  # noqa: F401  (both register queries)

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(compare, name):
    compare(catalog.queries()[name], catalog.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
