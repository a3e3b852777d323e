"""Every registered query against its SQL, and the others for a stable result."""

import pytest

from markgrid import catalog

from .conftest import rows_of

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    names, got = rows_of(catalog.queries()[name](spark, sf_dir))
    want_names, want = rows_of(duck.execute(SQL[name]).df())
    assert names == want_names
    assert got == want
    assert got or name in ("blank_runs", "rate_limit_flags", "anchor_quad")


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
