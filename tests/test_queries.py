"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF, rows_of

from valora.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_every_sale_is_a_target(spark, duck):
    n = duck.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert registry.QUERIES["valuation"](spark, SF).count() == n


def test_the_training_data_part_can_be_left_out():
    """Without the subpackage and the pipeline the entry points still import; an import error inside them is not hidden."""
    import __spark_entry__ as entry

    assert not entry.there("valora.no_such_package.queries") and not entry.there("no_such_module") and entry.there("valora.plans.registry")
