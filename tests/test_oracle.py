import pytest
from oracle import compare

from harvestry.plans import registry

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in registry.oracle_sql()])
def test_sql_agrees(spark, data, name):
    compare(spark, data, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in registry.oracle_sql()])
def test_runs(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert df.columns and df.count() > 0


def test_sql_only_for_queries():
    assert set(registry.oracle_sql()) <= set(NAMES)


def test_entry(spark, data):
    assert registry.flagship(spark, data).count() > 0
