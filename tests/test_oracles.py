"""Every registered query of the engine against its SQL on the smallest tables; those without SQL must run."""

import pytest
from compare import assert_same

from ravelin.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf_dir, duck):
    df = registry.queries()[name](spark, sf_dir)
    if name in registry.oracle_sql():
        assert_same(df, duck, registry.oracle_sql()[name])
    else:
        assert df.count() >= 0


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.queries()) <= set(e.queries())
