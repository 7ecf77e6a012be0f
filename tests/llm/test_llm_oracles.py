"""Queries that SQL can express, against it."""

import pytest
from compare import assert_same

from ravelin.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(name, spark, sf_dir, duck):
    assert_same(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name])


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
