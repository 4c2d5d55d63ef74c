"""Every registered query with SQL against DuckDB, at the smallest scale."""

import pytest
from oracle import assert_same

from strandloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), sf_dir, registry.ORACLE_SQL[name])
