import pytest

from sievewright import refresh_queries, registry, research_queries, review_queries, store_queries  # noqa: F401  (registers its queries)
from tests.conftest import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    mine, theirs = same(spark, SF, registry.QUERIES[name], registry.ORACLE[name])
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
