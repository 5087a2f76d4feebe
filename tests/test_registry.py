import pytest

from lumentrace.plans import registry


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query_matches_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])
