"""Every catalogue query beside its oracle."""

import pytest

from medialake.plans import answer_queries, flow_queries, library_queries, place_queries, view_queries  # noqa: F401 - register their queries
from medialake.plans.catalogue_queries import ORACLE, QUERIES
from tests.oracle import SF, compare, connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert compare(df, connection(SF), ORACLE[name]) > 0
    else:
        assert df.count() > 0
