"""Queries of this subpackage that SQL can express, beside their SQL."""

import pytest

from medialake.llm.queries import ORACLE, QUERIES
from tests.oracle import SF, compare, connection


@pytest.mark.parametrize("name", [n for n in ORACLE if not n.startswith("op9")])
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connection(SF), ORACLE[name]) > 0
