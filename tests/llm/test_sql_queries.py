"""Queries with a DuckDB statement, over whole small tables."""

import pytest

from chalkline.llm import catalog
from tests.oracle_harness import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, [name], verbose=False)[name][0] == "OK"


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.QUERIES if k.startswith("op")) == list(range(1, 14))
