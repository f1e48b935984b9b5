"""Every registered query against its DuckDB statement (the driver's check).

Runs at sf0.001 by default for speed; set CHALKLINE_ORACLE_SF=/root/testdata/sf0.01
for the driver's scale.
"""

import os

import pytest

import __spark_entry__ as E
from chalkline.plans import catalog
from tests.oracle_harness import compare

SF = os.environ.get("CHALKLINE_ORACLE_SF", "/root/testdata/sf0.001")
NAMES = sorted(catalog.QUERIES)   # the operators of chalkline/llm have tests of their own


def test_every_query_has_oracle_or_is_iterative():
    rows_only = set(catalog.QUERIES) - set(catalog.ORACLE)
    assert rows_only == set()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF, [name], verbose=False)[name]
    assert res[0] in ("OK", "ROWS_ONLY"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["day", "name", "full_date", "views", "requests"]
    assert df.count() == 8
