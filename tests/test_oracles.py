"""Every registered query that has SQL gives the same rows as DuckDB."""

import pytest

from check import compare
from ridgeline.catalog import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    rows, difference = compare(spark, con, sf, name)
    assert difference is None
    assert rows > 0
