"""Every query of the library against its SQL."""

from __future__ import annotations

import pytest
from helixmill.plans import ORACLES, QUERIES

from .conftest import SF_DIR, assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name: str, spark, duck) -> None:
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert_same(df, duck, ORACLES[name])
    else:
        assert df.columns
        df.collect()
