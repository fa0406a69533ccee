"""Corpus queries that SQL can express, against another engine."""

from __future__ import annotations

import pytest
from compare import differences

from measura.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, sf, name):
    assert differences(spark, sf, catalog.QUERIES[name], catalog.ORACLES[name]) == ""
