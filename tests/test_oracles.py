"""Every core query against its SQL form on another engine."""

from __future__ import annotations

import pytest
from compare import connect, differences

from measura.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, name):
    assert differences(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name]) == ""


#: What SQL doesn't express (approximations, floating point spectra, augmenting paths, Unicode tables); tests/test_plain.py holds
#: these against plain versions.
PLAIN = {"approximate_profiles", "cluster_tree", "heaviest_matching", "mark_inventory", "match_rate", "power_exponent"}


def test_every_other_query_has_a_plain_version():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == PLAIN


@pytest.mark.parametrize("name", ["join_anti_busy", "set_except_buyers", "invariant_cells_29", "invariant_beyond_null_29", "hand_ranks", "source_hdf5_box", "body_cores", "descent_plan", "stream_rests"])
def test_queries_that_compare_something(name):
    assert connect("/root/testdata/sf0.01").sql(catalog.ORACLES[name]).fetchall()
