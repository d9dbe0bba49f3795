"""Every query of the subpackage on whole, empty, defective and skewed tables."""

from __future__ import annotations

import pytest

from reefglass.llm import queries as llm

Q = llm.queries()


@pytest.mark.parametrize("variant", ["plain", "empty", "all_empty", "nulls", "extra", "one_key"])
@pytest.mark.parametrize("name", sorted(Q))
def test_variants(spark, variants, name, variant):
    rows = Q[name](spark, variants[variant]).collect()
    if variant == "all_empty" or (variant == "empty" and name != "p8_shares"):
        assert not rows
    if variant in ("plain", "extra") and name != "p2_kept_values":
        assert rows
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
        assert not any(v is None for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(n for n in Q if n.endswith("_found")))
def test_extra_columns_change_nothing(spark, variants, name):
    assert set(Q[name](spark, variants["plain"]).collect()) == set(Q[name](spark, variants["extra"]).collect())
