"""Components that have not settled are an error, not labels."""

from __future__ import annotations

import pytest

from foliant.llm import near_dedup


def test_unsettled_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        near_dedup.components(chain, most_rounds=1)
    assert {r["comp"] for r in near_dedup.components(chain).collect()} == {0}
