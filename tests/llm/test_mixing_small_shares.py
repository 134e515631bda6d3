"""Sources of which only a small part is wanted."""

import pytest

from orrery.llm import mixing


@pytest.mark.parametrize("rate", [0.00001, 0.0001, 0.0002, 0.00035, 0.01])
def test_a_small_share_of_a_large_source_is_met(spark, rate):
    n, size = 40_960, 100
    docs = spark.range(n).selectExpr("id as doc_id", "'large' as source", f"{size}L as n_tokens")
    docs = docs.unionByName(spark.range(n, n + 10_000).selectExpr("id as doc_id", "'other' as source", f"{size}L as n_tokens"))
    large = n * size * rate
    rest = 10_000 * size * mixing.USABLE
    targets = spark.createDataFrame([("large", large / (large + rest), 1), ("other", rest / (large + rest), 1)], "source string, target_share double, max_repeats int")
    s = {r["source"]: r for r in mixing.mix(docs, targets)[1].collect()}
    assert abs(s["large"]["wanted_tokens"] - large) < 1
    assert abs(s["large"]["tokens"] - large) <= size and abs(s["other"]["tokens"] - rest) <= size
