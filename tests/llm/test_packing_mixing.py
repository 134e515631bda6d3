import random

import pytest
from pyspark.sql import functions as F

from orrery.llm import mixing, packing, tokens

SPECS = [("a", 10), ("b", 64), ("zero", 0)]


def plain_ffd(sizes, capacity):
    bins, out = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((i for i, used in enumerate(bins) if used + sizes[k] <= capacity), None)
        if at is None:
            bins.append(0)
            at = len(bins) - 1
        bins[at] += sizes[k]
        out[k] = at
    return [out[k] for k in range(len(sizes))]


@pytest.mark.parametrize("seed", range(5))
def test_tournament_equals_plain_first_fit(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(1, 30) for _ in range(rnd.choice([0, 1, 7, 200]))]
    assert packing.first_fit_decreasing(sizes, 30) == plain_ffd(sizes, 30)


def test_pack_is_whole_and_fits(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(1, 90), "c") for i in range(500)] + [(900, 0, "c"), (901, None, "c"), (902, 1000, "c"), (1, 5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long, container string")
    specs = spark.createDataFrame([*SPECS, ("a", 10)], "spec string, capacity_tokens int")
    got = packing.pack(docs, specs, group_pieces=100).cache()
    assert got.groupBy("spec", "container").agg(F.sum("size").alias("s"), F.max("capacity").alias("c")).where("s > c").count() == 0
    total = sum(r[1] or 0 for r in rows)
    assert {r["spec"]: r["t"] for r in got.groupBy("spec").agg(F.sum("size").alias("t")).collect()} == {"a": total, "b": total}
    assert got.where("spec = 'b' and piece > 0").select("doc_id").distinct().count() == sum(1 for r in rows if (r[1] or 0) > 64)
    assert got.where("doc_id in (900, 901)").count() == 0
    fill = {r["spec"]: r["fill"] for r in packing.packing_report(got).collect()}
    assert fill["b"] > 0.9
    assert packing.pack(docs.limit(0), specs).count() == 0 and packing.pack(docs, specs.limit(0)).count() == 0


def test_poisson_inverse():
    assert [mixing.poisson_counts(u, 1.0, 9) for u in (0.1, 0.5, 0.8, 0.95, 0.9999999)] == [0, 1, 2, 3, 9]
    assert mixing.poisson_counts(0.99, 5.0, 2) == 2 and mixing.poisson_counts(0.5, 0.0, 3) == 0
    for u in (0.01, 0.3, 0.7, 0.99):
        assert sum(u > x for x in mixing.thresholds(1.7, 4)) == mixing.poisson_counts(u, 1.7, 4)


def test_mix_meets_its_targets(spark):
    rnd = random.Random(2)
    rows = [(i, "big" if i % 10 else "small", rnd.randint(50, 400), 1) for i in range(20_000)] + [(50_000, None, 9, 1), (50_001, "big", None, 1), (50_002, "other", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copy int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 4), ("absent", 0.2, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets)
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["big"]["actual_share"] - 0.5) < 0.005 and abs(s["small"]["actual_share"] - 0.5) < 0.005 and s["absent"]["tokens"] == 0
    assert s["small"]["most_copies"] <= 4 and s["big"]["most_copies"] <= 2
    assert chosen.groupBy("source").agg(F.sum("n_tokens").alias("t")).where("source = 'small'").first()["t"] == s["small"]["tokens"]
    assert chosen.select("doc_id", "copy").distinct().count() == chosen.count()
    empty, none = mixing.mix(docs.limit(0), targets)
    assert empty.count() == 0 and {r["tokens"] for r in none.collect()} == {0}
    assert mixing.mix(docs, targets.limit(0))[0].count() == 0


def test_tokens_are_counted_whole(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (4, "a b " * 20_000), (5, "<|endoftext|>")]
    got = {r["id"]: r["n_tokens"] for r in tokens.count_tokens(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] >= 40_000 and got[5] > 1
