import random

import pytest

from orrery.operators.hierarchy import descendants, multiple_parents, resolve_hierarchy, stated_links


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(parent.get(c, p), p)
    out = {}
    for n in {x for l in links if None not in l for x in l}:
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        out[n] = (min(seen[seen.index(x) :]), -1, None) if x in parent else (x, len(seen), [*seen, x][::-1])
    return out


def solved(df):
    return {r["node_id"]: (r["root_id"], r["depth"], r["path"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_loops(spark, seed):
    rnd = random.Random(seed)
    n = 150
    links = [(f"n{i:03}", f"n{rnd.randrange(max(1, i)) if rnd.random() < 0.9 else rnd.randrange(n):03}") for i in range(1, n)]
    links += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("z", "z"), (None, "n001"), ("n002", None), links[0]]
    df = spark.createDataFrame(links, "child string, parent string")
    assert solved(resolve_hierarchy(df)) == brute(links)


def test_only_loops_and_nothing(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e")]
    df = spark.createDataFrame(links, "child string, parent string")
    assert solved(resolve_hierarchy(df)) == brute(links)
    assert resolve_hierarchy(df.limit(0)).collect() == []


def test_descendants_and_several_parents(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "x")], "child string, parent string")
    got = {tuple(r) for r in descendants(resolve_hierarchy(df)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {tuple(r) for r in multiple_parents(df).collect()} == {("c", "b", True), ("c", "x", False)}


def test_stated_links_in_many_writings(spark):
    rows = [
        ("EN-0000000001", None, '["EN 2", "en_0000000003"]', 1), ("EN-0000000002", "EN-1", None, 1), ("EN-0000000002", " en0000000001\t", "EN-99", 2),
        ("EN-0000000003", "N/A", "", 1), ("EN-0000000004", "EN-4", None, 1), ("EN-0000000005", None, None, None),
    ]
    df = spark.createDataFrame(rows, "entity_id string, childof string, parentof string, key int")
    got = {tuple(r) for r in stated_links(df).collect()}
    e = lambda i: f"EN-{i:010}"
    assert got == {(e(2), e(1)), (e(3), e(1)), (e(4), e(4))}
    assert stated_links(df.limit(0)).count() == 0
