import random

from orrery.llm import addresses


def classes(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, street string, town string, postal string, country string, whole boolean")
    return {r["row_id"]: r["class_id"] for r in addresses.link_addresses(df).collect()}


def test_streets_with_two_typing_errors_meet(spark):
    rnd = random.Random(11)
    pairs = [("sareawem", "satrewaem")]
    for _ in range(30):
        w = "".join(rnd.choice("bdfgklmnprstz") + rnd.choice("aeiou") for _ in range(4))
        pairs.append((w, w[0] + w[2] + w[1] + w[3:5] + "q" + w[6:]))
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows += [(2 * i, f"{i + 10} {a} street", "", str(70000 + i), None, False), (2 * i + 1, f"{i + 10} {b} street", "", str(70000 + i), None, False)]
    got = classes(spark, rows)
    assert [p for i, p in enumerate(pairs) if got[2 * i] != got[2 * i + 1]] == []
    assert len(set(got.values())) == len(pairs)
