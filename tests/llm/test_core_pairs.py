import random

from orrery.llm import names
from orrery.llm.text import edits


def typed(rnd, w):
    i = rnd.randrange(len(w) - 1)
    return rnd.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])


def test_no_near_core_of_any_length_is_missed(spark):
    rnd = random.Random(7)
    cores = set()
    for n in [*range(3, 26), 40] * 10:
        w = "".join(rnd.choice("abdefgiklmnoprstuwy") for _ in range(n))
        once = typed(rnd, w)
        cores |= {w, once, typed(rnd, once)}
    cores |= {"abcdefghijklmnopqr", "abcdefghjiklmnopqr", "abcdefghjiklmnopqé"}  # a swap over the middle of a long core
    cores = sorted(cores)
    df = spark.createDataFrame([(i, "t", w) for i, w in enumerate(cores)], "cid long, kind string, core string")
    got = [tuple(r) for r in names.core_pairs(df).collect()]
    near = lambda a, b: edits(a, b, names.allowed(len(a), len(b))) <= names.allowed(len(a), len(b))
    want = {(i, j) for i, a in enumerate(cores) for j, b in enumerate(cores) if i != j and near(a, b)}
    assert len(want) > 600 and set(got) == want and len(got) == len(want)


def test_kinds_do_not_meet(spark):
    df = spark.createDataFrame([(1, "O", "zogoufel"), (2, "P", "zogoufal"), (3, "P", "zogouful")], "cid long, kind string, core string")
    assert {tuple(r) for r in names.core_pairs(df).collect()} == {(2, 3), (3, 2)}


def test_short_surnames_typed_wrongly_are_linked(spark):
    words = ["Bral", "Fosk", "Gilm", "Hort", "Jund", "Kesp", "Lorv", "Mabt"]
    rows = [(i, f"Katherine {w}", "P") for i, w in enumerate(words)] + [(100 + i, f"Katherine {w[0]}x{w[2:]}", "P") for i, w in enumerate(words)]
    got = {r["row_id"]: r["class_id"] for r in names.link_names(spark.createDataFrame(rows, "row_id long, name string, kind string")).collect()}
    assert all(got[i] == got[100 + i] for i in range(len(words)))
