import pytest

from orrery.llm import names

SAME = [
    ("P", "Katherine Maria Zogoufel", "ZOGOUFEL, Katherine M."), ("P", "Katherine Zogoufel", 'Katherine "Kate" Zogoufel'), ("P", "Kate Zogoufel", "Katherine Zogoufel"), ("P", "Dr. Omar van Quolougread", "van Quoloigread, Omar"),
    ("P", "Karim_Youtaitoum", "Karim Youtaitoum"), ("P", "AmaraKoudeasket", "Koudeasket, Amara"), ("P", "Pavel Diana Prumoubun", "Diana Pavel Prumoubun"), ("P", "Raymond Zogou-Gougrourth", "Raymond Zogou Gougrourth"), ("P", "P. Thezeathourth", "Patricia Thezeathourth"),
    ("O", "Flaizusund International Trade PLC", "Flaizusund Int'l Trade"), ("O", "The Wrebigrus Industries Group", "Wrebigrus Inds. GmbH"), ("O", "Fasatax & Flulukock Manufacturing A/S", "Manufacturing Group Fasatax and Flulukock"), ("O", "Stuthejear Logistics S.A.", "Stutehjear Lgstcs Sociedad Anónima"),
]
OTHER = [
    ("P", "Walter Beafihoux", "Hugo Beafihoux"), ("P", "Katherine Maria Doufel", "Katherine Julia Doufel"), ("P", "Robert Doufels Jr.", "Robert Doufels Sr."), ("O", "Naweaneand Foods LLC", "Naweaneand Timber LLC"), ("O", "Brikiskair Mining Inc", "Brikiskair Mining GmbH"),
    ("O", "Kupruth & Fligor Shipping Ltd", "Kupruth Shipping Ltd"),
]


def classes(spark, rows, aliases=None):
    df = spark.createDataFrame(rows, "row_id long, name string, kind string")
    al = spark.createDataFrame(aliases, "row_id long, alias string, kind string") if aliases is not None else None
    return {r["row_id"]: r["class_id"] for r in names.link_names(df, al).collect()}


def test_variants_and_others(spark):
    rows = []
    for i, (kind, a, b) in enumerate(SAME + OTHER):
        rows += [(2 * i, a, kind), (2 * i + 1, b, kind)]
    got = classes(spark, rows)
    linked = [got[2 * i] == got[2 * i + 1] for i in range(len(SAME + OTHER))]
    assert [x for x, y in zip(SAME, linked) if not y] == []
    assert [x for x, y in zip(OTHER, linked[len(SAME) :]) if y] == []


def test_what_fits_several_joins_none(spark):
    rows = [(1, "Timothy Gotraistaick", "P"), (2, "Tamara Gotraistaick", "P"), (3, "T. Gotraistaick", "P"), (4, "Olga Anna Fribourel", "P"), (5, "Olga Ines Fribourel", "P"), (6, "Olga Fribourel", "P")]
    got = classes(spark, rows)
    assert len(set(got.values())) == 6


def test_aliases_say_that_other_names_are_the_same(spark):
    rows = [(1, "Sofia Greatrodon", "P"), (2, "Roland Zeakleaflil", "P"), (3, "ZEAKLEAFLIL Roland", "P"), (4, "Roland Other", "P")]
    got = classes(spark, rows, [(1, "Zeakleaflil, Roland", "P")])
    assert got[1] == got[2] == got[3] != got[4]


def test_edges(spark):
    assert classes(spark, []) == {}
    rows = [(1, None, "P"), (2, " ", "P"), (3, "-", "O"), (4, "N/A", None), (5, "123", "P"), (6, "Bestithoru Telecom Ltd", None), (7, "bestithoru telecommunications", "O"), (8, "a" * 100_000, "P"), (9, "Ann Lee", "P"), (9, "Ann Lee", "P")]
    got = classes(spark, rows)
    assert set(got) == {6, 7, 8, 9} and got[6] == got[7]
    df = spark.createDataFrame([(9, 1), (8, 1), (7, 2)], "row_id long, class_id long")
    assert [tuple(r) for r in names.class_pairs(df).collect()] == [(8, 9)]


@pytest.mark.parametrize(("s", "recall", "rows"), [(0.5, 0.99, 3), (0.41, 0.97, 3)])
def test_bands_follow_the_collision_curve(s, recall, rows):
    b = names.bands_for(s, recall, rows)
    assert 1 - (1 - s**rows) ** b >= recall > 1 - (1 - s**rows) ** (b - 1)


def test_star_clusters(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (3, 4, 1.0), (5, 6, 1.0)], "n1 long, n2 long, like double")
    got = {r["node"]: r["center"] for r in names.star_clusters(edges).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == got[6] == 5 and got[4] == 4


def test_recall_of_candidates_against_all_pairs(spark):
    import random

    from orrery.llm.text import edits

    rnd = random.Random(4)
    base = ["".join(rnd.choice(["tr", "k", "fl", "gr", "z", "m", "sk"]) + rnd.choice(["ai", "ou", "e", "i"]) for _ in range(4)) + rnd.choice("dtksx") for _ in range(120)]
    typed = []
    for w in base:
        i = rnd.randrange(1, len(w) - 1)
        typed.append(rnd.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]]))
    words = sorted(set(base + typed))
    df = spark.createDataFrame([(i, "t", w) for i, w in enumerate(words)], "cid long, kind string, core string")
    got = {tuple(r) for r in names.core_pairs(df).collect()}
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and edits(a, b, 1) <= 1}
    assert len(got & want) >= 0.9 * len(want)
    assert all(edits(words[i], words[j], 2) <= 2 for i, j in got)
