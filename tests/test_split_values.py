import pytest

from orrery.operators.split_values import split_packed

CASES = [
    ("a b; c d;; e f;", ["a b", "c d", "e f"]),
    ('"Smith, John"; "Doe, Jane"', ["Smith, John", "Doe, Jane"]),
    ("Smith, John; Jane Doe", ["Smith, John", "Jane Doe"]),
    ("Jane Doe, Jr.; X Y, PhD", ["Jane Doe, Jr.", "X Y, PhD"]),
    ("Acme Foods, Inc, Acme Foods Group", ["Acme Foods, Inc", "Acme Foods Group"]),
    ('["A \\"Al\\" B", "C \\u00e9 D"]', ['A "Al" B', "C é D"]),
    ('"K ""Kate"" M",L M', ['K "Kate" M', "L M"]),
    ("{X Y,Z W}", ["X Y", "Z W"]),
    ("'A O''Neil', 'B C'", ["A O'Neil", "B C"]),
    ("A/S One / B Two", ["A/S One", "B Two"]),
    ("A One | B Two\nC Three\tD Four", ["A One", "B Two", "C Three", "D Four"]),
    ('Ann "Annie" B; C D', ['Ann "Annie" B', "C D"]),
    ("EN-1, EN-2", ["EN-1", "EN-2"]),
    ("A_B;Smith, John", ["A_B", "Smith, John"]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases_keep_their_positions(spark, k):
    cell, want = CASES[k]
    df = spark.createDataFrame([(7, cell)], "id long, v string")
    got = sorted((r["pos"], r["item"]) for r in split_packed(df, "id", "v").collect())
    assert got == list(enumerate(want, 1))


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "  ", 0), (4, "[]", 0), (5, "one value", 0), (6, ";".join(f"a{i} b" for i in range(5000)), 0), (7, "a b;c d", 0), (7, "a b;c d", 0)]
    df = spark.createDataFrame(rows, "id long, v string, item int")
    got = split_packed(df, "id", "v", least=2).groupBy("row_id").count().collect()
    assert {r["row_id"]: r["count"] for r in got} == {6: 5000, 7: 4}
    assert split_packed(df.limit(0), "id", "v").count() == 0
    assert split_packed(df, "id", "v").where("row_id = 5").count() == 1
