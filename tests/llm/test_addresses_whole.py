"""Streets of several words, ordinals, ranges, other scripts; addresses that can't be parsed; streets that every town has."""

from orrery.llm import addresses
from orrery.llm.addresses import Parser

SCHEMA = "row_id long, street string, town string, postal string, country string, whole boolean"


def classes(spark, texts):
    df = spark.createDataFrame([(i, t, None, None, None, True) for i, t in enumerate(texts)], SCHEMA)
    return {r["row_id"]: r["class_id"] for r in addresses.link_addresses(df).collect()}


def test_streets_of_several_words():
    p = Parser([], [])
    of = lambda t: ((got := p.parse(t)) and (got["num"], got["street"], got["kind"]))
    assert of("12 Old Mill Road") == ("12", "oldmill", "road")
    assert of("12345 Gougrourth Road") == ("12345", "gougrourth", "road")
    assert of("12 Rue de Rivoli, Paris") == ("12", "ruederivoli", "")
    assert of("12 Martin Luther King Street") == of("Martin Luther King Street 12, Springfield") == ("12", "martinlutherking", "street")
    assert of("Hauptstrasse 12, Berlin") == ("12", "hauptstrasse", "")
    assert of("12 5th Avenue, New York") == of("12 Fifth Avenue, New York") == ("12", "#5", "avenue")
    assert of("100-102 Main Street, Springfield")[0] == "100"
    assert of("ул. Ленина 5, Москва") == ("5", "ленина", "")


def test_several_words_are_linked(spark):
    same = [("12 Old Mill Road, Springfield", "Old Mill Rd 12, SPRINGFIELD"), ("7 Oldmill Lane, Springfield", "7 Old Mill Ln., Springfield"), ("12 5th Avenue, Yorkville", "Flat 3, 12 Fifth Ave, Yorkville"), ("9 Martin Luther King Street, Graz", "9 Martin Luther Knig St, Graz")]
    other = [("12 42nd Street, Yorkville", "12 43rd Street, Yorkville"), ("3 New Mill Road, Graz", "3 Old Mill Road, Graz")]
    got = classes(spark, [x for p in same + other for x in p])
    assert [got[2 * i] == got[2 * i + 1] for i in range(len(same + other))] == [True] * len(same) + [False] * len(other)


def test_what_cannot_be_parsed_is_joined_by_its_words(spark):
    texts = ["Block C 7 / km 12 Nqamakwe", "NQAMAKWE, km 12 / 7, Block C", "Block D 9 / km 14 Nqamakwe", "PO Box 1234, Springfield 79180", "Springfield 79180, P.O. Box 1234", "no fixed address"]
    got = classes(spark, texts)
    assert 5 not in got and got[0] == got[1] != got[2]


def test_a_street_of_every_town_meets_itself_in_its_town(spark):
    towns = [a + b + c for a in ("Kra", "Blo", "Fen", "Gul", "Sto") for b in ("dim", "vor", "pet", "lan") for c in ("stadt", "heim", "ford")]
    rows = [(i, "12 Main Street", t, "", None, False) for i, t in enumerate(towns)] + [(100 + i, "Main St 12", t.upper(), "", None, False) for i, t in enumerate(towns)]
    places = spark.createDataFrame([(i, "city", t, "FR", None, None) for i, t in enumerate(towns)], "place_id long, kind string, place_name string, country_code string, code3 string, alt_name string")
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["row_id"]: r["class_id"] for r in addresses.link_addresses(df, places).collect()}
    assert all(got[i] == got[100 + i] for i in range(len(towns))) and len(set(got.values())) == len(towns)
    parts = addresses.parsed(df, places, None)
    distinct = parts.withColumn("aid", addresses.F.xxhash64(*[addresses.F.coalesce(addresses.F.col(c).cast("string"), addresses.F.lit("")) for c in addresses.PARTS])).drop("row_id", "loose").distinct()
    assert addresses.candidates(distinct)[0].count() < 3 * len(towns)
