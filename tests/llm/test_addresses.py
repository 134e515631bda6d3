from orrery.llm import addresses

PLACES = [(1, "country", "Freeland", "FR", "FRE", None), (2, "country", "Northia", "NO", "NOR", None), (10, "city", "Springfield", "FR", None, None), (11, "city", "Springfield", "NO", None, None), (12, "city", "Flaikhaven", "FR", None, None)]
REGIONS = [("Uplands",), ("UP",), ("North Province",)] * 3
SAME = [
    ("342 Veararan Ct, Springfield, UP 52390, Freeland", "Suite 42, Veararan Court 342\nSPRINGFEILD\n5239-0000\nFR"),
    ("281 Jijevous Street, Flaikhaven", "flaikhaven AK7 1HA; Flat 9, No. 281 Jijevouss Str.; FREELAND"),
    ("21B Yeducerth Ct - Flaikhaven - 17143 - Freeland", "c/o Agents Ltd, 21b Yeducerth Crt, 17143"),
    ("7 West Fourth Goflairail Road, Zzutown", "7 W. 4th Goflairail Rd; ZZUTOWN; Uplands"),
    ("143 North Stoumoumom Avenue, Flaikhaven", "143 No. Stoumoumom Ave. Unit 52, Flaikhaven"),
]
OTHER = [
    ("342 Kouquastirth Road, Springfield, Freeland", "342 Kouquastirth Road, Springfield, Northia"), ("12A Nuuwaif Lane, Flaikhaven", "12B Nuuwaif Lane, Flaikhaven"), ("12 Klotaiqueck Lane, Flaikhaven", "12 Klotaiqueck Square, Flaikhaven"),
    ("12 Dainaiced Road, Flaikhaven", "21 Dainaiced Road, Flaikhaven"), ("9 North Zunetbeck Road, Flaikhaven", "9 South Zunetbeck Road, Flaikhaven"), ("5 Soudreap Road, Flaikhaven", "5 Soudreap Road, Zzutown"),
]


def classes(spark, rows):
    schema = "row_id long, street string, town string, postal string, country string, whole boolean"
    df = spark.createDataFrame(rows, schema)
    places = spark.createDataFrame(PLACES, "place_id long, kind string, place_name string, country_code string, code3 string, alt_name string")
    return {r["row_id"]: r["class_id"] for r in addresses.link_addresses(df, places, spark.createDataFrame(REGIONS, "region string")).collect()}


def test_same_and_other(spark):
    rows = []
    for i, (a, b) in enumerate(SAME + OTHER):
        rows += [(2 * i, a, None, None, None, True), (2 * i + 1, b, None, None, None, True)]
    got = classes(spark, rows)
    linked = [got[2 * i] == got[2 * i + 1] for i in range(len(SAME + OTHER))]
    assert [x for x, y in zip(SAME, linked) if not y] == []
    assert [x for x, y in zip(OTHER, linked[len(SAME) :]) if y] == []


def test_columns_and_texts(spark):
    rows = [(1, "Unit 12, 30C, Ninth Zrakowud Str.", "NORTH CIBEDIND", "EK21 6GA", "freeland", False), (2, "Freeland, North Cibedind, EK216GA, 30c 9th Zrakowud Street", None, None, None, True), (3, "30C Ninth Zrakowud Str.", None, "EK21 6GA", None, False)]
    got = classes(spark, rows)
    assert got[1] == got[2] == got[3]


def test_edges(spark):
    assert classes(spark, []) == {}
    texts = [None, "", " - ", "unknown", "no fixed address", "Flaikhaven", "x" * 30_000, "5 " + "word " * 5_000]
    rows = [(i, t, None, None, None, True) for i, t in enumerate(texts)] + [(100, "1 Aaabbb Road, Flaikhaven", None, None, None, True)] * 2 + [(101, "1 Aaabbb Road", "", "", None, False)]
    got = classes(spark, rows)
    assert 100 in got and not {0, 1, 2, 3, 4, 5, 6} & set(got)
