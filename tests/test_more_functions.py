"""Hashes against plain versions, versions of a store, headers by place, pages, lookups, entities and the index."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import codes, dates, hashing, lookup, text
from orrery.operators import search
from orrery.operators.index import TextIndex
from orrery.plans.ast import Fields
from orrery.plans.languages import parse_field_query, parse_prefix
from orrery.session import spread
from orrery.sources import readers
from orrery.sources.store import Store

M32, M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def plain_murmur3(data: bytes, seed: int) -> int:
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & M32
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & M32
        h ^= turn(k, 15) * 0x1B873593 & M32
        if len(data) - i >= 4:
            h = (turn(h, 13) * 5 + 0xE6546B64) & M32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & M32
    return h ^ h >> 16


def plain_murmur2(data: bytes, seed: int, m: int, r: int, width: int, last: tuple[int, int]) -> int:
    mask = (1 << 8 * width) - 1
    h = (seed ^ len(data) * m) & mask if width == 8 else seed ^ len(data)
    for i in range(0, len(data) - width + 1, width):
        k = int.from_bytes(data[i : i + width], "little") * m & mask
        k = (k ^ k >> r) * m & mask
        h = ((h ^ k) * m & mask) if width == 8 else (h * m & mask) ^ k
    if rest := data[len(data) // width * width :]:
        h = (h ^ int.from_bytes(rest, "little")) * m & mask
    h = (h ^ h >> last[0]) * m & mask
    return h ^ h >> last[1]


def signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def test_murmur_hashes(spark):
    assert plain_murmur3(b"", 1) == 0x514E28B7 and plain_murmur3(b"test", 0) == 0xBA6BD213
    rnd = random.Random(3)
    texts = ["", "test", "Hello, world!", "ä€𝄞", *("".join(rnd.choice("abcxyz é") for _ in range(n)) for n in range(40))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for kind, f, bits in (
        ("murmur3_32", lambda b: plain_murmur3(b, 17), 32), ("murmur2_64", lambda b: plain_murmur2(b, 17, 0xC6A4A7935BD1E995, 47, 8, (47, 47)), 64), ("murmur2_32", lambda b: plain_murmur2(b, 17, 0x5BD1E995, 24, 4, (13, 15)), 32),
    ):
        got = {r["t"]: r["h"] for r in df.select("t", hashing.murmur(F.col("t"), kind, 17).alias("h")).collect()}
        assert got.pop(None) is None and got == {t: signed(f(t.encode()), bits) for t in texts}


def test_versions_of_a_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = lambda: sorted(r["k"] for r in s.open().collect())
    s.create(spark.range(3).withColumnRenamed("id", "k"))
    before = s._last()
    s.append(spark.range(3, 5).withColumnRenamed("id", "k"))
    assert rows() == [0, 1, 2, 3, 4]
    # A writer that started from the version before gets an error, and what is there stays.
    with pytest.raises(RuntimeError):
        s._name([s._write(spark.range(9).withColumnRenamed("id", "k"))], before)
    assert rows() == [0, 1, 2, 3, 4]
    # A crash after a version was written and before its pointer was put in place loses nothing.
    s._write(spark.range(7).withColumnRenamed("id", "k"))
    (tmp_path / "s" / ".new-half").write_text("nonsense")
    assert rows() == [0, 1, 2, 3, 4]
    for i in range(12):
        s.append(spark.range(10 + i, 11 + i).withColumnRenamed("id", "k"))
    assert len(rows()) == 17 and len(s._numbers()) == s.KEPT


def test_rows_written_like_the_header_stay(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text('city,country\n"a, b",x\ncity,country\n\nc,y\n')
    rows = readers.read_delimited(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == sorted([("a, b", "x"), ("city", "country"), ("c", "y")] * 2)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.txt").write_text("k|v;1|a;22|b;")
    assert readers.read_delimited(spark, str(tmp_path / "c"), "|", line_sep=";", least=4).collect()[0]["v"] == "b"
    assert [p.rsplit("/", 1)[1] for p in readers.files_matching(spark, str(tmp_path), "?.CSV")] == ["a.csv", "b.csv"]
    assert [p.rsplit("/", 1)[1] for p in readers.files_matching(spark, str(tmp_path), r"B\.c.*", regex=True)] == ["b.csv"]


def test_pages_over_two_keys_hold_every_row_once(spark):
    df = spark.createDataFrame([(i, k, m) for i, (k, m) in enumerate([("b", 1), ("a", 10), ("a", 9), (None, 2), ("a", None), ("b", 1), (None, None), ("a", 9)])], "id long, k string, m int")
    seen, cursor = [], None
    for _ in range(9):
        rows, count = search.page(df, "(+ *:*)\npaginate\nsort=k:string,m:int\nlimit=1", tie="id", cursor=cursor)
        assert count.first()["count"] == 8
        if not (got := rows.collect()):
            break
        seen.append(got[0]["id"])
        cursor = (got[0]["k"], got[0]["m"], got[0]["id"])
    assert seen == [6, 3, 4, 2, 7, 1, 0, 5]
    with pytest.raises(ValueError):
        search.after(df, (("k", "string"),), "id", ("a",))
    # Texts sorted as numbers are compared as numbers.
    assert [r["t"] for r in search.after(spark.createDataFrame([("9", 1), ("10", 2)], "t string, id long"), (("t", "int"),), "id", (9, 1)).collect()] == ["10"]


def test_dates_of_all_formats(spark):
    for written, day in (("2020/01/02", "2020-01-02 00:00:00"), ("20200102 03:04:05", "2020-01-02 03:04:05"), ("01/02/2020 03:04", "2020-01-02 03:04:00"), ("20200102 03:04", "2020-01-02 03:04:00"), ("2020-01-02 03:04", "2020-01-02 03:04:00"), ("20200102", "2020-01-02 00:00:00"), ("02-Jan-2020", "2020-01-02 00:00:00"), ("soon", None)):
        assert spark.range(1).select(dates.parse_date(F.lit(written)).cast("string").alias("d")).first()["d"] == day


def test_small_functions(spark):
    r = spark.range(1).select(
        text.fill_placeholders("a='?', b=?", F.lit(None), F.lit(3)).alias("a"), text.greatest_text(F.lit(None).cast("string")).alias("g"), codes.bytes_double(codes.double_bytes(F.lit(-1.5))).alias("d"), codes.bytes_double(F.lit(b"abc")).alias("bad"),
        text.place_of(F.array(F.lit(1), F.lit(3)), F.lit(2), True).alias("p"), text.place_of(F.array(F.lit(1), F.lit(3)), F.lit(2)).alias("q"),
    ).first()
    assert tuple(r) == ("a=null, b=3", "", -1.5, None, 1, -1)
    assert len(lookup.STATES) == 59 and lookup.countries(spark).where("code3 = 'DEU'").first()["country_name"] == "GERMANY"


def test_flat_rows_to_entities_and_trees(spark):
    df = spark.createDataFrame([(7, " Ann ", "1 Road", "", '["a","b"]', "x"), (8, "  ", "2 Road", "T", "", None), (9, "Bob", "", " ", None, '["y"]')], "id long, n string, s string, c string, p string, m string")
    got = {r["name"]: r for r in readers.csv_entities(df, {"name": "n", "address1": "s", "city": "c"}, None, {"parentOf": "p"}, {"positions": "m"}, {"type": "P"}, "id").collect()}
    assert set(got) == {"Ann", "Bob"} and got["Ann"]["addresses"][0]["raw_format"] == "1 Road" and got["Bob"]["addresses"] == []
    assert got["Ann"]["associations"] == {"parentOf": ["a", "b"]} and got["Bob"]["misc_info"] == {"positions": ["y"]} and got["Ann"]["data_source_id"] == "7"
    e = spark.createDataFrame([(1, "A", ["x", None], [("p", "1")])], "id long, name string, aliases array<string>, identifications array<struct<type:string,value:string>>")
    tree = readers.entity_tree(e, "id", "name", ("aliases", "identifications")).first()["tree"]
    assert tree["children"][0]["children"] == ["x"] and tree["children"][1]["children"] == ["type: p; value: 1; "]


def test_the_index_finds_what_a_scan_finds(spark):
    rows = [(1, "The quick brown fox", "x"), (2, "the lazy fox, the red fox", "y"), (3, None, "x"), (4, "", "z"), (5, "Foxes and a fxo", "x"), (6, "brown the quick", "y")]
    df = spark.createDataFrame(rows, "id long, text string, code string")
    index = TextIndex.build(df, "id", ["text"])
    for q in ("(* text:fox)", "(+ text:the (- text:red))", "(+ text:fox*)", "(+ text:*ow?)", '(+ text:"the quick")', '(* text:"fox the"~3)', "(* text:fox~1)", "(+ *:*)", "(- text:fox)", "(+ text:the (* code:x text:lazy))", "(f:2:1 text:foxs)", '(+ text:"the the")'):
        want = sorted(r["id"] for r in search.search(df, parse_prefix(q), Fields.of(df)).collect())
        assert sorted(r["id"] for r in index.search(df, parse_prefix(q)).collect()) == want, q
    for q in ("(* text:red text:fox)", "(+ text:the (* code:x text:fox~1))"):
        want = {r["id"]: round(r["score"], 6) for r in search.bm25(df, parse_prefix(q), Fields.of(df, {"code": "string"})).collect()}
        assert {r["id"]: round(r["score"], 6) for r in index.bm25(parse_prefix(q)).collect()} == want, q
    assert index.search(df, None).count() == 0 and index.ids(parse_field_query("fox AND quick", "text")).count() == 1
    empty = TextIndex.build(df.limit(0), "id", ["text"])
    assert empty.search(df, parse_prefix("(* text:fox)")).count() == 0
    # The term reaches the scan of the postings.
    assert "EqualTo(term,fox)" in index.ids(parse_prefix("(* text:fox)"))._jdf.queryExecution().toString()


def test_inputs_of_many_splits_are_not_moved(spark, tmp_path):
    spark.range(1000).repartition(40).write.parquet(str(tmp_path / "many"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        many = spark.read.parquet(str(tmp_path / "many")).where("id > 3")
        assert "Exchange" not in spread(many)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert spread(spark.range(10).coalesce(1).groupBy("id").count()).rdd.getNumPartitions() >= 1
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
