import json

import pytest
from pyspark.sql import functions as F

from orrery.functions import codes, dates, text
from orrery.operators import aggregate, relational, search, tags
from orrery.plans.ast import Fields, Group, Leaf, compile_query
from orrery.plans.languages import edits_of, parse_field_query, parse_json_query, parse_prefix
from orrery.sources import readers, schema
from orrery.sources.store import Store
from orrery.streaming import poll


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "The quick brown fox", ["a", "b"], 5, "x"), (2, "A quikc red FOX jumps", ["b"], 15, "y"), (3, "nothing here", [], None, None), (4, None, None, 20, "z"),
        (5, "brown quick the fox", ["c c", "A"], 7, "x"), (6, "Éclair über café", ["ü"], -3, "é"),
    ]
    return spark.createDataFrame(rows, "id int, text string, tags array<string>, n long, code string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("(+ text:fox)", [1, 2, 5]), ("(+ text:Fox)", []), ("(* text:Fox)", [1, 2, 5]), ("(+ *:*)", [1, 2, 3, 4, 5, 6]), ("(+ text:qui*)", [1, 2, 5]), ("(+ text:f?x)", [1, 2, 5]),
        ("(* text:quick~1)", [1, 2, 5]), ("(f:1 text:quick)", [1, 2, 5]), ("(* text:quack~1)", [1, 5]), ('(+ text:"quick brown")', [1]), ('(+ text:"quick fox"~1)', [1, 5]),
        ("(+ n:[5 - 15])", [1, 2, 5]), ("(+ n:{5 - 15})", [5]), ("(+ n:[ - 5])", [1, 6]), ("(+ text:[quick TO quill])", [1, 2, 5]), ("(+ text:fox (- text:red))", [1, 5]), ("(+ tags:b)", [1, 2]),
        ("(+ text:fox) (* text:red text:brown)", [1, 2, 5]), ("(+ text:café)", [6]), ("(+ (* text:here text:red) (* n:[10 - 30] text:nothing))", [2, 3]), ("(+ missing:x)", []), ("(* nocolon)", []),
    ],
)
def test_prefix_form(docs, q, want):
    assert ids(search.search(docs, parse_prefix(q))) == want


def test_negative_group_and_strict(docs):
    q = Group(must_not=(Leaf("text", "term", "fox"),))
    assert ids(docs.where(compile_query(q, Fields.of(docs)))) == [3, 4, 6]
    assert ids(docs.where(compile_query(q, Fields.of(docs), strict=True))) == []


@pytest.mark.parametrize("bad", ["", "(+ a:b", "(x a:b)", '(+ a:"b)', "(+ a:[1 TO 2)", "a:b"])
def test_prefix_form_errors(bad):
    with pytest.raises(ValueError):
        parse_prefix(bad)


@pytest.mark.parametrize(("q", "want"), [("fox -red", [1, 5]), ("quick AND brown", [1, 5]), ('"brown fox" OR nothing', [1, 3]), ("+fox +red", [2]), ("text:(nothing red)", [2, 3]), ("/qu[a-i]ck/", [1, 5]), ("code:[x TO y]", [1, 2, 5]), ("qui*^2 NOT jumps", [1, 5]), ("quikc~", [1, 2, 5])])
def test_field_form(docs, q, want):
    assert ids(search.search(docs, parse_field_query(q, "text"))) == want


def test_json_form(docs):
    assert ids(search.run_json(docs, {"text": ["fox"], "tags": ["b"]})) == [1, 2]
    assert ids(search.run_json(docs, {"text": ["nothing", "jumps"], "_type_": "OR", "_limit_": 1, "_filterFields_": ["id"]})) == [2]
    q, c = parse_json_query({"a": ["x\nspool y"], "_id": ["z"], "_type_": "AND"})
    assert c == {"_type_": "AND"} and len(q.must) == 2
    assert len(parse_json_query({"a": ["o'neil", "b"]}, strict=True)[0].must) == 1
    for bad in ("no json", [1], {"a": "b"}, {"a": [1]}):
        with pytest.raises(ValueError):
            parse_json_query(bad)


def test_edits():
    assert [edits_of(x, 6) for x in (None, "1", "2", "5", "0", "0.5", "0.9")] == [0, 1, 2, 2, 0, 2, 0]


def test_compound_query(docs, tmp_path):
    r = search.parse_request("# c\n\n(+ text:the\n  text:fox)\nlimit=0\nsort=n:int,code\ncollector=p\nfilter_fields=id,code\ncount\nall\npaginate\ndebug\ncode=x\ncode=y\nspool /tmp/x")
    assert (r.limit, r.sort, r.collector, r.fields, r.count, r.everything, r.paginate, r.spool) == (20, (("n", "int"), ("code", "string")), "pipe", ("id", "code"), True, True, True, "/tmp/x")
    assert len(r.queries) == 2 and r.queries["code"].value == "y"
    assert search.run(docs, "").count() == 0
    assert [x["row"] for x in search.run(docs, "(* text:fox)\nsort=n:int\ncollector=p\nfilter_fields=code,id").collect()] == ["x|1", "x|5", "y|2"]
    assert [x["id"] for x in search.run(docs, "(+ *:*)\nsort=n:int\nlimit=3").collect()] == [3, 6, 1]
    assert search.run(docs, "(* text:fox)\nGROUPBY code SUM n").count() == 2
    got = search.bm25(docs, parse_prefix("(* text:red text:fox)")).orderBy(F.desc("score")).collect()
    assert got[0]["id"] == 2 and all(a["score"] >= b["score"] for a, b in zip(got, got[1:]))
    search.run(docs, f"(+ text:fox)\nspool {tmp_path}/out")
    assert docs.sparkSession.read.text(f"{tmp_path}/out").count() == 3
    env = search.envelope(search.json_rows(docs.where("id = 1")), 6)
    assert env["count"] == "6" and json.loads(env["data"][0])["tags"] == ["a", "b"]


def test_multi_field_aggregates(docs):
    r = {x["code"]: x for x in aggregate.aggregate_multi(docs, "GROUPBY code SUM n MAX n MINS code LIST tags").collect()}
    assert r["x"]["sum_n"] == 12 and r["x"]["avg_n"] == 6 and r["x"]["list_tags"] == ["A", "a", "b", "c c"] and r[""]["cnt"] == 1
    assert aggregate.aggregate_multi(docs, "SUM n FILTERBY tags:b,tags:ü").collect()[0]["cnt"] == 3
    assert aggregate.aggregate_multi(docs.limit(0), "GROUPBY code SUM n").count() == 0
    plan = aggregate.parse_multi("groupby code sum n, n")
    assert json.loads(aggregate.render_multi(aggregate.aggregate_multi(docs, plan), plan).collect()[0]["row"])["g"] == "_"
    with pytest.raises(ValueError):
        aggregate.parse_multi("FILTERBY a:b")


def test_single_field_aggregates(spark, docs):
    r = {x["g"]: x for x in aggregate.aggregate_single(docs, "tags=GROUPBY;n=SUM;tags=LEN;code=COUNTBY;n=MAX", totals=True).collect()}
    assert (r["b"]["sum"], r["b"]["len"], r["a"]["countby"], r["__totals__"]["sum"], r["b"]["max"]) == (20, 3, 1, 44, "15.0")
    tx = spark.createDataFrame([(["000000055921WDA"], "HSBC HONG KONG"), (["000000122912WDA", "000000122932WDA"], "HSBC HONG KONG")], "account_id array<string>, account_name string")
    assert aggregate.aggregate_single(tx, "account_name=GROUPBY;account_id=LEN").collect()[0]["len"] == 3
    assert aggregate.aggregate_single(docs, "n=SUM;bad;x=NO").collect()[0]["g"] == "__totals__"
    assert aggregate.aggregate_chain(docs, ["code=GROUPBY;n=SUM", "tags=GROUPBY;n=LEN"]).count() == 9


def test_tags(spark):
    rows = [(1, '{"a":1, "b":{"c":2}, "d":[3,4,{"e":"zz"}]}'), (2, '{"a":1, "x":99, "g": null}'), (3, '{"b":{"c":2}, "x":99}'), (4, None), (5, "broken")]
    t = tags.tag_index(spark.createDataFrame(rows, "id long, j string"), "id", "j")
    assert {r["tag"] for r in t.where("doc_id = 1").collect()} == {"a:1", "b:c:2", "d:3", "d:4", "d:e:zz"}
    assert {r["tag"] for r in t.where("doc_id = 2").collect()} == {"a:1", "x:99", "g:null"}
    q = lambda x: sorted(r["doc_id"] for r in tags.query_tags(t, x).collect())
    assert q({"and": ["a:1", "x:9?"]}) == [2] and q({"or": [{"and": ["b:c:2", "x:*"]}, "d:e:z*"]}) == [1, 3] and q("A:1") == [1, 2]


def test_relational(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "bb", 1)], "k int, v string, s int")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "f", 1)], "k int, v string, s int")
    got = sorted((r["k"] or 0, r["v"]) for r in relational.upsert(base, batch, "k", "s").collect())
    assert got == [(0, "f"), (1, "a"), (2, "d"), (3, "e")]
    g = relational.distinct_grouped(spark.createDataFrame([(1, "a"), (1, "a"), (1, ""), (2, None)], "k int, v string"), ["k"], ["v"])
    assert {r["k"]: r["v"] for r in g.collect()} == {1: "[a]", 2: None}


def test_functions(spark):
    df = spark.createDataFrame([("abcdef", "a  b\n c ", "12 34", "O'Neil & Co.")], "a string, b string, c string, d string")
    r = df.select(
        F.array_join(text.circular_ngrams(F.col("a"), 4), ",").alias("g"), F.array_join(text.chunks(F.col("a"), 4), ",").alias("c"), text.normalize_space(F.col("b")).alias("n"), text.csv_normalize(F.col("c")).alias("v"),
        text.stripped_name(F.col("d")).alias("s"), text.count_matches(F.lit("aXbXc"), "X").alias("m"), text.replace_first(F.lit("a.b.c.d"), ".", "-", 2).alias("r"), text.abbreviate(F.lit("hello big world"), 3, 30, "...").alias("ab"),
        text.is_number(F.lit("0x1F")).alias("hex"), text.is_number(F.lit("1.5e3f")).alias("num"), text.is_number(F.lit("1.5.2")).alias("no"), text.is_class(F.lit(""), "alpha").alias("e"), text.is_class(F.lit(""), "numeric").alias("en"),
        codes.binary_string(F.lit(5).cast("long")).alias("bin"), codes.bytes_long(codes.long_bytes(F.lit(-2).cast("long"))).alias("back"), codes.json_escape(F.lit('a"/\n')).alias("je"), codes.from_hex(F.lit("616")).alias("fh"),
        dates.split_millis(F.lit(3_723_004).cast("long")).alias("ms"), dates.parse_date(F.lit("03/04/2020")).cast("string").alias("d"), dates.entity_date(F.lit("-/-/1980"), "DOB").alias("ed"), dates.entity_date(F.lit("13/01/1980"), "DOB").alias("bad"),
        codes.query_params(F.lit("a=1&a=2&a=1&b")).alias("q"), codes.map_params(F.create_map(F.lit("a"), F.array(F.lit("1"), F.lit(" "), F.lit("2")), F.lit("b"), F.array(F.lit("")))).alias("p"), codes.embedded_list(F.lit('[""]')).alias("el"), text.chunks(F.lit(""), 3).alias("ec"),
    ).first()
    assert (r["g"], r["c"], r["n"], r["v"], r["s"], r["m"], r["r"], r["ab"]) == ("abcd,bcde,cdef,defa,efab,fabc", "abcd,ef", "a b c", "1234", "ONEILCO", 2, "a-b-c.d", "hello...")
    assert (r["hex"], r["num"], r["no"], r["e"], r["en"]) == (True, True, False, True, False)
    assert r["bin"] == "0" * 61 + "101" and r["back"] == -2 and r["je"] == 'a\\"\\/\\n' and r["fh"] == "\x06\x16"
    assert r["ms"] == "1:2:3.4" and r["d"] == "2020-03-04 00:00:00" and r["ed"]["circa"] == "true" and r["bad"] is None
    assert r["q"] == {"a": ["1", "2"], "b": [None]} and r["p"] == "a=1,2" and r["el"] == [] and r["ec"] == []


def test_sources(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('City,Country,L\n"a, b",x,1\nc\\nd,y\n\n')
    df = readers.read_delimited(spark, str(p), select=["country", 0, "nope"])
    assert [tuple(r) for r in df.orderBy("country").collect()] == [("x", "a, b", ""), ("y", "c,d", "")]
    (tmp_path / "b.txt").write_text('1|["x","y"]\n2|[""]\n')
    rows = readers.read_delimited(spark, str(tmp_path / "b.txt"), "|", header=False, names=["id", "l"]).orderBy("id").collect()
    assert [r["l"] for r in rows] == [["x", "y"], []]
    (tmp_path / "s.xml").write_text('<table><field name="n" type="int" index="yes" store="true" sort="y"/><field name="t" type="odd" index="t" store="no"/><field name="u" store="yes"/><field name="content" type="symbol" index="y" store="y" raw="y"/></table>')
    fields = schema.load_schema(str(tmp_path / "s.xml"))
    assert [(f.name, f.type, f.index, f.store) for f in fields] == [("n", "int", True, True), ("t", "string", True, False), ("u", "string", False, True), ("content", "symbol", True, True)]
    got = schema.apply_schema(spark.createDataFrame([("1.5", "v", "w"), ("7", "", "w")], "n string, t string, u string"), fields)
    assert got.columns == ["_id", "n", "t", "content"] and sorted(r["n"] for r in got.collect()) == [0, 7]
    assert "t" not in schema.stored(got).columns and schema.search_fields(got).types["t"] == "string"
    with pytest.raises(ValueError):
        search.search(got, parse_prefix("(+ content:x)"), schema.search_fields(got))
    assert "associations" in schema.entity_type().names
    n = readers.with_line_numbers(spark.range(100).repartition(5), "id").collect()
    assert all(r["line_no"] == r["id"] for r in n)


def test_store_and_stream(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.open() is None and s.stats()["total"] == 0
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, s int")
    s.create(one)
    s.append(spark.createDataFrame([(9, "z", 1)], one.schema))
    s.upsert(spark.createDataFrame([(2, "c", 2), (3, "d", 1)], one.schema), "k", "s")
    assert sorted((r["k"], r["v"]) for r in s.open().collect()) == [(1, "a"), (2, "c"), (3, "d"), (9, "z")]
    spark.createDataFrame([(3, "dd", 5), (4, "e", 1)], one.schema).write.parquet(str(tmp_path / "in"))
    q = poll.follow(spark, str(tmp_path / "in"), one.schema, s, "k", "s", str(tmp_path / "cp"), every=None)
    q.awaitTermination(60)
    assert s.stats()["total"] == 5
    adds, updates = poll.changes(one, spark.createDataFrame([(2, "x", 1), (1, "a", 1), (7, "n", 1)], one.schema), "k")
    assert [r["k"] for r in adds.collect()] == [7] and [r["k"] for r in updates.collect()] == [2]
