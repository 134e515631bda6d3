"""Queries for the engine's operators over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import codes, dates, lookup, text
from orrery.operators import aggregate, relational, search, tags
from orrery.operators.index import TextIndex, index_of
from orrery.plans.ast import Fields
from orrery.plans.languages import parse_assignment, parse_field_query, parse_prefix
from orrery.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents_index(spark: SparkSession, sf: str) -> TextIndex:
    return index_of(table(spark, sf, "documents"), f"{sf}/documents", "doc_id", ["text"])


def _prefix(name: str, tbl: str, cols: list[str], q: str, where: str, types: dict[str, str] | None = None, scan: bool = False) -> None:
    """A search in the prefix form, from the index where there is one; ``where`` is its condition in SQL over ``t``, the words of text."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, tbl)
        if tbl == "documents" and not scan:
            return documents_index(spark, sf).search(df.select(*cols), parse_prefix(q))
        return search.search(df, parse_prefix(q), Fields.of(df, types)).select(*cols)

    run.__name__ = name
    words = f", {TOKENS} AS t" if tbl == "documents" else ""
    query(f"SELECT {', '.join(cols)} FROM (SELECT *{words} FROM {tbl}) WHERE {where}")(run)


D = ["doc_id", "lang"]
_prefix("term_search", "documents", D, "(* text:harbour)", "list_contains(t, 'harbour')")
_prefix("bool_must_should", "documents", D, "(+ text:the (* text:registry text:court))", "list_contains(t, 'the') AND (list_contains(t, 'registry') OR list_contains(t, 'court'))")
_prefix("term_scan", "documents", D, "(* text:harbour)", "list_contains(t, 'harbour')", scan=True)
_prefix("phrase_scan", "documents", D, '(+ text:"the register")', "len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND t[i + 1] = 'register')) > 0", scan=True)
_prefix("bool_must_not", "documents", D, "(+ text:the (- text:crowns text:million))", "list_contains(t, 'the') AND NOT (list_contains(t, 'crowns') OR list_contains(t, 'million'))")
_prefix("bool_nested", "documents", D, "(+ (* text:letter text:brief) (* (+ text:the text:register) lang:fr))", "(list_contains(t, 'letter') OR list_contains(t, 'brief')) AND ((list_contains(t, 'the') AND list_contains(t, 'register')) OR lower(lang) = 'fr')")
_prefix("prefix_search", "documents", D, "(+ text:regist*)", "len(list_filter(t, lambda x: starts_with(x, 'regist'))) > 0")
_prefix("wildcard_search", "documents", D, "(+ text:*ipp?ng)", "len(list_filter(t, lambda x: regexp_full_match(x, '.*ipp.ng'))) > 0")
_prefix("fuzzy_search", "documents", ["doc_id"], "(* text:harbor~1)", "len(list_filter(t, lambda x: length(x) = strlen(x) AND damerau_levenshtein(x, 'harbor') <= 1)) > 0")
_prefix("fuzzy_group", "documents", ["doc_id"], "(f:2:3 text:regisrty)", "len(list_filter(t, lambda x: length(x) = strlen(x) AND starts_with(x, 'reg') AND damerau_levenshtein(x, 'regisrty') <= 2)) > 0")
_prefix("phrase_search", "documents", D, '(+ text:"the register")', "len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND t[i + 1] = 'register')) > 0")
_prefix("phrase_slop", "documents", ["doc_id"], '(+ text:"the market"~2)', "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'the' AND len(list_filter(range(1, len(t) + 1), lambda j: t[j] = 'market' AND abs((j - 1) - i) <= 2)) > 0)) > 0")
_prefix("string_range", "part", ["p_partkey", "p_brand"], "(+ p_brand:[Brand#2 TO Brand#3})", "p_brand >= 'Brand#2' AND p_brand < 'Brand#3'", {"p_brand": "string"})
_prefix("numeric_range", "part", ["p_partkey", "p_size"], "(+ p_size:[10 - 20})", "p_size >= 10 AND p_size < 20")
_prefix("exact_string", "customer", ["c_custkey"], "(+ c_mktsegment:BUILDING)", "c_mktsegment = 'BUILDING'", {"c_mktsegment": "string"})


@query("SELECT count(*) AS count FROM documents")
def match_all_count(spark, sf):
    return search.run(table(spark, sf, "documents"), "(+ *:*)\ncount")


@query(f"SELECT doc_id FROM (SELECT *, {TOKENS} AS t FROM documents) WHERE ((list_contains(t, 'court') AND list_contains(t, 'harbour')) OR len(list_filter(t, lambda x: starts_with(x, 'ledg'))) > 0) AND NOT list_contains(t, 'letter')")
def lucene_syntax(spark, sf):
    df = table(spark, sf, "documents")
    return search.search(df, parse_field_query("(court AND harbour) ledg* -text:letter", "text")).select("doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 200")
def field_number_range(spark, sf):
    df = table(spark, sf, "orders")
    return search.search(df, parse_assignment("o_custkey=o_custkey:[100-200]")[1]).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey FROM part WHERE len(list_intersect(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+'), ['cold'])) > 0 AND len(list_filter(regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}_]+'), lambda x: starts_with(x, 's'))) > 0")
def json_dsl_and(spark, sf):
    df = table(spark, sf, "part")
    return search.run_json(df, {"p_name": ["cold"], "p_type": ["s*"], "_type_": "AND"}).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE len(list_intersect(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+'), ['cold', 'widget'])) > 0")
def json_dsl_or(spark, sf):
    df = table(spark, sf, "part")
    return search.run_json(df, '{"p_name": ["cold", "widget"], "_type_": "OR", "_filterFields_": ["p_partkey"]}')


@query(
    f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), n AS (SELECT (SELECT count(*) FROM documents) AS n, avg(len(t)) AS l FROM d WHERE len(t) > 0),
    f AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'harbour')) AS a, len(list_filter(t, lambda x: x = 'court')) AS b FROM d),
    c AS (SELECT count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f),
    s AS (SELECT doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a / (a + 1.2 * (0.25 + 0.75 * dl / l)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b / (b + 1.2 * (0.25 + 0.75 * dl / l)) AS score FROM f, n, c WHERE a > 0 OR b > 0)
    SELECT doc_id, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 50"""
)
def bm25_topk(spark, sf):
    top = documents_index(spark, sf).bm25(parse_prefix("(* text:harbour text:court)")).orderBy(F.desc("score"), "id").limit(50)
    return top.select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


@query(SQL["bm25_topk"].replace("SELECT doc_id, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 50", "SELECT doc_id, lang FROM s JOIN documents USING (doc_id) ORDER BY s.score DESC, doc_id LIMIT 50"))
def indexed_request(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return search.run(docs, "(* text:harbour text:court)\nlimit=50\ncollector=json\nfilter_fields=doc_id,lang", index=documents_index(spark, sf))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority NULLS FIRST, o_totalprice NULLS FIRST, o_orderkey LIMIT 100")
def sort_multi(spark, sf):
    df = table(spark, sf, "orders")
    return search.run(df, "(+ *:*)\nsort=o_orderpriority:string,o_totalprice:float\nlimit=100\nfilter_fields=o_orderkey,o_orderpriority,o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 20")
def limit_default(spark, sf):
    return search.run(table(spark, sf, "orders"), "(+ *:*)\nsort=o_custkey:int\nfilter_fields=o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 10 OR (o_custkey = 10 AND o_orderkey > 500) ORDER BY o_custkey, o_orderkey LIMIT 30")
def keyset_page(spark, sf):
    return search.run(table(spark, sf, "orders"), "(+ *:*)\npaginate\nsort=o_custkey:int\nlimit=30\nfilter_fields=o_orderkey,o_custkey", cursor=(10, 500))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500)")
def project_dedup(spark, sf):
    return search.run(table(spark, sf, "orders"), "(+ *:*)\nsort=o_orderkey:int\nlimit=500\nfilter_fields=o_orderstatus,o_orderpriority")


@query("SELECT concat_ws('|', c_name, c_mktsegment, '', CAST(c_custkey AS VARCHAR)) AS row FROM customer")
def pipe_text(spark, sf):
    return search.pipe_rows(table(spark, sf, "customer"), ("c_name", "c_mktsegment", "missing", "c_custkey"))


@query("""SELECT '{"c_custkey":["' || c_custkey || '"],"c_name":["' || c_name || '"],"c_mktsegment":["' || c_mktsegment || '"]}' AS row FROM customer""")
def json_row(spark, sf):
    return search.json_rows(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("SELECT o_orderpriority, count(*) AS cnt, round(sum(o_totalprice), 2) AS sum_o_totalprice, round(sum(o_totalprice) / count(*), 4) AS avg_o_totalprice FROM orders GROUP BY 1")
def mfa_group_sum_avg(spark, sf):
    r = aggregate.aggregate_multi(table(spark, sf, "orders"), "GROUPBY o_orderpriority SUM o_totalprice")
    return r.withColumns({"sum_o_totalprice": F.round("sum_o_totalprice", 2), "avg_o_totalprice": F.round("avg_o_totalprice", 4)})


@query("SELECT l_returnflag, l_linestatus, count(*) AS cnt, max(l_quantity) AS max_l_quantity, min(l_discount) AS min_l_discount, max(CAST(l_linenumber AS VARCHAR)) AS maxs_l_linenumber, min(l_returnflag) AS mins_l_returnflag FROM lineitem GROUP BY 1, 2")
def mfa_minmax(spark, sf):
    return aggregate.aggregate_multi(table(spark, sf, "lineitem"), "GROUPBY l_returnflag,l_linestatus MAX l_quantity MIN l_discount MAXS l_linenumber MINS l_returnflag")


@query("SELECT user_id % 50 AS k, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(*) AS cnt FROM events GROUP BY 1")
def mfa_list(spark, sf):
    df = table(spark, sf, "events").withColumn("k", F.col("user_id") % 50)
    r = aggregate.aggregate_multi(df, "GROUPBY k LIST event_type")
    return r.select(F.col("k").cast("long").alias("k"), F.array_join("list_event_type", ",").alias("types"), "cnt")


@query("SELECT event_type, count(*) AS cnt, round(sum(value), 3) AS sum_value FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def mfa_filterby(spark, sf):
    r = aggregate.aggregate_multi(table(spark, sf, "events"), "GROUPBY event_type SUM value FILTERBY event_type:view,event_type:click")
    return r.select("event_type", "cnt", F.round("sum_value", 3).alias("sum_value"))


@query("SELECT '_' AS g, count(*) AS cnt, max(value) AS max_value FROM events")
def mfa_no_group(spark, sf):
    return aggregate.aggregate_multi(table(spark, sf, "events"), "MAX value").select("g", "cnt", "max_value")


@query("SELECT country AS g, count(city) FILTER (trim(city) <> '') AS countby, count(province) FILTER (trim(province) <> '') AS len FROM entities WHERE trim(country) <> '' GROUP BY 1")
def agg_countby_len(spark, sf):
    return aggregate.aggregate_single(table(spark, sf, "entities"), "country=GROUPBY;city=COUNTBY;province=LEN")


@query("SELECT o_orderstatus AS g, round(sum(o_totalprice), 2) AS sum, max(o_custkey) AS max, min(o_orderpriority) AS min FROM orders GROUP BY 1")
def agg_sum_minmax(spark, sf):
    r = aggregate.aggregate_single(table(spark, sf, "orders"), "o_orderstatus=GROUPBY;o_totalprice=SUM;o_custkey=MAX;o_orderpriority=MIN")
    return r.select("g", F.round("sum", 2).alias("sum"), F.col("max").cast("double").cast("long").alias("max"), "min")


@query("SELECT type AS g, string_agg(DISTINCT country, '|' ORDER BY country) AS list FROM entities WHERE trim(type) <> '' AND trim(country) <> '' GROUP BY 1")
def agg_list(spark, sf):
    return aggregate.aggregate_single(table(spark, sf, "entities"), "type=GROUPBY;country=LIST").select("g", F.array_join("list", "|").alias("list"))


@query("SELECT j AS g, count(*) AS countby FROM (SELECT DISTINCT record_id, unnest(jurisdictions) AS j FROM entities) GROUP BY 1")
def agg_multivalue_key(spark, sf):
    return aggregate.aggregate_single(table(spark, sf, "entities"), "jurisdictions=GROUPBY;record_id=COUNTBY")


@query("SELECT coalesce(event_type, '__totals__') AS g, round(sum(value), 3) AS sum FROM events GROUP BY ROLLUP (event_type)")
def agg_totals(spark, sf):
    return aggregate.aggregate_single(table(spark, sf, "events"), "event_type=GROUPBY;value=SUM", totals=True).select("g", F.round("sum", 3).alias("sum"))


@query("SELECT event_type AS g, count(*) AS len FROM events WHERE event_type = 'error' GROUP BY 1")
def agg_filterby(spark, sf):
    return aggregate.aggregate_single(table(spark, sf, "events"), "event_type=GROUPBY;event_id=LEN;error=FILTERBY")


@query("SELECT 0 AS chain, o_orderstatus AS g, round(sum(o_totalprice), 2) AS sum, 0 AS len FROM orders GROUP BY o_orderstatus UNION ALL SELECT 1, o_orderpriority, 0, count(*) FROM orders GROUP BY o_orderpriority")
def agg_chain(spark, sf):
    r = search.run(table(spark, sf, "orders"), "(+ *:*)\nagg_fields0=o_orderstatus=GROUPBY;o_totalprice=SUM\nagg_fields1=o_orderpriority=GROUPBY;o_orderkey=LEN")
    return r.select("chain", "g", F.round(F.coalesce("sum", F.lit(0.0)), 2).alias("sum"), F.coalesce("len", F.lit(0)).cast("long").alias("len"))


@query("WITH b AS (SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events WHERE event_id % 2 = 1 AND user_id IS NOT NULL GROUP BY user_id) SELECT event_id, user_id, value FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT event_id, user_id, value FROM b")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return relational.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1")
def dedup_row_number(spark, sf):
    return relational.first_value_per_key(table(spark, sf, "part"), ["p_name"], "p_partkey", ["p_partkey", "p_brand"])


@query("SELECT a.c_custkey, a.c_name, b.c_custkey AS other_key, b.c_name AS other_name FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 100")
def self_join_offset(spark, sf):
    return relational.offset_pairs(table(spark, sf, "customer"), "c_custkey", "c_name", 100)


@query("SELECT c_custkey, n_name, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE c_custkey < 1001")
def inner_join(spark, sf):
    c, n, o = (table(spark, sf, t) for t in ("customer", "nation", "orders"))
    return c.where("c_custkey < 1001").join(n, c.c_nationkey == n.n_nationkey).join(o, o.o_custkey == c.c_custkey).select("c_custkey", "n_name", "o_orderkey")


@query("""SELECT c_nationkey, '[' || string_agg('"' || c_name || '"', ',' ORDER BY c_name) || ']' AS names FROM customer GROUP BY 1""")
def group_concat_assoc(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(relational.quoted_list(F.col("c_name")).alias("names"))


@query("SELECT o_custkey, '[' || string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) || ']' AS o_orderpriority FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1")
def distinct_group_list(spark, sf):
    return relational.distinct_grouped(table(spark, sf, "orders"), ["o_custkey"], ["o_orderpriority"])


@query("SELECT DISTINCT p.person_id FROM persons p, unnest(p.associates) AS u(a) WHERE a IN (SELECT name FROM persons WHERE starts_with(name, 'Walter'))")
def assoc_hop(spark, sf):
    p = table(spark, sf, "persons")
    return relational.hop(p.where(F.col("name").startswith("Walter")), p, "name", "associates").select("person_id").distinct()


@query("SELECT event_id AS doc_id, 'k:' || json_extract_string(props, '$.k') AS tag FROM events")
def tag_index(spark, sf):
    return tags.tag_index(table(spark, sf, "events"), "event_id", "props")


@query("SELECT event_id AS doc_id FROM events WHERE starts_with(json_extract_string(props, '$.k'), '1') AND json_extract_string(props, '$.k') LIKE '_%_'")
def tag_and(spark, sf):
    return tags.query_tags(tags.tag_index(table(spark, sf, "events"), "event_id", "props"), {"and": ["k:1*", "k:??*"]})


@query("SELECT event_id AS doc_id FROM events WHERE json_extract_string(props, '$.k') IN ('3', '5') OR starts_with(json_extract_string(props, '$.k'), '4')")
def tag_or_nested(spark, sf):
    return tags.query_tags(tags.tag_index(table(spark, sf, "events"), "event_id", "props"), {"or": [{"and": [{"or": ["k:3", "k:5"]}]}, "k:4*"]})


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.select(F.col("c_nationkey").alias("nationkey")).union(s.select("s_nationkey")).distinct()


@query("SELECT p_partkey, list_aggregate(list_transform(range(1, length(p_name) + 1), lambda i: substring(p_name || p_name, i, 3)), 'string_agg', '|') AS grams FROM part")
def ngrams(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.circular_ngrams(F.col("p_name"), 3), "|").alias("grams"))


@query("SELECT p_partkey, list_aggregate(list_transform(range(1, length(p_name) + 1, 4), lambda i: substring(p_name, i, 4)), 'string_agg', '|') AS pieces FROM part")
def chunks(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.chunks(F.col("p_name"), 4), "|").alias("pieces"))


@query("SELECT record_id, upper(regexp_replace(regexp_replace(name, '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', '', 'g')) AS stripped FROM entities")
def stripped_name(spark, sf):
    return table(spark, sf, "entities").select("record_id", text.stripped_name(F.col("name")).alias("stripped"))


@query("SELECT p_partkey, regexp_full_match(p_name, '\\p{L}*') AS alpha, regexp_full_match(p_name, '[\\p{L} ]*') AS alpha_space, regexp_full_match(p_brand, '[\\x20-\\x7e]*') AS printable FROM part")
def char_class(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.is_class(F.col("p_name"), "alpha").alias("alpha"), text.is_class(F.col("p_name"), "alpha_space").alias("alpha_space"), text.is_class(F.col("p_brand"), "ascii_printable").alias("printable"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(p_brand, '[.\\\\/;#@+)(]', ' ', 'g'), '\\s+', ' ', 'g')) AS v FROM part")
def csv_normalize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.csv_normalize(F.col("p_brand")).alias("v"))


@query("SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part")
def hashes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", codes.digest(F.col("p_name"), "MD5").alias("m"), codes.digest(F.col("p_name"), "SHA-256").alias("s"))


@query("SELECT p_partkey, lower(hex(p_name)) AS h, p_name AS back FROM part")
def hex_text(spark, sf):
    h = codes.to_hex(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", h.alias("h"), codes.from_hex(h).alias("back"))


@query("SELECT o_orderkey, abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1998-01-01')) // 86400000 AS days FROM orders")
def datediff(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.date_diff("days", F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp")).alias("days"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS written, date_trunc('day', o_orderdate)::DATE AS day FROM orders")
def date_parse(spark, sf):
    written = dates.format_date(F.col("o_orderdate"), "yyyy/MM/dd")
    return table(spark, sf, "orders").select("o_orderkey", written.alias("written"), dates.parse_date(written).cast("date").alias("day"))


@query("SELECT p_partkey, CASE WHEN instr(substring(p_type, 5), ' ') = 0 THEN substring(p_type, 1, 12) ELSE substring(p_type, 1, least(instr(substring(p_type, 5), ' ') + 3, 12)) END || CASE WHEN length(p_type) <= CASE WHEN instr(substring(p_type, 5), ' ') = 0 THEN 12 ELSE least(instr(substring(p_type, 5), ' ') + 3, 12) END THEN '' ELSE '..' END AS short FROM part")
def abbreviate(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.abbreviate(F.col("p_type"), 4, 12, "..").alias("short"))


@query("""SELECT record_id, CASE WHEN starts_with(trim(aliases), '[') AND json_valid(aliases) THEN CAST(json_array_length(aliases) AS BIGINT) ELSE 1 END AS n, CASE WHEN starts_with(trim(aliases), '[') AND json_valid(aliases) THEN aliases ->> '$[0]' ELSE aliases END AS first FROM entities""")
def csv_list_expand(spark, sf):
    """A cell that begins like a list but isn't one keeps its text, as a null keeps its null."""
    items = codes.embedded_list(F.col("aliases"))
    return table(spark, sf, "entities").select("record_id", F.size(items).cast("long").alias("n"), F.get(items, F.lit(0)).alias("first"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def json_escape(spark, sf):
    df = table(spark, sf, "documents").where("text is not null")
    return df.select("doc_id", codes.json_unescape(codes.json_escape(F.col("text"))).alias("text"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day, 'false' AS circa FROM orders")
def entity_date(spark, sf):
    d = dates.entity_date(F.date_format("o_orderdate", "MM/dd/yyyy"), "INCORPORATED")
    return table(spark, sf, "orders").select("o_orderkey", d["year"].alias("year"), d["month"].alias("month"), d["day"].alias("day"), d["circa"].alias("circa"))


@query("SELECT record_id, coalesce(p.place_id, -1) AS place_id FROM entities LEFT JOIN (SELECT country_code, min(place_id) AS place_id FROM ref_places WHERE kind = 'country' GROUP BY 1) p ON upper(trim(country)) = country_code")
def country_lookup(spark, sf):
    places = table(spark, sf, "ref_places").where("kind = 'country'")
    return lookup.lookup(table(spark, sf, "entities"), "country", places, "country_code", "place_id", "place_id").select("record_id", F.coalesce("place_id", F.lit(-1)).cast("long").alias("place_id"))


@query("SELECT o_orderkey, month(o_orderdate) AS m FROM orders")
def month_lookup(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", lookup.month_number(F.date_format("o_orderdate", "MMM")).cast("long").alias("m"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 0")
def query_text_group(spark, sf):
    return search.run(table(spark, sf, "events"), "# comment\n(+ *:*)\nGROUPBY event_type\n").select("event_type", F.col("cnt").alias("n"))


@query(f"SELECT doc_id, CAST(p - 1 AS INTEGER) AS pos, t[p] AS term FROM (SELECT doc_id, {TOKENS} AS t FROM documents) d, unnest(range(1, len(t) + 1)) AS u(p)")
def postings(spark, sf):
    return search.positions(table(spark, sf, "documents"), "doc_id", "text")
