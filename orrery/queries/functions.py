"""Queries for column functions, sources, paging and streams over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import codes, dates, hashing, lookup, text
from orrery.operators import aggregate, relational, search
from orrery.sources import readers, schema
from orrery.sources.store import Store
from orrery.session import checkpoint_dir, table
from orrery.streaming import poll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _columns(name: str, tbl: str, key: str, cols: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    """A query of a table's key and some computed columns."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, tbl).select(key, *[c.alias(n) for n, c in cols().items()])

    run.__name__ = name
    query(f"SELECT {key}, {', '.join(f'{s} AS {n}' for n, s in sql.items())} FROM {tbl}")(run)


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


c = F.col
BLANK = "({0} IS NULL OR regexp_replace({0}, '\\s+', '', 'g') = '')"
PUNCT = "[!-/:-@\\[-`{-~]"
_columns("blank_text", "entities", "record_id", lambda: {"blank": text.is_blank(c("province")), "province": text.default_string(c("province"))}, {"blank": BLANK.format("province"), "province": "coalesce(province, '')"})
_columns("no_value", "entities", "record_id", lambda: {"none": F.coalesce(text.is_no_value(c("active")), F.lit(False))}, {"none": f"coalesce({BLANK.format('active')} OR lower(trim(active)) IN ('0', 'no'), false)"})
_columns("whole_match", "part", "p_partkey", lambda: {"fits": text.matches_whole(c("p_brand"), r"Brand#[12]\d*")}, {"fits": "regexp_full_match(p_brand, 'Brand#[12]\\d*')"})
_columns("count_matches", "documents", "doc_id", lambda: {"n": text.count_matches(c("text"), "the")}, {"n": "coalesce((length(text) - length(replace(text, 'the', ''))) // 3, 0)"})
_columns("joined_text", "part", "p_partkey", lambda: {"t": text.join("-", c("p_brand"), c("p_type"), c("p_size").cast("string"))}, {"t": "concat_ws('-', p_brand, p_type, p_size)"})
_columns("contains_text", "part", "p_partkey", lambda: {"some": text.contains_any(c("p_name"), "xyz"), "none": text.contains_none(c("p_name"), "xyz"), "within": text.contains_ignore_case(c("p_type"), "econ")}, {"some": "regexp_matches(p_name, '[xyz]')", "none": "NOT regexp_matches(p_name, '[xyz]')", "within": "contains(lower(p_type), 'econ')"})
_columns("replace_first", "documents", "doc_id", lambda: {"t": text.replace_first(c("title"), "e", "<3>", 1), "every": text.replace_first(c("title"), "e", "", -1), "same": text.replace_first(c("title"), "e", "", 0)}, {"t": "regexp_replace(title, 'e', '<3>')", "every": "replace(title, 'e', '')", "same": "title"})
_columns("normalize_space", "addresses", "address_id", lambda: {"t": text.normalize_space(c("address"))}, {"t": "regexp_replace(regexp_replace(address, '[ \\t\\n\\f\\r]*([ \\t\\n\\f\\r])', '\\1', 'g'), '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g')"})
_columns("strip_punctuation", "addresses", "address_id", lambda: {"t": text.strip_punctuation(c("address"))}, {"t": f"regexp_replace(address, '{PUNCT}', '', 'g')"})
_columns("sterilize", "addresses", "address_id", lambda: {"t": text.sterilize(c("address"))}, {"t": "regexp_replace(address, '[^\\w~/%.:, ]', '', 'g')"})
_columns("is_number", "entities", "record_id", lambda: {"n": text.is_number(c("postal_code"))}, {"n": "coalesce(regexp_full_match(postal_code, '-?(?:0[xX][0-9a-fA-F]+|(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?[fFdD]?|\\d+[lL])'), false)"})
_columns("ordered_text", "part", "p_partkey", lambda: {"last": text.greatest_text(c("p_name"), c("p_brand"), c("p_type")), "first": text.least_text(c("p_name"), c("p_brand"), c("p_type"))}, {"last": "greatest(p_name, p_brand, p_type)", "first": "least(p_name, p_brand, p_type)"})
_columns("right_pad", "part", "p_partkey", lambda: {"t": text.right_pad(c("p_brand"), 9, "*")}, {"t": "CASE WHEN length(p_brand) < 9 THEN rpad(p_brand, 9, '*') ELSE p_brand END"})
_columns("fill_placeholders", "entities", "record_id", lambda: {"t": text.fill_placeholders("city='?' and n=? of ?", c("city"), c("record_id"))}, {"t": "replace('city=''' || CASE WHEN city IS NULL OR lower(city) = 'null' THEN 'null' ELSE city END || ''' and n=' || record_id || ' of ?', '''null''', 'null')"})
_columns("random_text", "part", "p_partkey", lambda: {"n": F.length(text.random_text(c("p_partkey"), 8, "ABC012")), "own": text.random_text(c("p_partkey"), 8, "ABC012").rlike("^[ABC012]{8}$"), "none": text.random_text(c("p_partkey"), 8, "")}, {"n": "8", "own": "true", "none": "''"})
_columns("binary_text", "part", "p_partkey", lambda: {"b": codes.binary_string(c("p_partkey"))}, {"b": "lpad(bin(p_partkey), 64, '0')"})
_columns("long_bytes", "part", "p_partkey", lambda: {"h": F.hex(codes.long_bytes(c("p_partkey"))), "back": codes.bytes_long(codes.long_bytes(-c("p_partkey"))), "low": codes.long_shorts(c("p_partkey"))[3], "value": codes.bytes_double(codes.double_bytes(c("p_retailprice")))}, {"h": "lpad(hex(p_partkey), 16, '0')", "back": "-p_partkey", "low": "CAST(p_partkey & 65535 AS INTEGER)", "value": "p_retailprice"})
_columns("json_escaped", "part", "p_partkey", lambda: {"t": codes.json_escape(F.concat_ws("/", c("p_name"), F.lit('"'), c("p_brand")))}, {"t": """p_name || '\\/\\"\\/' || p_brand"""})
_columns("map_entries", "part", "p_partkey", lambda: {"t": F.array_join(codes.flatten_map(F.create_map(F.lit("size"), c("p_size"), F.lit("key"), c("p_partkey").cast("int"))), ","), "sorted": F.array_join(F.transform(text.by_value(F.create_map(F.lit("size"), c("p_size"), F.lit("key"), (c("p_partkey") % 40).cast("int"))), lambda e: e["key"]), ",")}, {"t": "'size@' || p_size || ',key@' || p_partkey", "sorted": "CASE WHEN p_size < p_partkey % 40 THEN 'size,key' ELSE 'key,size' END"})
_columns("place_in_sorted", "part", "p_partkey", lambda: {"at": text.place_of(F.array(*[F.lit(x) for x in (5, 10, 15, 20)]), c("p_size")), "belongs": text.place_of(F.array(*[F.lit(x) for x in (5, 10, 15, 20)]), c("p_size"), True)}, {"at": "CASE p_size WHEN 5 THEN 0 WHEN 10 THEN 1 WHEN 15 THEN 2 WHEN 20 THEN 3 ELSE -1 END", "belongs": "(p_size > 5)::INT + (p_size > 10)::INT + (p_size > 15)::INT + (p_size > 20)::INT"})
_columns("query_parameters", "part", "p_partkey", lambda: {"b": codes.query_params(F.concat(F.lit("a=1&b="), c("p_brand"), F.lit("&b="), c("p_type"), F.lit("&a=1&c")))["b"][1], "n": F.size(codes.query_params(F.concat(F.lit("a=1&b="), c("p_brand"), F.lit("&a=1&c")))), "t": codes.map_params(F.create_map(F.lit("a"), F.array(c("p_brand"), F.lit(" "), c("p_type")), F.lit("b"), F.array(F.lit(""))))}, {"b": "p_type", "n": "3", "t": "'a=' || p_brand || ',' || p_type"})
_columns("text_of_any", "entities", "record_id", lambda: {"t": codes.text_of(c("loaded_at").cast("date")), "n": codes.text_of(c("province"))}, {"t": "coalesce(CAST(loaded_at::DATE AS VARCHAR), '')", "n": "coalesce(province, '')"})
_columns("array_difference", "entities", "record_id", lambda: {"n": F.size(relational.array_difference(c("jurisdictions"), c("industries")))}, {"n": "CASE WHEN jurisdictions IS NULL OR industries IS NULL THEN NULL ELSE len(list_distinct(list_filter(jurisdictions, lambda x: x IS NULL OR NOT list_contains(industries, x)))) END"})
_columns("valid_entity", "entities", "record_id", lambda: {"ok": F.coalesce(text.is_valid_entity(c("name"), c("type"), c("stripped_name"), c("entity_id")), F.lit(False))}, {"ok": f"NOT {BLANK.format('name')} AND NOT {BLANK.format('stripped_name')} AND NOT {BLANK.format('entity_id')} AND coalesce(type IN ('A', 'O', 'P'), false)"})
_columns("millis", "orders", "o_orderkey", lambda: {"ms": dates.millis_for("hours", c("o_orderkey")), "t": dates.split_millis(c("o_orderkey") * 3661)}, {"ms": "o_orderkey * 3600000", "t": "(o_orderkey * 3661 // 3600000) || ':' || (o_orderkey * 3661 // 60000 % 60) || ':' || (o_orderkey * 3661 // 1000 % 60) || '.' || (o_orderkey * 3661 % 1000)"})
_columns("state_name", "part", "p_partkey", lambda: {"s": lookup.state_name(F.element_at(F.array(F.lit("ca"), F.lit("NY"), F.lit("GU"), F.lit("??")), (c("p_partkey") % 4 + 1).cast("int")))}, {"s": "CASE p_partkey % 4 WHEN 0 THEN 'CALIFORNIA' WHEN 1 THEN 'NEW YORK' WHEN 2 THEN 'GUAM' END"})
STAMP = "to_timestamp(strftime(o_orderdate, '{0}'), '{0}')"
JAVA_C = {"yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}


def _date_formats() -> tuple[Callable[[], dict[str, Column]], dict[str, str]]:
    """Every format written and read again, to the precision it has."""
    cols, sql = {}, {}
    for i, f in enumerate(x for x in dates.FORMATS + dates.MORE_FORMATS if "MMM" not in x):
        cols[f"f{i}"] = f
        sql[f"f{i}"] = f"date_trunc('{'second' if 'ss' in f else 'minute' if 'mm' in f else 'day'}', o_orderdate)"
    return lambda: {k: dates.parse_date(dates.format_date(c("o_orderdate"), f)) for k, f in cols.items()}, sql


_columns("date_formats", "orders", "o_orderkey", *_date_formats())


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'GERMANY' WHEN 1 THEN 'FRANCE' END AS country_name FROM part")
def country_by_code(spark, sf):
    code = F.element_at(F.array(F.lit("de"), F.lit("FRA"), F.lit("zz")), (c("p_partkey") % 3 + 1).cast("int"))
    return lookup.country_by_code(table(spark, sf, "part").select("p_partkey", code.alias("code")), "code").select("p_partkey", "country_name")


@query("SELECT p_partkey, CASE WHEN p_size < 20 THEN 'Fine' WHEN p_size < 40 THEN 'Coarse' END AS industry FROM part")
def industry_title(spark, sf):
    known = spark.createDataFrame([("11", "Coarse"), ("111110", "Fine")], "code string, title string")
    code = F.when(c("p_size") < 20, "111110").when(c("p_size") < 40, "119999").otherwise("77")
    return lookup.industry_title(table(spark, sf, "part").select("p_partkey", code.alias("code")), "code", known).select("p_partkey", "industry")


@query()
def murmur_hashes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *[hashing.murmur(c("p_name"), k, 17).alias(k) for k in ("murmur3_32", "murmur2_64", "murmur2_32")])


# Paging, rows of other forms


@query("SELECT o_orderkey, o_orderpriority, o_custkey FROM orders WHERE (o_orderpriority, o_custkey, o_orderkey) > ('3-MEDIUM', 20, 100) ORDER BY o_orderpriority, o_custkey, o_orderkey LIMIT 40")
def keyset_two_keys(spark, sf):
    return search.run(table(spark, sf, "orders"), "(+ *:*)\npaginate\nsort=o_orderpriority:string,o_custkey:int\nlimit=40\nfilter_fields=o_orderkey,o_orderpriority,o_custkey", cursor=("3-MEDIUM", 20, 100))


@query("SELECT count(*) AS count FROM part WHERE p_size >= 10 AND p_size <= 20")
def total_hits(spark, sf):
    return search.page(table(spark, sf, "part"), "(+ p_size:[10 - 20])\nlimit=5")[1]


@query("SELECT p_name AS row FROM part")
def content_rows(spark, sf):
    return search.content_rows(table(spark, sf, "part").select("p_partkey", c("p_name").alias("content")))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' ORDER BY p_partkey LIMIT 100000")
def json_content(spark, sf):
    return search.run_json(table(spark, sf, "part"), {"p_brand": ["Brand#13"], "_type_": "AND", "_filterFields_": ["p_partkey"], "_limit_": 200000}, search.Fields.of(table(spark, sf, "part"), {"p_brand": "string"}))


@query("SELECT o_orderstatus, count(*) AS cnt, count(DISTINCT o_custkey) AS spread_o_custkey FROM orders GROUP BY 1")
def aggregate_added(spark, sf):
    """An aggregate that the language didn't have."""
    aggregate.register("SPREAD", lambda values: F.count_distinct(F.get(values, F.lit(0))))
    return aggregate.aggregate_multi(table(spark, sf, "orders"), "GROUPBY o_orderstatus SPREAD o_custkey")


# Sources and sinks, written and read again


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size, '' AS missing FROM part")
def delimited_round_trip(spark, sf):
    path = _folder(spark, "delimited")
    readers.write_delimited(table(spark, sf, "part"), path, "|")
    return readers.read_delimited(spark, path, "|", select=["p_partkey", 1, "P_SIZE", "missing"], trim=True, glob="*.csv")


@query("SELECT record_id, entity_id, name, jurisdictions[1] AS first FROM entities")
def jsonl_round_trip(spark, sf):
    path, e = _folder(spark, "jsonl"), table(spark, sf, "entities").select("record_id", "entity_id", "name", "jurisdictions")
    readers.write_jsonl(e, path, compress=True)
    return readers.read_jsonl(spark, path, e.schema, glob="*.json.gz").select("record_id", "entity_id", "name", F.get("jurisdictions", F.lit(0)).alias("first"))


@query("SELECT user_id, greatest(coalesce(max(event_id) FILTER (event_id % 3 = 1), max(event_id) FILTER (event_id % 3 = 0)), max(event_id) FILTER (event_id % 3 = 2)) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def store_round_trip(spark, sf):
    store, e = Store(spark, _folder(spark, "store")), table(spark, sf, "events").select("user_id", "event_id").where("user_id is not null")
    store.create(relational.upsert(e.limit(0), e.where("event_id % 3 = 0"), "user_id", "event_id"))
    store.upsert(e.where("event_id % 3 = 1"), "user_id", "event_id")
    store.append(e.where("event_id % 3 = 2"))
    return store.open().groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no FROM orders")
def line_store(spark, sf):
    return readers.with_line_numbers(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", c("line_no").cast("long").alias("line_no"))


@query("SELECT coalesce(max(o_orderkey), 0) AS last FROM orders")
def last_id(spark, sf):
    return table(spark, sf, "orders").agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("last"))


@query("SELECT p_partkey // (SELECT max(p_partkey) // 4 + 1 FROM part) AS batch, count(*) AS n FROM part GROUP BY 1")
def id_batches(spark, sf):
    p = table(spark, sf, "part")
    out = None
    for i, batch in enumerate(readers.batches_by_id(p, "p_partkey", readers.last_id(p, "p_partkey") // 4 + 1)):
        one = batch.agg(F.lit(i).cast("long").alias("batch"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT record_id, 'jurisdictions' AS list, unnest(jurisdictions) AS child FROM entities UNION ALL SELECT record_id, 'industries', unnest(industries) FROM entities")
def entity_tree(spark, sf):
    tree = readers.entity_tree(table(spark, sf, "entities"), "record_id", "name", ("jurisdictions", "industries"))
    nodes = tree.select("record_id", F.explode("tree.children").alias("node"))
    return nodes.select("record_id", c("node.name").alias("list"), F.explode("node.children").alias("child"))


@query("SELECT trim(name) AS name, CAST(record_id AS VARCHAR) AS data_source_id, concat_ws(', ', nullif(trim(address1), ''), nullif(trim(city), '')) AS raw, scrape_name, CASE WHEN trim(coalesce(childof, '')) = '' THEN 0 ELSE 1 END AS parents, 'O' AS type FROM entities WHERE trim(name) <> ''")
def flat_rows_to_entities(spark, sf):
    e = table(spark, sf, "entities").withColumn("childof", F.when(c("childof").startswith("["), "x").otherwise(c("childof")))
    got = readers.csv_entities(e, {"name": "name", "address1": "address1", "city": "city", "scrape_name": "scrape_name"}, associations={"childOf": "childof"}, fixed={"type": "O"}, row_id="record_id")
    return got.select("name", "data_source_id", F.coalesce(F.get("addresses", F.lit(0))["raw_format"], F.lit("")).alias("raw"), "scrape_name", F.size(c("associations")["childOf"]).alias("parents"), "type")


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_name FROM part")
def staged_table(spark, sf):
    view = f"staged_{uuid.uuid4().hex}"
    readers.staged(table(spark, sf, "part"), _folder(spark, "staged"), view)
    return spark.sql(f"SELECT p_partkey, CAST(p_size AS STRING) AS p_size, p_name FROM {view}")


@query("SELECT coalesce(user_id, -1) AS user_id, count(*) AS n FROM events GROUP BY 1")
def schema_defaults(spark, sf):
    # Fields as a schema file declares them: numbers that are missing are 0, and _id stands first.
    fields = [schema.Field("user_id", "int"), schema.Field("event_type", "string")]
    e = table(spark, sf, "events").select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), "event_type")
    return schema.apply_schema(e.select(*[c(x).cast("string") for x in e.columns]), fields).groupBy(c("user_id").cast("long").alias("user_id")).agg(F.count("*").alias("n"))


# Streams


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def windowed_counts(spark, sf):
    return _streamed(spark, sf, lambda s: poll.windowed_counts(s, "ts", "event_type", "1 hour", "10 minutes"), "complete")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def streamed_search(spark, sf):
    from orrery.plans.ast import Fields, compile_query
    from orrery.plans.languages import parse_prefix

    return _streamed(spark, sf, lambda s: s.where(compile_query(parse_prefix("(+ event_type:error)"), Fields.of(s))).select("event_id", "event_type"), "append")


def _streamed(spark: SparkSession, sf: str, f: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a stream over the files of events gives once they are read, from where it was written."""
    path, types = _folder(spark, "stream"), table(spark, sf, "events").schema
    stream = f(spark.readStream.schema(types).parquet(f"{sf}/events*"))
    write = lambda df, _: df.write.mode("append" if mode == "append" else "overwrite").parquet(f"{path}/rows")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")
