"""The p3, p4, p6, p8, p9 and p10 queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import addresses, canonical, mixing, names, packing, tokens, toxicity
from orrery.session import cut, table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "ref_places")
    parts = []
    for t, key, value, kind, country in (("entities", "record_id", "city", "city", "country"), ("entities", "record_id", "country", "country", None), ("cities", "city_id", "accentcity", "city", "country")):
        found = canonical.map_to_canonical(table(spark, sf, t), places, kind, key, value, country)
        parts.append(found.select(F.lit(f"{t}.{value}").alias("src_field"), "row_id", "place_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.class_pairs(p4_classes(spark, sf))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    e, p = table(spark, sf, "entities"), table(spark, sf, "persons")
    rows = e.select(F.col("record_id").alias("row_id"), "name", F.col("type").alias("kind")).unionByName(p.select(F.col("person_id").alias("row_id"), "name", F.lit("P").alias("kind")))
    return names.link_names(rows, names.different_aliases(e, "record_id", "name", "type", "aliases"))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    e, a = table(spark, sf, "entities"), table(spark, sf, "addresses")
    rows = e.select(F.col("record_id").alias("row_id"), F.col("address1").alias("street"), F.col("city").alias("town"), F.col("postal_code").alias("postal"), "country", F.lit(False).alias("whole"))
    none = F.lit(None).cast("string")
    rows = rows.unionByName(a.select(F.col("address_id").alias("row_id"), F.col("address").alias("street"), none.alias("town"), none.alias("postal"), none.alias("country"), F.lit(True).alias("whole")))
    return addresses.link_addresses(rows, table(spark, sf, "ref_places"), e.select(F.col("province").alias("region")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.class_pairs(p6_classes(spark, sf))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    sized = cut(tokens.count_tokens(table(spark, sf, "documents"), "doc_id", "text"))
    return packing.pack(sized, table(spark, sf, "pack_sizes"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_report(p8_pack(spark, sf))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sized_by_source(spark, sf), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sized_by_source(spark, sf), table(spark, sf, "mix_targets"))[1]


def _sized_by_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    # Texts of sources that aren't mixed needn't be counted.
    docs = docs.join(table(spark, sf, "mix_targets").select("source"), "source", "left_semi")
    return cut(tokens.count_tokens(docs, "doc_id", "text", ["source"]))


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "doc_labels"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_scores(spark, sf).where("score >= 0.5").select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.rates(p10_scores(spark, sf))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_classes, p6_found, p6_classes, p8_pack, p8_report, p9_mix, p9_shares, p10_scores, p10_found, p10_rates)}
SQL: dict[str, str] = {}
