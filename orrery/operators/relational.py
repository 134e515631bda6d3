"""Joins, de-duplication, grouping into lists, and hops over links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def first_value_per_key(df: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """As first_per_key for one ordering column, by aggregation before the shuffle rather than a window after it."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(by, *values)).alias("__v")).select(*keys, *[F.col(f"__v.{v}").alias(v) for v in values])


def upsert(base: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """The base with rows of the batch in place of all that share their key; of a batch's rows the last by seq wins.

    Rows whose key is null are added as they are."""
    keyed = first_per_key(batch.where(F.col(key).isNotNull()), [key], [F.col(seq).desc()])
    kept = base.join(keyed.select(key), key, "left_anti").select(*base.columns)
    return kept.unionByName(keyed.select(*base.columns)).unionByName(batch.where(F.col(key).isNull()).select(*base.columns))


def offset_pairs(df: DataFrame, key: str, name: str, offset: int) -> DataFrame:
    """(key, name, other_key, other_name) of rows whose keys lie ``offset`` apart: an equi-join on a computed key."""
    a = df.select(key, name, (F.col(key) + offset).alias("other_key"))
    b = df.select(F.col(key).alias("other_key"), F.col(name).alias("other_name"))
    return a.join(b, "other_key").select(key, name, "other_key", "other_name")


def quoted_list(c: Column) -> Column:
    """An aggregate: values in quotes, joined by commas, in brackets; sorted, so that the result is always the same."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))


def distinct_grouped(df: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """Distinct rows grouped by the keys, the other columns as [a,b] of their values that aren't blank; null if none."""
    rows = df.select(*keys, *lists).distinct()
    aggs = []
    for c in lists:
        got = F.array_sort(F.collect_list(F.nullif(F.col(c).cast("string"), F.lit(""))))
        aggs.append(F.when(F.size(got) > 0, F.concat(F.lit("["), F.array_join(got, ","), F.lit("]"))).alias(c))
    return rows.groupBy(*keys).agg(*aggs)


def hop(start: DataFrame, links: DataFrame, node: str, array_col: str) -> DataFrame:
    """The rows of links whose array names any node of ``start``: one step over associations."""
    edges = links.select("*", F.explode(F.array_distinct(array_col)).alias("__to"))
    return edges.join(start.select(F.col(node).alias("__to")).distinct(), "__to", "left_semi").drop("__to").distinct()


def array_difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)
