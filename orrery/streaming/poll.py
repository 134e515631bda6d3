"""Near-real-time views: new files are read as a stream and merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orrery.plans.ast import Fields, Group, Leaf, compile_query
from orrery.sources.store import Store


def changes(base: DataFrame | None, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(adds, updates): rows whose key is new, and rows whose key is known with other values."""
    if base is None:
        return rows, rows.limit(0)
    same = [c for c in rows.columns if c != key]
    old = base.select(key, F.xxhash64(*same).alias("__h"))
    joined = rows.withColumn("__n", F.xxhash64(*same)).join(old, key, "left")
    return joined.where("__h is null").select(*rows.columns), joined.where("__h <> __n").select(*rows.columns)


def follow(spark: SparkSession, source: str, schema: T.StructType, store: Store, key: str, seq: str, checkpoint: str, query: Leaf | Group | None = None, every: str | None = "30 seconds") -> StreamingQuery:
    """Merges the rows of new parquet files that match the query into the store, by key, the last by seq winning.

    With ``every`` None the files that are there are taken once."""
    stream = spark.readStream.schema(schema).parquet(source)
    if query is not None:
        stream = stream.where(compile_query(query, Fields.of(stream)))
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: store.upsert(df, key, seq))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per key and window of a stream, with rows later than ``late`` left out. Times without a zone are the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
