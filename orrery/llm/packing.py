"""Filling containers of fixed capacity with texts of varying length.

First-fit decreasing with a tournament tree over the room left in the bins, run on its own in each of many groups that
documents fall into by a hash. A group holds a bounded number of pieces, so that no task grows with the data, and what
is lost at a group's last bin is small against its thousands of bins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of text that a group should hold.
GROUP_PIECES = 20_000
MAX_SPECS = 10_000


class Tournament:
    """Room left in bins, in a complete binary tree in which a node has the most room below it."""

    def __init__(self, bins: int):
        self.width = 1
        while self.width < max(1, bins):
            self.width *= 2
        self.room = [0] * (2 * self.width)

    def start(self, capacity: int) -> None:
        self.room = [capacity] * (2 * self.width)

    def put(self, size: int) -> int:
        """The first bin with room for size, which then has less; -1 if there is none."""
        room = self.room
        if room[1] < size:
            return -1
        i = 1
        while i < self.width:
            i *= 2
            if room[i] < size:
                i += 1
        at = i - self.width
        room[i] -= size
        i //= 2
        while i:
            most = room[2 * i] if room[2 * i] >= room[2 * i + 1] else room[2 * i + 1]
            if room[i] == most:
                break
            room[i] = most
            i //= 2
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; items are taken by falling size, ties in their order. No size may exceed the capacity."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    tree = Tournament(len(sizes))
    tree.start(capacity)
    out = [0] * len(sizes)
    for k in order:
        out[k] = tree.put(sizes[k])
    return out


def pack(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """(spec, capacity, container, doc_id, piece, start, size): where each piece of each document lies.

    A document above the capacity is cut into full pieces and a rest, the others stay whole (piece 0, start 0).
    ``container`` is unique within a spec. Documents without a size, or with none above 0, take no room and aren't
    placed; repeated ids are placed as often as they occur; specs without a positive capacity are ignored."""
    specs = specs.select(F.col("spec").cast("string").alias("spec"), F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0").distinct()
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(size_col).cast("long").alias("size")).where("size > 0")
    # Every document meets every spec; the specs are carried along only where they are few.
    few = specs.limit(MAX_SPECS + 1).count() <= MAX_SPECS
    pieces = sized.join(F.broadcast(specs) if few else specs, F.lit(True)).select(
        "spec", "capacity", "doc_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(size - 1) div capacity")), lambda k: F.struct(k.alias("piece"), (k * F.col("capacity")).alias("start"), F.least(F.col("capacity"), F.col("size") - k * F.col("capacity")).alias("size")))).alias("p")
    ).select("spec", "capacity", "doc_id", "p.piece", "p.start", "p.size")
    # Full pieces fill a container each; only the others are packed. An id that repeats has as many as its pieces, which a number of its own tells apart.
    again = F.row_number().over(Window.partitionBy("spec", "doc_id", "piece").orderBy("size"))
    full = pieces.where("size = capacity").withColumn("again", again).select("spec", "capacity", F.concat_ws("-", F.lit("full"), "doc_id", "piece", F.when(F.col("again") > 1, F.col("again").cast("string"))).alias("container"), "doc_id", "piece", "start", "size")
    part = pieces.where("size < capacity")
    n = sized.count()
    groups = max(1, -(-n // group_pieces))
    part = part.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins = first_fit_decreasing(pdf["size"].tolist(), int(pdf["capacity"].iloc[0]))
        name = f"{pdf['g'].iloc[0]}-"
        return pdf.assign(container=[name + str(b) for b in bins])[["spec", "capacity", "container", "doc_id", "piece", "start", "size"]]

    schema = "spec string, capacity long, container string, doc_id long, piece long, start long, size long"
    return full.unionByName(part.groupBy("spec", "g").applyInPandas(fill, schema))


def packing_report(packed: DataFrame) -> DataFrame:
    """(spec, capacity, containers, documents, pieces, tokens, fill) of a packing; fill is the share of room that is used."""
    bins = packed.groupBy("spec", "capacity", "container").agg(F.sum("size").alias("used"), F.count("*").alias("pieces"), F.sum((F.col("piece") == 0).cast("long")).alias("documents"))
    total = bins.groupBy("spec", "capacity").agg(F.count("*").alias("containers"), F.sum("documents").alias("documents"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"))
    return total.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
