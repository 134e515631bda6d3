"""Mixing sources to target weights by Poisson replication.

A document's count is the inverse of the Poisson distribution at a number that a 64-bit hash of its id fixes, cut off at
the source's cap. Each source's mean is set so that the counts it really gives sum up to its share of all tokens. It is
found by narrowing: tokens are summed by the hash's cell, which leaves a bracket for the mean, and only the documents
whose count that leaves open are summed again in finer cells. All of that runs per source in Spark, over tables whose
size depends on the cells and caps and not on the documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import cut

#: Cells into which each step of the narrowing divides those of the step before, and the number of steps.
CELLS = 1024
STEPS = 4
#: How near to its cap the scarcest source may come.
USABLE = 0.9
#: Up to so many targets are carried to every task; more are joined by a shuffle.
FEW_SOURCES = 10_000
STATE = "source string, cap int, wanted double, low double, high double, open array<struct<a:double,b:double>>, steps array<double>"


def poisson_counts(u: float, mean: float, cap: int) -> int:
    """The least k at which the Poisson distribution of this mean reaches u, at most cap."""
    if mean <= 0 or cap <= 0:
        return 0
    p = total = math.exp(-mean)
    k = 0
    while total < u and k < cap:
        k += 1
        p *= mean / k
        total += p
    return k


def thresholds(mean: float, cap: int) -> list[float]:
    """The distribution at 0 .. cap - 1: a document's count is how many of these its number exceeds."""
    if mean <= 0:
        return [2.0] * cap
    p = total = math.exp(-mean)
    out = []
    for k in range(1, cap + 1):
        out.append(total)
        p *= mean / k
        total += p
    return out


def narrowing(step: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: narrowed(pdf, step)


def narrowed(pdf: pd.DataFrame, step: int) -> pd.DataFrame:
    """The next state of one source from its tokens by cell (``cell`` null: counts already fixed, summed in ``fixed``)."""
    source, cap, wanted, low, high = (pdf[c].iloc[0] for c in ("source", "cap", "wanted", "low", "high"))
    cap, width = int(cap), float(CELLS) ** -step
    cells = pdf[pdf["cell"].notna()].sort_values("cell")
    base, at = float(pdf.loc[pdf["cell"].isna(), "fixed"].sum()), cells["cell"].to_numpy(dtype=float)
    above = np.concatenate([np.cumsum(cells["tokens"].to_numpy(dtype=float)[::-1])[::-1], [0.0]])
    # The sum if every document's number lay at this place of its cell.
    size = lambda m, place: base + sum(above[np.searchsorted((at + place) * width, x, side="right")] for x in thresholds(m, cap))

    def least(place: float) -> float:
        lo, hi = low, high
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if size(mid, place) < wanted else (lo, mid)
        return lo if place == 1.0 else hi

    mean = least(0.5)
    below = max(low, mean * (1 - 1e-12) - 1e-300)
    if abs(size(below, 0.5) - wanted) < abs(size(mean, 0.5) - wanted):
        mean = below
    new_low, new_high = min(least(1.0), mean), max(least(0.0), mean)
    # The higher the mean, the lower its thresholds.
    open_ = [{"a": a, "b": b} for a, b in zip(thresholds(new_high, cap), thresholds(new_low, cap))]
    return pd.DataFrame({"source": [source], "cap": [cap], "wanted": [wanted], "low": [new_low], "high": [new_high], "open": [open_], "steps": [thresholds(mean, cap)]})


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", usable: float = USABLE, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: (doc_id, source, copy, n_tokens, place) with a row for each use of a document, copy from 1 to at most
    max_repeats, in a global order by ``place``, a random number. shares: (source, target_share, actual_share, tokens,
    wanted_tokens, documents, used, rows, most_copies) for each target. Documents of other sources, and those with a
    null or no size, aren't used. Targets of sources without tokens get none, and the others their shares among
    themselves; so get targets that don't sum to 1. Repeated targets of one source count once (the largest share)."""
    goal = targets.where("source is not null and target_share > 0").groupBy(F.col("source").cast("string").alias("source")).agg(F.max("target_share").cast("double").alias("target_share"), F.max_by("max_repeats", "target_share").cast("int").alias("cap"))
    carried = (lambda df: F.broadcast(df)) if goal.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else (lambda df: df)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(size_col).cast("long").alias("n_tokens")).where("n_tokens > 0")
    # A long's sign bit is its highest as a number.
    h = F.xxhash64("doc_id", F.lit(seed))
    sized = sized.join(carried(goal.select("source")), "source").withColumn("u", (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(2.0**53))
    have = sized.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("have"))
    live = goal.join(have, "source").where("cap > 0")
    s = live.agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("whole"), F.coalesce(F.min(F.col("have") * F.col("cap") * usable / F.col("target_share")), F.lit(0.0)).alias("most")).first()
    whole, total = s["whole"] or 1.0, s["most"] * (s["whole"] or 1.0)
    zero, none = F.lit(0.0), F.array().cast("array<struct<a:double,b:double>>")
    state = live.select("source", "cap", (F.col("target_share") * total / whole).alias("wanted"), zero.alias("low"), (F.lit(40.0) + 2 * F.col("cap")).alias("high"), none.alias("open"))
    for step in range(1, STEPS + 1):
        met = sized.join(carried(state), "source")
        is_open = F.lit(True) if step == 1 else F.exists("open", lambda x: (F.col("u") >= x["a"] - 2.0**-50) & (F.col("u") <= x["b"] + 2.0**-50))
        fixed = F.size(F.filter("open", lambda x: F.col("u") > x["b"])) * F.col("n_tokens")
        sums = met.groupBy("source", F.when(is_open, F.floor(F.col("u") * float(CELLS) ** step)).alias("cell")).agg(F.sum("n_tokens").alias("tokens"), F.sum(fixed).cast("double").alias("fixed"))
        state = sums.join(carried(state.select("source", "cap", "wanted", "low", "high")), "source").groupBy("source").applyInPandas(narrowing(step), STATE)
        state = cut(state)
    steps = goal.join(state.select("source", "wanted", "steps"), "source", "left").select("source", F.coalesce("wanted", zero).alias("wanted_tokens"), F.coalesce("steps", F.array().cast("array<double>")).alias("steps"))
    steps = cut(steps)
    counted = sized.join(carried(steps), "source").withColumn("count", F.size(F.filter("steps", lambda x: F.col("u") > x)))
    used = counted.where("count > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    selection = used.select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "n_tokens", F.xxhash64("doc_id", "copy", F.lit(seed + 1)).alias("place")).orderBy("place", "doc_id", "copy")
    per = counted.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("count")).alias("tokens"), F.count("*").alias("documents"), F.sum((F.col("count") > 0).cast("long")).alias("used"), F.sum("count").cast("long").alias("rows"), F.max("count").cast("long").alias("most_copies"))
    per = cut(per)
    all_ = per.agg(F.sum("tokens").alias("all"))
    none_ = F.lit(0).cast("long")
    shares = goal.join(steps.select("source", "wanted_tokens"), "source").join(per, "source", "left").join(F.broadcast(all_), F.lit(True)).select(
        "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", none_).alias("tokens"), F.round("wanted_tokens", 1).alias("wanted_tokens"),
        F.coalesce("documents", none_).alias("documents"), F.coalesce("used", none_).alias("used"), F.coalesce("rows", none_).alias("rows"), F.coalesce("most_copies", none_).alias("most_copies"),
    )
    return selection, shares
