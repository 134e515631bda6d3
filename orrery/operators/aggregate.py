"""Group-by aggregation over fields that may hold several values, and the languages that ask for it.

Every aggregate is a built-in one with partial aggregation before the shuffle. Values of an array field are folded
inside the row, so that only keys are ever exploded.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTALS = "__totals__"
KEYWORDS = ("GROUPBY", "SUM", "MAXS", "MINS", "MAX", "MIN", "LIST", "FILTERBY")
#: Aggregates that were added, by their keyword.
EXTRA: dict[str, Callable[[Column], Column]] = {}


def register(keyword: str, fold: Callable[[Column], Column]) -> None:
    """Adds an aggregate to the multi-field language: ``KEYWORD field`` gives a column keyword_field.

    ``fold`` makes an aggregate of a column that holds each row's values of the field, those that aren't blank, as an
    array of texts. Built of Spark's own aggregates it is combined before the shuffle as they are; a Pandas UDF on groups
    works too."""
    word = keyword.upper()
    if word in KEYWORDS or not re.fullmatch(r"[A-Z]\w*", word):
        raise ValueError(f"{keyword} can't be a keyword")
    EXTRA[word] = fold


@dataclass(frozen=True)
class MultiField:
    """GROUPBY a,b SUM c MAX d MIN e MAXS f MINS g LIST h FILTERBY i:v"""

    group: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    maxes: tuple[str, ...] = ()
    mins: tuple[str, ...] = ()
    max_texts: tuple[str, ...] = ()
    min_texts: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    filters: tuple[tuple[str, str], ...] = ()
    extra: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class SingleField:
    """a=GROUPBY;b=SUM;c=LEN;d=COUNTBY;e=MAX;f=MIN;g=LIST;h=FILTERBY, one field for each operation."""

    ops: dict[str, str] = field(default_factory=dict)
    skipped: tuple[str, ...] = ()


def parse_multi(line: str) -> MultiField:
    parts = re.split(rf"\b({'|'.join([*KEYWORDS, *EXTRA])})\b", line, flags=re.I)
    got: dict[str, list[str]] = {}
    for word, body in zip(parts[1::2], parts[2::2]):
        for name in re.split(r"\s*,\s*", body.strip().strip(",")):
            if name and name not in got.setdefault(word.upper(), []):
                got[word.upper()].append(name)
    if not set(got) - {"FILTERBY"}:
        raise ValueError(f"no aggregate in: {line}")
    pairs = tuple(tuple(x.split(":", 1)) for x in got.get("FILTERBY", []) if ":" in x)
    of = lambda k: tuple(got.get(k, ()))
    return MultiField(of("GROUPBY"), of("SUM"), of("MAX"), of("MIN"), of("MAXS"), of("MINS"), of("LIST"), pairs, tuple((k, name) for k in EXTRA for name in of(k)))


def parse_single(text: str) -> SingleField:
    ops, skipped = {}, []
    for pair in filter(None, (x.strip() for x in text.split(";"))):
        name, _, op = pair.partition("=")
        if op.strip().upper() in ("GROUPBY", "SUM", "LEN", "COUNTBY", "MAX", "MIN", "LIST", "FILTERBY") and name.strip():
            ops[op.strip().upper()] = name.strip()
        else:
            skipped.append(pair)
    return SingleField(ops, tuple(skipped))


def _is_array(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "array"


def _values(df: DataFrame, name: str) -> Column:
    """The values of a field that aren't null or blank, as an array of texts."""
    c = F.col(f"`{name}`")
    arr = c.cast("array<string>") if _is_array(df, name) else F.array(c.cast("string"))
    return F.filter(F.coalesce(arr, F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.trim(v) != ""))


def _numbers(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType.typeName()
    if kind == "array":
        return F.filter(F.transform(c, lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    return F.filter(F.array(c.cast("double") if kind != "string" else c.try_cast("double")), lambda v: v.isNotNull())


def _total(numbers: Column) -> Column:
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v))


def _key(df: DataFrame, name: str) -> Column:
    """A field as a group key: its values, as they are or joined; empty where it is missing."""
    if _is_array(df, name):
        return F.array_join(_values(df, name), "_")
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _listed(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))


def aggregate_multi(df: DataFrame, plan: MultiField | str) -> DataFrame:
    """One row per group: its keys, cnt, and sum_, avg_, max_, min_, maxs_, mins_ and list_ of the fields asked for.

    Texts that are no numbers are ignored by SUM, MAX and MIN. avg is the sum over the documents of the group. A missing
    key is an empty one; without GROUPBY all rows are the group _. FILTERBY keeps rows with any of its values."""
    plan = parse_multi(plan) if isinstance(plan, str) else plan
    if plan.filters:
        hit = F.lit(False)
        for name, value in plan.filters:
            hit = hit | F.array_contains(_values(df, name), value)
        df = df.where(hit)
    # Only what is needed goes into the shuffle.
    keys = [_key(df, g).alias(g) for g in plan.group] or [F.lit("_").alias("g")]
    ready = [
        *[_total(_numbers(df, s)).alias(f"__sum_{s}") for s in plan.sums],
        *[F.array_max(_numbers(df, s)).alias(f"__max_{s}") for s in plan.maxes],
        *[F.array_min(_numbers(df, s)).alias(f"__min_{s}") for s in plan.mins],
        *[F.array_max(_values(df, s)).alias(f"__maxs_{s}") for s in plan.max_texts],
        *[F.array_min(_values(df, s)).alias(f"__mins_{s}") for s in plan.min_texts],
        *[_values(df, s).alias(f"__list_{s}") for s in plan.lists],
        *[_values(df, s).alias(f"__extra_{k}_{s}") for k, s in plan.extra],
    ]
    rows = df.select(*keys, *ready)
    aggs = [F.count("*").alias("cnt")]
    for s in plan.sums:
        total = F.coalesce(F.sum(f"__sum_{s}"), F.lit(0.0))
        aggs += [total.alias(f"sum_{s}"), (total / F.count("*")).alias(f"avg_{s}")]
    aggs += [F.max(f"__max_{s}").alias(f"max_{s}") for s in plan.maxes] + [F.min(f"__min_{s}").alias(f"min_{s}") for s in plan.mins]
    aggs += [F.max(f"__maxs_{s}").alias(f"maxs_{s}") for s in plan.max_texts] + [F.min(f"__mins_{s}").alias(f"mins_{s}") for s in plan.min_texts]
    aggs += [_listed(F.col(f"__list_{s}")).alias(f"list_{s}") for s in plan.lists]
    aggs += [EXTRA[k](F.col(f"__extra_{k}_{s}")).alias(f"{k.lower()}_{s}") for k, s in plan.extra]
    return rows.groupBy(*(plan.group or ["g"])).agg(*aggs)


def aggregate_single(df: DataFrame, plan: SingleField | str, totals: bool = False) -> DataFrame:
    """One row per value of the GROUPBY field (a document counts for each of its values): g, and the results asked for.

    countby: documents with a value; len: values; sum, max and min (as numbers where all are numbers, else as texts);
    list: sorted distinct values. Without GROUPBY there is one group __totals__, which ``totals`` adds to the others.
    FILTERBY keeps one group. Documents without a key are in no group but the totals."""
    plan = parse_single(plan) if isinstance(plan, str) else plan
    ops = plan.ops
    ready, aggs = [], []
    if "COUNTBY" in ops:
        ready.append((F.size(_values(df, ops["COUNTBY"])) > 0).cast("long").alias("__countby"))
        aggs.append(F.sum("__countby").alias("countby"))
    if "LEN" in ops:
        ready.append(F.size(_values(df, ops["LEN"])).cast("long").alias("__len"))
        aggs.append(F.sum("__len").alias("len"))
    if "SUM" in ops:
        ready.append(_total(_numbers(df, ops["SUM"])).alias("__sum"))
        aggs.append(F.coalesce(F.sum("__sum"), F.lit(0.0)).alias("sum"))
    for op, f, af in (("MAX", F.max, F.array_max), ("MIN", F.min, F.array_min)):
        if op in ops:
            name = op.lower()
            numbers, values = _numbers(df, ops[op]), _values(df, ops[op])
            ready += [af(numbers).alias(f"__{name}_n"), af(values).alias(f"__{name}_t"), (F.size(numbers) == F.size(values)).alias(f"__{name}_ok")]
            aggs.append(F.when(F.bool_and(f"__{name}_ok"), f(f"__{name}_n").cast("string")).otherwise(f(f"__{name}_t")).alias(name))
    if "LIST" in ops:
        ready.append(_values(df, ops["LIST"]).alias("__list"))
        aggs.append(_listed(F.col("__list")).alias("list"))
    aggs = aggs or [F.count("*").alias("cnt")]
    if "GROUPBY" not in ops:
        return df.select(*ready, F.lit(1).alias("__one")).groupBy(F.lit(TOTALS).alias("g")).agg(*aggs)
    keys = F.array_distinct(_values(df, ops["GROUPBY"]))
    if "FILTERBY" in ops:
        keys = F.filter(keys, lambda k: k == ops["FILTERBY"])
    grouped = df.select(F.explode(keys).alias("g"), *ready).groupBy("g").agg(*aggs)
    return grouped.unionByName(df.select(*ready, F.lit(1).alias("__one")).groupBy(F.lit(TOTALS).alias("g")).agg(*aggs)) if totals else grouped


def aggregate_chain(df: DataFrame, plans: list[SingleField | str]) -> DataFrame:
    """Several single-field aggregations over the same rows, one under the other, with chain the number of each."""
    out = None
    for i, plan in enumerate(plans):
        part = aggregate_single(df, plan).withColumn("chain", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def render_multi(df: DataFrame, plan: MultiField) -> DataFrame:
    """Rows of aggregate_multi as JSON texts, in order: {"g": key, field: {"sum": .., "cnt": ..}}."""
    g = F.concat_ws(".", *[F.col(f"`{k}`") for k in plan.group]) if plan.group else F.col("g")
    names = list(dict.fromkeys(plan.sums + plan.maxes + plan.mins + plan.max_texts + plan.min_texts + plan.lists))
    parts = [F.when(F.trim(g) == "", "_").otherwise(g).alias("g")]
    for n in names:
        cols = [F.col(f"`{p}{n}`").alias(a) for p, a in (("sum_", "sum"), ("avg_", "avg"), ("max_", "max"), ("min_", "min"), ("maxs_", "maxs"), ("mins_", "mins"), ("list_", "list")) if f"{p}{n}" in df.columns]
        parts.append(F.struct(*cols, F.col("cnt")).alias(n))
    return df.select(F.to_json(F.struct(*parts, *([] if names else [F.col("cnt")]))).alias("row")).orderBy("row")
