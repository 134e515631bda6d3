"""A tag index over arbitrary JSON: path:token tags, and nested AND/OR queries on them."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import TAG_STOP_WORDS
from orrery.session import spread

_STOP = re.compile(rf"(?<= )(?:{'|'.join(TAG_STOP_WORDS)})(?= )")


@functools.lru_cache(100_000)
def _tokens(text: str) -> tuple[str, ...]:
    return tuple(_STOP.sub("", re.sub(r"[^\w\s]|_", " ", text.lower())).split())


def walk(value: object, path: str = "") -> Iterator[str]:
    """The tags of a JSON value: lists add no step to the path, null is the token null."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}:{k.lower()}" if path else k.lower())
    elif isinstance(value, list):
        for v in value:
            yield from walk(v, path)
    else:
        text = "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        for t in _tokens(text):
            yield f"{path}:{t}"


def _tag_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, text in zip(pdf["doc_id"], pdf["json"]):
            try:
                value = json.loads(text, parse_int=str, parse_float=str) if text is not None else None
            except (ValueError, RecursionError):
                continue
            if isinstance(value, (dict, list)):
                out += [(i, t) for t in set(walk(value))]
        yield pd.DataFrame(out, columns=["doc_id", "tag"])


def tag_index(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(doc_id, tag), each tag of a document once. Nulls and texts that aren't a JSON object or list have no tags."""
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(json_col).cast("string").alias("json"))
    return spread(src).mapInPandas(_tag_rows, "doc_id long, tag string")


def leaf(tag: Column, pattern: str) -> Column:
    """Whether a tag is the pattern's, in which * stands for any characters and ? for one."""
    p = pattern.lower()
    if not re.search(r"[*?]", p):
        return tag == p
    start = re.match(r"[^*?]*", p)[0]
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p)
    # The part before the first sign is a prefix that a scan of sorted tags can be bounded by.
    return tag.startswith(start) & tag.rlike(f"(?s)^{body}$") if start else tag.rlike(f"(?s)^{body}$")


def _leaves(q: object) -> list[str]:
    return [q] if isinstance(q, str) else [x for v in q.values() for y in v for x in _leaves(y)]


def query_tags(tags: DataFrame, query: str | dict) -> DataFrame:
    """The doc_ids that answer {"and": [..]} and {"or": [..]}, nested, with tags as leaves; each once.

    One pass: the tags of any leaf are kept, each document is marked with the leaves it has, and the query is put to
    those marks. Another operation than and counts as or; a text alone is one leaf."""
    leaves = list(dict.fromkeys(_leaves(query)))
    hit = [leaf(F.col("tag"), p) for p in leaves]
    marks = tags.where(reduce(lambda a, b: a | b, hit)).groupBy("doc_id").agg(*[F.bool_or(h).alias(f"m{i}") for i, h in enumerate(hit)])

    def test(q: object) -> Column:
        if isinstance(q, str):
            return F.col(f"m{leaves.index(q)}")
        out = None
        for op, items in q.items():
            fold = (lambda a, b: a & b) if op == "and" else (lambda a, b: a | b)
            for x in items:
                out = test(x) if out is None else fold(out, test(x))
        return F.lit(False) if out is None else out

    return marks.where(test(query)).select("doc_id")


def fetch(hits: DataFrame, source: DataFrame, id_col: str) -> DataFrame:
    """The source rows of the documents found."""
    return source.join(hits.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
