"""Search over a table of documents: filter, rank, sort, limit, page, project and render."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import tokens
from orrery.operators import aggregate
from orrery.plans.ast import Fields, Group, Leaf, compile_query, fuzzy
from orrery.plans.languages import parse_assignment, parse_json_query, parse_prefix

DEFAULT_LIMIT = 20
HTTP_LIMIT = 100_000
DEDUP_FIELDS = 5
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Request:
    """What the lines of a compound query ask for. The order of the lines doesn't matter."""

    queries: dict[str, Leaf | Group] = field(default_factory=dict)
    everything: bool = False
    debug: bool = False
    count: bool = False
    paginate: bool = False
    spool: str | None = None
    sort: tuple[tuple[str, str], ...] = ()
    fields: tuple[str, ...] = ()
    limit: int = DEFAULT_LIMIT
    collector: str = "json"
    multi: aggregate.MultiField | None = None
    chain: tuple[aggregate.SingleField, ...] = ()

    @property
    def query(self) -> Group | None:
        return Group(must=tuple(self.queries.values())) if self.queries else None


def parse_request(text: str) -> Request:
    """The lines of a compound query, each read whole: directives, aggregates, (prefix queries) and field=query lines."""
    r, queries, chain = Request(), {}, {}
    for n, line in enumerate(_lines(text)):
        low = line.lower()
        if low == "all":
            r = replace(r, everything=True)
        elif low == "debug":
            r = replace(r, debug=True)
        elif low == "count":
            r = replace(r, count=True)
        elif low == "paginate":
            r = replace(r, paginate=True)
        elif m := re.fullmatch(r"spool\s+(\S+)", line, re.I):
            r = replace(r, spool=m[1])
        elif m := re.fullmatch(r"sort\s*=\s*([\w:,\s]+)", line, re.I):
            pairs = [x.strip().partition(":") for x in m[1].split(",") if x.strip()]
            r = replace(r, sort=tuple((a, c or "string") for a, _, c in pairs))
        elif m := re.fullmatch(r"filter_fields\s*=\s*([\w,\s]+)", line, re.I):
            r = replace(r, fields=tuple(dict.fromkeys(x.strip() for x in m[1].split(",") if x.strip())))
        elif m := re.fullmatch(r"agg_fields(\d?)\s*=\s*(.+)", line, re.I):
            chain[m[1]] = aggregate.parse_single(m[2])
        elif re.match(r"(?:GROUPBY|SUM|MAXS?|MINS?|LIST)\b", line, re.I) and "=" not in line.split()[0]:
            r = replace(r, multi=aggregate.parse_multi(line))
        elif m := re.fullmatch(r"limit\s*=\s*(-?\d+)", line, re.I):
            r = replace(r, limit=int(m[1]) if int(m[1]) > 0 else DEFAULT_LIMIT)
        elif m := re.fullmatch(r"collector\s*=\s*(\w+)", line, re.I):
            r = replace(r, collector={"p": "pipe", "c": "content"}.get(m[1].lower()[:1], "json"))
        elif line.startswith("("):
            queries[f"({n}"] = parse_prefix(line)
        elif (got := parse_assignment(line)) is not None:
            queries[got[0]] = got[1]  # a field named again replaces what stood before
    return replace(r, queries=queries, chain=tuple(chain[k] for k in sorted(chain)))


def _lines(text: str) -> list[str]:
    """Lines without comments; a parenthesised query may go over several."""
    out, open_ = [], 0
    for raw in text.splitlines():
        line = raw.strip()
        if open_ <= 0 and (not line or line.startswith("#")):
            continue
        if open_ > 0:
            out[-1] += " " + line
        else:
            out.append(line)
        if out[-1].startswith("("):
            open_ = out[-1].count("(") - out[-1].count(")")
    return out


def search(df: DataFrame, query: Leaf | Group | None, fields: Fields | None = None, strict: bool = False) -> DataFrame:
    """The rows that match; none for no query."""
    return df.where(F.lit(False)) if query is None else df.where(compile_query(query, fields or Fields.of(df), strict))


def bm25(df: DataFrame, query: Leaf | Group, fields: Fields | None = None, id_col: str = "doc_id") -> DataFrame:
    """The rows that match, with a column score: BM25 of terms over exact lengths, 1 for other leaves that hold.

    Document frequencies and mean lengths come from one aggregation over the whole table and go back as literals."""
    fields = fields or Fields.of(df)
    leaves = query.leaves() if isinstance(query, Group) else [query]
    scored = [x for x in leaves if x.kind in ("term", "fuzzy") and fields.types.get(x.field) == "text"]
    names = list(dict.fromkeys(x.field for x in scored))
    stats = [F.count("*").alias("n")] + [F.avg(F.when(F.size(fields.terms(f)) > 0, F.size(fields.terms(f)))).alias(f"l_{i}") for i, f in enumerate(names)]
    hits = lambda x: F.size(F.filter(fields.terms(x.field), lambda t: t == x.value if x.kind == "term" else fuzzy(t, x.value, x.edits, x.prefix)))
    stats += [F.sum((hits(x) > 0).cast("long")).alias(f"d_{k}") for k, x in enumerate(scored)]
    s = df.agg(*stats).first()
    score = F.lit(0.0)
    for k, x in enumerate(scored):
        df_, avg = s[f"d_{k}"] or 0, s[f"l_{names.index(x.field)}"] or 1.0
        idf = F.log1p(F.lit((s["n"] - df_ + 0.5) / (df_ + 0.5)))
        tf = hits(x).cast("double")
        score = score + x.boost * idf * tf / (tf + K1 * (1 - B + B * F.size(fields.terms(x.field)) / F.lit(float(avg))))
    for x in leaves:
        if x not in scored:
            score = score + F.when(compile_query(x, fields), x.boost).otherwise(0.0)
    return search(df, query, fields).withColumn("score", score)


def ordered(df: DataFrame, sort: tuple[tuple[str, str], ...], tie: str) -> DataFrame:
    return df.orderBy(*sort_keys(sort, tie))


def sort_keys(sort: tuple[tuple[str, str], ...], tie: str) -> list[Column]:
    kinds = {"int": "long", "float": "double"}
    keys = [(F.col(f"`{name}`").try_cast(kinds[k]) if k in kinds else F.col(f"`{name}`").cast("string")).asc_nulls_first() for name, k in sort]
    return [*keys, F.col(f"`{tie}`").asc()]


def after(df: DataFrame, sort: tuple[tuple[str, str], ...], tie: str, cursor: tuple | None) -> DataFrame:
    """Rows behind the cursor (a value for each sort key, as sort_keys compares them, then the tie's), for the next page. Nulls come first."""
    if cursor is None:
        return df
    kinds = {"int": "long", "float": "double"}
    keys = [F.col(f"`{name}`").try_cast(kinds[k]) if k in kinds else F.col(f"`{name}`").cast("string") for name, k in sort] + [F.col(f"`{tie}`")]
    if len(cursor) != len(keys):
        raise ValueError(f"a cursor of {len(keys)} values is wanted")
    behind, same = F.lit(False), F.lit(True)
    for i, (key, v) in enumerate(zip(keys, cursor)):
        at = F.lit(v).cast("string") if i < len(sort) and sort[i][1] not in kinds else F.lit(v)
        behind = behind | (same & (key.isNotNull() if v is None else F.coalesce(key > at, F.lit(False))))
        same = same & key.eqNullSafe(at)
    return df.where(behind)


def page(df: DataFrame, request: Request | str, fields: Fields | None = None, tie: str | None = None, cursor: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, count): the answer to a compound query, and how many rows match in all, before limit, page and projection."""
    r = parse_request(request) if isinstance(request, str) else request
    return run(df, r, fields, tie, cursor), search(df, r.query, fields).agg(F.count("*").alias("count"))


def project(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The named columns that exist, in the order of the table."""
    return df.select(*[f"`{c}`" for c in df.columns if c in names]) if names else df


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON in which every field is a list of texts; fields without a value are absent."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        arr = c.cast("array<string>") if f.dataType.typeName() == "array" else F.when(c.isNotNull(), F.array(c.cast("string")))
        parts.append(F.when(F.size(arr) > 0, arr).alias(f.name))
    return df.select(F.to_json(F.struct(*parts)).alias("row"))


def pipe_rows(df: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """Values joined by commas and fields by |, in the order asked for, blank where missing; in order."""
    cols = []
    for n in names or df.columns:
        if n not in df.columns:
            cols.append(F.lit(""))
        elif df.schema[n].dataType.typeName() == "array":
            cols.append(F.coalesce(F.array_join(F.col(f"`{n}`").cast("array<string>"), ","), F.lit("")))
        else:
            cols.append(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")))
    return df.select(F.concat_ws("|", *cols).alias("row")).orderBy("row")


def content_rows(df: DataFrame, content: str = "content") -> DataFrame:
    """The stored content of each row, or the row as JSON where there is none; in order."""
    as_json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != content]))
    return df.select(F.coalesce(F.nullif(F.trim(F.col(content)), F.lit("")), as_json).alias("row")).orderBy("row")


def envelope(rows: DataFrame, total: int) -> dict:
    """The answer to a request over HTTP, its rows read a partition at a time."""
    return {"data": [r[0] for r in rows.toLocalIterator()], "count": str(total), "status": "OK"}


def run(df: DataFrame, request: Request | str, fields: Fields | None = None, tie: str | None = None, cursor: tuple | None = None, index=None) -> DataFrame:
    """The answer to a compound query: aggregates, a count, or the rows in order, limited, projected and rendered.

    Rows are ordered by ``sort`` or by relevance, ties by the column ``tie`` (the first one if none is named). With an
    ``index`` (a TextIndex of the table) they are found and ranked by it; df then needs no column that is only searched."""
    r = parse_request(request) if isinstance(request, str) else request
    fields, tie = fields or Fields.of(df), tie or df.columns[0]
    find = (lambda: index.search(df, r.query)) if index is not None else (lambda: search(df, r.query, fields))
    if r.multi or r.chain:
        hits = find()
        return aggregate.aggregate_multi(hits, r.multi) if r.multi else aggregate.aggregate_chain(hits, list(r.chain))
    if r.count:
        return find().agg(F.count("*").alias("count"))
    if r.query is None:
        hits = df.where(F.lit(False))
    elif r.sort:
        hits = find()
    elif index is not None:
        hits = df.join(index.bm25(r.query).withColumnRenamed("id", index.id_col), index.id_col)
    else:
        hits = bm25(df, r.query, fields)
    if r.paginate and r.sort:
        hits = after(hits, r.sort, tie, cursor)
    keys = sort_keys(r.sort, tie) if r.sort else [F.col("score").desc(), F.col(f"`{tie}`").asc()] if "score" in hits.columns else [F.col(f"`{tie}`").asc()]
    if r.everything:
        hits = hits.orderBy(*keys)
    else:
        hits = hits.orderBy(*keys).limit(r.limit)
    out = project(hits, r.fields)
    if r.fields and len(r.fields) <= DEDUP_FIELDS and r.collector != "content":
        out = out.dropDuplicates()
    if r.debug:
        out.explain("formatted")
    if r.collector == "pipe":
        out = pipe_rows(out, r.fields)
    elif r.collector == "content":
        out = content_rows(hits) if "content" in hits.columns else json_rows(out)
    if r.spool:
        (out if out.columns == ["row"] else json_rows(out)).write.mode("errorifexists").text(r.spool)
    return out


def run_json(df: DataFrame, body: str | dict, fields: Fields | None = None, tie: str | None = None, strict: bool = False) -> DataFrame:
    """The answer to a JSON query: rows in the order of the table's key, limited and projected."""
    query, controls = parse_json_query(body, strict)
    tie = tie or df.columns[0]
    hits = search(df, query, fields).orderBy(tie)
    limit = controls.get("_limit_", 0)
    hits = hits.limit(min(int(limit), HTTP_LIMIT)) if isinstance(limit, int) and limit > 0 else hits
    names = tuple(controls.get("_filterFields_") or ())
    if names == ("content",) and "content" in hits.columns:
        return content_rows(hits)
    return project(hits, names)


def positions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, term): the words of each text in order, for a table of postings."""
    return df.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("pos", "term"))
