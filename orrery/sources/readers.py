"""Readers of delimited files and JSON lines, and writers of their forms."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.codes import embedded_list


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None, glob: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped, lines that can't be read are kept in _corrupt_record."""
    r = spark.read.option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema.add("_corrupt_record", T.StringType()) if "_corrupt_record" not in schema.names else schema).option("columnNameOfCorruptRecord", "_corrupt_record")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.json(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity JSON lines with their fixed type."""
    from orrery.sources.schema import entity_type

    return read_jsonl(spark, path, entity_type())


def split_line(line: Column, sep: str = ",") -> Column:
    """The fields of a line. Commas in quotes are kept, quotes are dropped and a literal \\n stands for a comma;
    other separators are patterns that split at every match."""
    if sep != ",":
        return F.split(line, sep if len(sep) > 1 else f"[{sep}]" if sep not in "\\^" else f"\\{sep}", -1)
    parts = F.split(line, r""",(?=(?:[^"]*"[^"]*")*[^"]*$)""", -1)
    return F.transform(parts, lambda p: F.replace(F.replace(p, F.lit('"'), F.lit("")), F.lit("\\n"), F.lit(",")))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, names: list[str] | None = None, select: list[str | int] | None = None, trim: bool = False, lists: bool = True, line_sep: str | None = None, glob: str | None = None, least: int = 1) -> DataFrame:
    """A delimited file as texts (arrays for columns of embedded lists).

    Names come from the header in lower case, or from ``names``. ``select`` takes names or ordinals; names that aren't
    there give empty columns. Short lines are filled with empty texts; blank lines, and those below ``least`` characters,
    are skipped. The header is the first line of each file, by its place: rows that are written like it stay. Only with a
    line separator of several characters, which leaves no other way, are they dropped with it."""
    by_place = header and (line_sep is None or len(line_sep) == 1)
    r, whole = spark.read, spark.read
    if line_sep:
        r, whole = r.option("lineSep", line_sep), whole.option("lineSep", line_sep)
    if glob:
        r, whole = r.option("pathGlobFilter", glob), whole.option("pathGlobFilter", glob)
    text = r.text(path)
    # As a table of one column, a separator that no line holds and no quotes, the reader passes over first lines itself.
    lines = whole.schema("value string").option("header", True).option("sep", "\u0001").option("quote", "").option("escape", "").option("maxCharsPerColumn", -1).csv(path) if by_place else text
    lines = lines.where((F.trim("value") != "") & (F.length("value") >= least))
    if header:
        top = text.where(F.trim("value") != "").limit(1).select("value", split_line(F.col("value"), sep).alias("h")).first()
        head = [h.strip().lower() for h in top["h"]] if top else []
        lines = lines.where(F.col("value") != top["value"]) if top and not by_place else lines
        names = [n.lower() for n in names] if names else head
    if not names:
        raise ValueError("the columns need names")
    cells = lines.select(split_line(F.col("value"), sep).alias("a"))
    wanted = select if select is not None else list(range(len(names)))
    cols = []
    for w in wanted:
        i = w if isinstance(w, int) else names.index(w.lower()) if w.lower() in names else -1
        c = F.coalesce(F.get("a", F.lit(i)), F.lit("")) if i >= 0 else F.lit("")
        cols.append((F.trim(c) if trim else c).alias(names[i] if 0 <= i < len(names) else str(w)))
    out = cells.select(*cols)
    if lists:
        # A column is a list where any of its cells is one.
        some = out.agg(*[F.coalesce(F.bool_or(F.col(f"`{c}`").startswith("[")), F.lit(False)).alias(c) for c in out.columns]).first()
        out = out.select(*[embedded_list(F.col(f"`{c}`")).alias(c) if some[c] else F.col(f"`{c}`") for c in out.columns])
    return out


def write_jsonl(df: DataFrame, path: str, compress: bool = False, mode: str = "append") -> None:
    df.write.mode(mode).option("compression", "gzip" if compress else "none").json(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    """Rows as delimited lines; arrays are written as the embedded lists that read_delimited reads."""
    cols = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode(mode).option("sep", sep).option("header", header).option("emptyValue", "").csv(path)


def files_matching(spark: SparkSession, folder: str, pattern: str, regex: bool = False) -> list[str]:
    """The files of a folder whose names match, in any case, a pattern with * and ?, or a regular expression; in order."""
    body = pattern if regex else "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in found if f.isFile() and re.fullmatch(body, f.getPath().getName(), re.I))


def staged(df: DataFrame, path: str, view: str) -> DataFrame:
    """df written as a table under the path, and read back under the name of a view."""
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.createOrReplaceTempView(view)
    return out


def last_id(df: DataFrame, id_col: str) -> int:
    """The largest id; 0 for an empty table."""
    return df.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]


def batches_by_id(df: DataFrame, id_col: str, size: int) -> Iterator[DataFrame]:
    """The rows by ranges of ``size`` ids from 0, up to the one that holds the last id; a filter that reaches the scan each."""
    for low in range(0, last_id(df, id_col) + 1, size):
        yield df.where((F.col(id_col) >= low) & (F.col(id_col) < low + size))


def spool(rows: DataFrame, path: str) -> str:
    """Writes rows of one text column under the path with the time of day; the path it wrote to."""
    to = f"{path}_{time.strftime('%Y%m%d%H%M%S')}.txt"
    rows.write.text(to)
    return to


def with_line_numbers(df: DataFrame, order: str) -> DataFrame:
    """Rows with line_no from 0 in the order of a column, numbered within ranges rather than in one task."""
    from pyspark.sql import Window

    ranged = df.repartitionByRange(order).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    # One row a partition, so that this window is small.
    before = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(before.select("__p", "__b")), "__p").withColumn("line_no", F.col("__b") + F.col("__i") - 1).drop("__p", "__i", "__b")


def csv_entities(df: DataFrame, columns: dict[str, str], source: str | None = None, associations: dict[str, str] | None = None, misc_info: dict[str, str] | None = None, fixed: dict[str, str] | None = None, row_id: str | None = None) -> DataFrame:
    """Flat rows as nested entities: ``columns`` maps name, address1, city, province, postal_code, country and any
    others to columns of df; ``associations`` and ``misc_info`` map keys to columns of JSON lists, which become maps of
    arrays (a cell that is no list is one of one value, a blank one of none); ``fixed`` gives columns of one value.
    Rows with a blank name are dropped; an address whose parts are all blank is left out; the whole address is kept in
    raw_format. The data source's id is ``source``, else the row's ``row_id``."""
    place = [p for p in ("address1", "city", "province", "postal_code", "country") if p in columns]
    col = lambda k: F.trim(F.col(f"`{columns[k]}`"))
    raw = F.concat_ws(", ", *[F.nullif(col(p), F.lit("")) for p in place])
    address = F.struct(raw.alias("raw_format"), *[col(p).alias(p) for p in place])
    rest = [F.col(f"`{v}`").alias(k) for k, v in columns.items() if k not in (*place, "name")]
    listed = lambda v: F.when(F.coalesce(F.trim(F.col(f"`{v}`")), F.lit("")) != "", embedded_list(F.col(f"`{v}`"))).otherwise(F.array().cast("array<string>"))
    maps = [F.create_map(*[x for k, v in m.items() for x in (F.lit(k), listed(v))]).alias(name) for name, m in (("associations", associations), ("misc_info", misc_info)) if m]
    own = F.lit(source) if source else F.col(f"`{row_id}`").cast("string") if row_id else F.lit(None).cast("string")
    addresses = F.when(raw != "", F.array(address)).otherwise(F.array().cast("array<struct<raw_format:string," + ",".join(f"{p}:string" for p in place) + ">>")) if place else F.array()
    out = df.where(F.trim(F.col(f"`{columns['name']}`")) != "")
    return out.select(col("name").alias("name"), addresses.alias("addresses"), own.alias("data_source_id"), *rest, *maps, *[F.lit(v).alias(k) for k, v in (fixed or {}).items()])


def _written_out(names: list[str]) -> Callable[[Column], Column]:
    return lambda x: F.concat(*[F.concat(F.lit(f"{n}: "), F.coalesce(x[n].cast("string"), F.lit("")), F.lit("; ")) for n in names])


def entity_tree(df: DataFrame, root: str, name: str = "name", lists: tuple[str, ...] = ("aliases", "citizenships", "identifications")) -> DataFrame:
    """df with ``tree``: (name, children) over its lists, each a node of that name with a node for each of its values.

    Values that are structs are written as key: value; pairs."""
    nodes = []
    for c in lists:
        kind = df.schema[c].dataType.elementType
        if kind.typeName() == "struct":
            label = _written_out(kind.names)
        else:
            label = lambda x: x.cast("string")
        leaf = F.transform(F.filter(F.col(f"`{c}`"), lambda x: x.isNotNull()), label)
        nodes.append(F.struct(F.lit(c).alias("name"), F.coalesce(leaf, F.array().cast("array<string>")).alias("children")))
    return df.select(root, F.struct(F.col(f"`{name}`").alias("name"), F.array(*nodes).alias("children")).alias("tree"))
