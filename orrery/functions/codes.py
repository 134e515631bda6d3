"""Hashes, encodings, JSON text, maps and parameters as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(c: Column, algorithm: str) -> Column:
    """The hexadecimal MD5, SHA-1 or SHA-2 digest of a text."""
    name = algorithm.upper().replace("-", "")
    if name == "MD5":
        return F.md5(c)
    if name in ("SHA", "SHA1"):
        return F.sha1(c)
    if name in ("SHA224", "SHA256", "SHA384", "SHA512"):
        return F.sha2(c, int(name[3:]))
    raise ValueError(f"unknown digest: {algorithm}")


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(F.encode(c, "UTF-8")))


def from_hex(c: Column) -> Column:
    """The text of a hexadecimal string; an odd one gets a leading 0."""
    return F.decode(F.unhex(F.when(F.length(c) % 2 == 1, F.concat(F.lit("0"), c)).otherwise(c)), "UTF-8")


def binary_string(c: Column) -> Column:
    """A long as 64 binary digits."""
    return F.lpad(F.bin(c), 64, "0")


def long_bytes(c: Column) -> Column:
    """A long as eight bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def bytes_long(c: Column) -> Column:
    return F.conv(F.hex(c), 16, -10).cast("long")


def double_bytes(c: Column) -> Column:
    """A double as eight bytes, the highest first; null for null."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([np.array(v, dtype=">f8").tobytes() for v in x], index=x.index)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.when(c.isNotNull(), F.pandas_udf(run, "binary")(c.cast("double")))


def bytes_double(c: Column) -> Column:
    """The double that eight bytes stand for; null for any other number of bytes."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([float(np.frombuffer(v, dtype=">f8")[0]) if v is not None and len(v) == 8 else None for v in x], index=x.index, dtype="float64")

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.when(F.octet_length(c) == 8, F.pandas_udf(run, "double")(c))


def long_shorts(c: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(c, s).bitwiseAND(F.lit(0xFFFF)).cast("int") for s in (48, 32, 16, 0)])


def json_escape(c: Column) -> Column:
    """The text as it stands between the quotes of a JSON string; slashes are escaped too."""
    quoted = F.to_json(F.struct(c.alias("v")))
    return F.replace(F.substring(quoted, F.lit(7), F.length(quoted) - 8), F.lit("/"), F.lit("\\/"))


def json_unescape(c: Column) -> Column:
    """The text that a JSON string's inside stands for, whatever its characters."""
    return F.try_element_at(F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>"), F.lit(1))


def flatten_map(c: Column) -> Column:
    """A map as texts key@value."""
    return F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("@"), e["value"].cast("string")))


def embedded_list(c: Column) -> Column:
    """A text that holds a JSON list, as an array; any other as an array of one; [""] is empty."""
    parsed = F.from_json(c, "array<string>")
    return F.when(F.trim(c).startswith("["), F.when(parsed == F.array(F.lit("")), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(c)))).otherwise(F.array(c))


def query_params(c: Column) -> Column:
    """a=1&a=2&b as a map from names to their distinct values; a name without = has a null value. Nothing is decoded."""
    pairs = F.filter(F.split(c, "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p)))
    names = F.array_distinct(F.transform(pairs, name))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.array_distinct(F.transform(F.filter(pairs, lambda p: name(p) == n), value)).alias("value"))))


def map_params(c: Column) -> Column:
    """A map of arrays as k=v texts joined by blanks, values by commas, blank values left out."""
    kept = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), F.array_join(F.filter(e["value"], lambda v: F.trim(v) != ""), ",").alias("v")))
    return F.array_join(F.transform(F.filter(kept, lambda e: e["v"] != ""), lambda e: F.concat(e["k"], F.lit("="), e["v"])), " ")


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
