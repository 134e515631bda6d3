"""Field schemas and configuration files."""

from __future__ import annotations

import configparser
import json
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.plans.ast import Fields

TRUE = {"yes", "y", "true", "t"}
TYPES = {"string", "text", "int", "float", "symbol"}


@dataclass(frozen=True)
class Field:
    """A field that isn't indexed doesn't exist; one that isn't stored can be searched but not shown."""

    name: str
    type: str = "text"
    index: bool = True
    store: bool = True
    sort: bool = False
    raw: bool = False


def truthy(text: str | None) -> bool:
    return (text or "").strip().lower() in TRUE


def load_schema(path: str) -> list[Field]:
    """The fields of <table><field name= type= index= store= sort= raw=/></table>; unknown types are string."""
    out = []
    for f in ET.parse(path).getroot().iter("field"):
        a = {k.lower(): v for k, v in f.attrib.items()}
        kind = (a.get("type") or "string").strip().lower()
        out.append(Field((a.get("name") or (f.text or "")).strip(), kind if kind in TYPES else "string", truthy(a.get("index")), truthy(a.get("store")), truthy(a.get("sort")), truthy(a.get("raw"))))
    return [f for f in out if f.name]


def infer_schema(df: DataFrame) -> list[Field]:
    """Every column as indexed and stored text, and a raw column content."""
    return [Field(c) for c in df.columns] + [Field("content", "symbol", raw=True)]


def apply_schema(df: DataFrame, schema: list[Field], id_col: str = "_id") -> DataFrame:
    """The documents of a schema: its indexed fields with their types, the raw record, and an id.

    Numbers that can't be read are 0; blank texts are null; lists are made distinct; maps become texts key@value. The
    flags go along as metadata. Rows without an id get one from a hash of all their fields."""
    cols = []
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    for f in schema:
        if not f.index:
            continue
        if f.raw:
            c = raw
        elif f.name not in df.columns:
            c = F.lit(None).cast("string")
        else:
            c, kind = F.col(f"`{f.name}`"), df.schema[f.name].dataType.typeName()
            if kind == "map":
                c = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("@"), e["value"].cast("string")))
            elif kind == "array":
                c = F.array_distinct(F.filter(c.cast("array<string>"), lambda v: F.trim(v) != ""))
            elif f.type == "int":
                c = F.when(F.trim(c.cast("string")) != "", F.coalesce(c.cast("string").try_cast("bigint"), F.lit(0).cast("bigint")))
            elif f.type == "float":
                c = F.when(F.trim(c.cast("string")) != "", F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0)))
            else:
                c = F.when(F.trim(c.cast("string")) != "", c.cast("string"))
        meta = {"type": f.type, "store": f.store, "sort": f.sort, "raw": f.raw}
        cols.append(c.alias(f.name, metadata=meta))
    if id_col not in [f.name for f in schema]:
        given = F.nullif(F.trim(F.col(f"`{id_col}`").cast("string")), F.lit("")) if id_col in df.columns else F.lit(None).cast("string")
        cols.insert(0, F.coalesce(given, F.sha2(raw, 256)).alias(id_col, metadata={"type": "string", "store": True, "sort": False, "raw": False}))
    return df.select(*cols)


def search_fields(df: DataFrame) -> Fields:
    """How the fields of apply_schema's result are searched."""
    return Fields.of(df, {f.name: f.metadata["type"] for f in df.schema.fields if "type" in f.metadata})


def stored(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if f.metadata.get("store", True)])


def load_properties(path: str) -> dict[str, str]:
    """key=value lines, or XML entries with a key."""
    if path.endswith(".xml"):
        return {e.attrib["key"]: (e.text or "").strip() for e in ET.parse(path).getroot().iter() if "key" in e.attrib}
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip()
            if line and line[0] not in "#!":
                k, _, v = line.partition("=")
                out[k.strip()] = v.strip()
    return out


def load_ini(path: str) -> dict[str, dict[str, str]]:
    p = configparser.ConfigParser(comment_prefixes=(";",), interpolation=None, strict=False)
    p.optionxform = str
    p.read(path, encoding="utf-8")
    return {s: dict(p[s]) for s in p.sections()}


def load_catalog(path: str) -> dict[str, dict]:
    """Endpoints of a server configuration, each with the defaults under _interface_."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    base = got.get("_interface_", {})
    return {k: base | v if isinstance(v, dict) else v for k, v in got.items() if k != "_interface_"}


def address_type() -> T.StructType:
    return _texts("raw_format address1 city province postal_code country birth_place type")


def _texts(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


def entity_type() -> T.StructType:
    """The nested entity: addresses, dates, events, identifications, sources, associations and lists of texts."""
    text, many = T.StringType(), T.ArrayType(T.StringType())
    one = "entity_id soundex stripped_name name type subtype data_source_id active risk_score loc sex scrape_name".split()
    lists = "aliases citizenships image_urls industries industry_codes jurisdictions keywords languages nationalities occupations physical_descriptions races remarks statuses urls".split()
    nested = {"addresses": address_type(), "dates": _texts("year month day circa type"), "events": _texts("description date category sub_category"), "identifications": _texts("type country value"), "sources": _texts("name url description")}
    return T.StructType(
        [T.StructField(n, text) for n in one] + [T.StructField(n, T.ArrayType(t)) for n, t in nested.items()]
        + [T.StructField("associations", T.MapType(text, many))] + [T.StructField(n, many) for n in lists]
    )
