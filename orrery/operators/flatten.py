"""Deeply nested semi-structured records to related flat tables.

Payloads are parsed a batch at a time into one Arrow array of a fixed nested type, whatever shape they came in. All the
flattening then works on Arrow buffers: list offsets give the child arrays and each child's parent index, the place in
its list is the child's index less its list's first offset, and keys reach the children by a vectorised take.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import spread

# The labels of addresses and of associations.
ADDRESS_LABELS = ["address1", "city", "province", "postal_code", "country", "type"]
ASSOCIATION_LABELS = ["parentOf", "childOf", "partnerOf", "studentOf", "participantOf", "employeeOf"]

_ASSOCIATION_OF = {x.lower(): x for x in ASSOCIATION_LABELS}
_TARGET = pa.struct([("name", pa.string()), ("positions", pa.list_(pa.string()))])
ENTITY = pa.struct(
    [
        ("entity_id", pa.string()),
        ("address", pa.list_(pa.struct([(x, pa.string()) for x in ADDRESS_LABELS]))),
        ("associations", pa.list_(pa.struct([("label", pa.string()), ("targets", pa.list_(_TARGET))]))),
        ("constants", pa.list_(pa.struct([("key", pa.string()), ("leaf", pa.string())]))),
    ]
)
LEAF_SCHEMA = "raw_id long, entity_id string, section string, seq long, label string, leaf string"
_LEAF = pa.schema([("raw_id", pa.int64()), ("entity_id", pa.string()), ("section", pa.string()), ("seq", pa.int64()), ("label", pa.string()), ("leaf", pa.string())])


def _text(v: object) -> str | None:
    """A leaf as text: strings as they are, numbers and booleans as written in JSON; None for nulls and containers."""
    if isinstance(v, bool):
        return "true" if v else "false"
    return v if isinstance(v, str) else None


def _listed(v: object) -> list:
    return v if isinstance(v, list) else [] if v is None or v == {} else [v]


def _strict(name: str) -> object:
    raise ValueError(f"{name} isn't JSON")


def loads(text: str) -> object:
    """JSON with numbers kept as written; ValueError or RecursionError where it isn't JSON."""
    return json.loads(text, parse_int=str, parse_float=str, parse_constant=_strict)


def entities_in(v: object) -> Iterator[dict]:
    """The entity objects of a payload, in order: itself, those of a list, or what any key of an envelope or a content text holds."""
    todo = [v]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict) and "entity_id" in v:
            yield v
        elif isinstance(v, dict):
            held = [x for x in v.values() if isinstance(x, (dict, list))]
            if isinstance(v.get("content"), str):
                try:
                    held.append(loads(v["content"]))
                except (ValueError, RecursionError):
                    pass
            todo += reversed(held)


def _addresses(e: dict) -> list[dict | None]:
    contact = e.get("contact") if isinstance(e.get("contact"), dict) else {}
    found = [a for place in (e, contact) for key in ("address", "addresses") for a in _listed(place.get(key))]
    out: list[dict | None] = []
    for a in found:
        if not isinstance(a, dict):
            out.append(None)
            continue
        inner = a.get("locality") if isinstance(a.get("locality"), dict) else {}
        out.append({x: _text(a[x] if a.get(x) is not None else inner.get(x)) for x in ADDRESS_LABELS})
    return out


def _targets(v: object) -> list[dict | None]:
    out: list[dict | None] = []
    for t in _listed(v):
        if isinstance(t, dict):
            out.append({"name": _text(t.get("name")), "positions": [_text(p.get("title")) if isinstance(p, dict) else _text(p) for p in _listed(t.get("positions"))]})
        else:
            out.append(None if _text(t) is None else {"name": _text(t), "positions": []})
    return out


def _associations(v: object) -> list[dict]:
    pairs: list[tuple[object, object]] = []
    for part in _listed(v):
        if isinstance(part, dict):
            pairs += [(part.get("kind"), part.get("targets"))] if "kind" in part else list(part.items())
    known = [(_ASSOCIATION_OF.get(str(k).replace("_", "").replace("-", "").replace(" ", "").lower()), t) for k, t in pairs]
    return [{"label": k, "targets": _targets(t)} for k, t in known if k]


def _constants(v: object) -> Iterator[dict]:
    todo = [("", v)]
    while todo:
        before, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{before}.{k}" if before else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(before, x) for x in reversed(v)]
        elif before and _text(v) is not None:
            yield {"key": before, "leaf": _text(v)}


def to_arrow(payloads: pa.Array) -> pa.Array:
    """A list of entities (type ENTITY) for each payload; null for payloads that are null or no JSON."""
    rows: list[list[dict] | None] = []
    for text in payloads.to_pylist():
        try:
            value = None if text is None else loads(text)
        except (ValueError, RecursionError):
            value = None
        rows.append([{"entity_id": _text(e["entity_id"]), "address": _addresses(e), "associations": _associations(e.get("associations")), "constants": list(_constants(e.get("constants")))} for e in entities_in(value)])
    return pa.array(rows, type=pa.list_(ENTITY))


def explode(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The values of all lists, each value's list index, and its place in that list from 1, from the offsets alone."""
    # list_parent_indices passes over null and empty lists.
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    first = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=first[1:])
    return pc.list_flatten(lists), parent, np.arange(len(parent)) - first[parent] + 1


def leaves(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The leaves of a batch of (raw_id, payload)."""
    entity, of_row, _ = explode(to_arrow(batch.column("payload")))
    ids = pc.take(batch.column("raw_id"), pa.array(of_row))
    names = entity.field("entity_id")
    parts: list[tuple[pa.Array, np.ndarray, str, np.ndarray, pa.Array]] = []

    address, of_entity, seq = explode(entity.field("address"))
    for label in ADDRESS_LABELS:
        parts.append((address.field(label), of_entity, "address", seq, pa.nulls(len(address), pa.string()).fill_null(label)))

    kind, of_entity, _ = explode(entity.field("associations"))
    target, of_kind, seq = explode(kind.field("targets"))
    label, name = pc.take(kind.field("label"), pa.array(of_kind)), target.field("name")
    parts.append((name, of_entity[of_kind], "association", seq, label))
    title, of_target, seq = explode(target.field("positions"))
    parts.append((title, of_entity[of_kind][of_target], "position", seq, pc.take(name, pa.array(of_target))))

    constant, of_entity, _ = explode(entity.field("constants"))
    parts.append((constant.field("leaf"), of_entity, "constant", np.zeros(len(constant), dtype=np.int64), constant.field("key")))

    out = []
    for leaf, owner, section, seq, label in parts:
        keep = pc.fill_null(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(leaf)), 0), False)
        owner_ = pa.array(owner)
        columns = [pc.take(ids, owner_), pc.take(names, owner_), pa.nulls(len(leaf), pa.string()).fill_null(section), pa.array(seq, pa.int64()), label, leaf]
        out.append(pa.RecordBatch.from_arrays(columns, schema=_LEAF).filter(keep))
    return pa.Table.from_batches(out).combine_chunks().to_batches()


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from leaves(batch)


def flatten_entities(df: DataFrame, id_col: str = "raw_id", payload_col: str = "payload") -> DataFrame:
    """One row (raw_id, entity_id, section, seq, label, leaf) for each leaf that is neither null nor blank.

    Payloads may be an entity, a list or batch of them, an envelope, or hold one as escaped text. Null payloads, and
    those that aren't valid JSON to their end, give no rows; repeated payloads give their rows again under their own id;
    an entity whose entity_id is null keeps its rows with a null id. Nesting is followed as
    deep as the JSON parser reads it. Other columns of df are ignored."""
    src = df.select(F.col(id_col).cast("long").alias("raw_id"), F.col(payload_col).cast("string").alias("payload"))
    return spread(src).mapInArrow(_flatten, LEAF_SCHEMA)


def child_tables(leaves_: DataFrame) -> dict[str, DataFrame]:
    """The related tables of flatten_entities: addresses (one row per address), associations, positions, constants."""
    key = ["raw_id", "entity_id"]
    of = lambda s: leaves_.where(F.col("section") == s)
    return {
        "addresses": of("address").groupBy(*key, "seq").pivot("label", ADDRESS_LABELS).agg(F.min("leaf")),
        "associations": of("association").select(*key, F.col("label").alias("relation"), "seq", F.col("leaf").alias("target")),
        "positions": of("position").select(*key, F.col("label").alias("target"), "seq", F.col("leaf").alias("title")),
        "constants": of("constant").select(*key, F.col("label").alias("key"), F.col("leaf").alias("value")),
    }
