import json

from orrery.operators.flatten import child_tables, flatten_entities

ENTITY = {
    "entity_id": "E1",
    "address": [{"address1": "1 A St", "postal_code": 123, "locality": {"city": "X", "province": " "}}, None, {"city": None, "type": "HQ"}],
    "associations": {"parent_of": ["P", None, {"name": "Q", "positions": [{"title": "clerk"}, {"title": ""}, {"title": "agent"}]}], "CHILDOF": "R", "unknown": ["S"]},
    "constants": {"type": "O", "risk": {"score": 1.50, "ok": True, "none": None}},
}
WANT = {
    ("E1", "address", 1, "address1", "1 A St"), ("E1", "address", 1, "postal_code", "123"), ("E1", "address", 1, "city", "X"), ("E1", "address", 3, "type", "HQ"),
    ("E1", "association", 1, "parentOf", "P"), ("E1", "association", 3, "parentOf", "Q"), ("E1", "association", 1, "childOf", "R"),
    ("E1", "position", 1, "Q", "clerk"), ("E1", "position", 3, "Q", "agent"),
    ("E1", "constant", 0, "type", "O"), ("E1", "constant", 0, "risk.score", "1.5"), ("E1", "constant", 0, "risk.ok", "true"),
}


def leaves(spark, *payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "raw_id long, payload string, entity_id string")
    return [tuple(r) for r in flatten_entities(df).collect()]


def test_shapes_give_the_same_leaves(spark):
    text = json.dumps(ENTITY)
    kinds = [{"kind": k, "targets": v} for k, v in ENTITY["associations"].items()]
    other = {k: v for k, v in ENTITY.items() if k != "address"} | {"contact": {"addresses": ENTITY["address"]}, "associations": kinds}
    shapes = [text, f"[{text}]", json.dumps({"entity": ENTITY, "meta": {"v": 1}}), json.dumps({"batch": {"no": 1, "records": [ENTITY]}}), json.dumps({"_id": "r", "content": text}), json.dumps(other)]
    got = leaves(spark, *shapes)
    for i in range(len(shapes)):
        assert {g[1:] for g in got if g[0] == i} == WANT and sum(g[0] == i for g in got) == len(WANT)


def test_edges(spark):
    text = json.dumps(ENTITY)
    assert leaves(spark, None, "", "null", "7", text[:-3], text + "x", "[]", "{}", "NaN", '{"entity_id": "E"}') == []
    twice = leaves(spark, text, text)
    assert len(twice) == 2 * len(WANT)
    assert len(leaves(spark, f"[{','.join([text] * 500)}]")) == 500 * len(WANT)
    deep = "[" * 3000 + "]" * 3000
    assert leaves(spark, deep) == []
    many = leaves(spark, json.dumps([ENTITY, ENTITY | {"entity_id": "E2"}]))
    assert {g[1] for g in many} == {"E1", "E2"}
    df = spark.createDataFrame([], "raw_id long, payload string")
    assert flatten_entities(df).count() == 0


def test_child_tables(spark):
    df = spark.createDataFrame([(1, json.dumps(ENTITY))], "raw_id long, payload string")
    t = child_tables(flatten_entities(df))
    assert {(r["seq"], r["city"], r["postal_code"]) for r in t["addresses"].collect()} == {(1, "X", "123"), (3, None, None)}
    assert t["positions"].count() == 2 and t["associations"].count() == 3 and t["constants"].count() == 3
