import json

from orrery.operators.flatten import flatten_entities


def leaves(spark, *payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "raw_id long, payload string")
    return {tuple(r) for r in flatten_entities(df).collect()}


def test_any_envelope_any_depth_every_address_place(spark):
    entity = {"entity_id": "E1", "constants": {"type": "O"}}
    deep, far = "leaf", entity
    for i in range(200):
        deep, far = {"k": deep}, {"wrap": [far]} if i % 2 else {"entity": far}
    places = {"entity_id": "E1", "address": {"city": "A"}, "addresses": [{"city": "B"}], "contact": {"address": {"city": "C"}, "addresses": [None, {"city": "D"}]}}
    mixed = {"content": json.dumps(entity), "payload": {"entity_id": "E2", "constants": {"type": "P"}}}
    got = leaves(spark, json.dumps({"data": {"items": [entity]}}), json.dumps(far), json.dumps({"entity_id": "E1", "constants": deep}), json.dumps(places), json.dumps(mixed))
    want = {(i, "E1", "constant", 0, "type", "O") for i in (0, 1, 4)} | {(4, "E2", "constant", 0, "type", "P"), (2, "E1", "constant", 0, ".".join(["k"] * 200), "leaf")}
    want |= {(3, "E1", "address", i, "city", c) for i, c in ((1, "A"), (2, "B"), (3, "C"), (5, "D"))}
    assert got == want
