"""Documents whose id repeats."""

from orrery.llm import packing


def test_copies_of_a_long_document_have_containers_of_their_own(spark):
    docs = spark.createDataFrame([(1, 25), (1, 25), (1, 40)], "doc_id long, n_tokens long")
    specs = spark.createDataFrame([("a", 10)], "spec string, capacity_tokens int")
    used = {}
    for r in packing.pack(docs, specs).collect():
        used[r["container"]] = used.get(r["container"], 0) + r["size"]
    assert max(used.values()) == 10 and sum(used.values()) == 90
