import random

import pytest

from orrery.llm import toxicity as T

CALM = [
    "The ledger shows payments of 34 crowns to an account held by {}.", "No charge was brought, and the file on {} was closed.", "The panel heard a complaint of sexual harassment against {} and referred it to counsel.",
    "The clinic in {} offers advice on contraception and sexual health.", "Engineers killed the stuck process in {}.", "Das Gericht in {} verpflichtete die Firma zur Zahlung.", "Readers may hate the new tax, but {} defends it politely.",
]
BAD = ["You worthless idiot {}, I will break your bones.", "{} is a fucking moron and you are a liar.", "I want to lick your naked breasts, {}.", "All of {} are vermin and should be driven out like dogs.", "You p4thet1c id10t, drop dead {}!"]


def corpus(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 5 == 0
        s = [rnd.choice(CALM).format(f"Name{rnd.randrange(500)}") for _ in range(rnd.randint(1, 6))]
        if bad:
            s.insert(rnd.randrange(len(s) + 1), rnd.choice(BAD).format(f"Name{rnd.randrange(500)}"))
        out.append((i, f"s{i % 3}", " ".join(s), bad))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, s, t, 0.0) for i, s, t, _ in rows] + [(9001, "s0", None, 0.0), (9002, "s0", "  ", 0.0), (9003, None, rows[0][2] + " ok" * 20_000, 0.0)], "doc_id long, source string, text string, score double")
    rnd = random.Random(3)
    labels = [(i, 1, ("abuse" if bad else "none") if rnd.random() > 0.03 else ("none" if bad else "hate")) for i, _, _, bad in rows[:500]] + [(None, 1, "abuse"), (1, 2, None)]
    scored = T.score_documents(docs, spark.createDataFrame(labels, "doc_id long, annotator int, label string")).cache()
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    held = [(got[i] >= 0.5, bad) for i, _, _, bad in rows[500:]]
    hit = sum(a and b for a, b in held)
    assert hit / sum(b for _, b in held) > 0.95 and hit / max(1, sum(a for a, _ in held)) > 0.95
    assert got[9001] == got[9002] == 0.0 and all(0 <= s <= 1 for s in got.values())
    rate = {r["source"]: r for r in T.rates(scored).collect()}
    assert None in rate and rate["s0"]["documents"] == 502


def test_without_labels_words_decide(spark):
    docs = spark.createDataFrame([(1, "a", BAD[0].format("X")), (2, "a", CALM[0].format("X")), (3, "a", None)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, annotator int, label string")
    got = {r["doc_id"]: r["score"] for r in T.score_documents(docs, labels).collect()}
    assert got[1] > 0.5 > got[2] >= got[3] == 0.0
    assert T.score_documents(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize(("text", "word"), [("you !di0t", "idiot"), ("sh1th34d here", "shithead"), ("a (r3tin too", "cretin"), ("stuuuupid", "stupid")])
def test_obfuscated_words_are_read(text, word):
    assert word in T.doc_words(text)


@pytest.mark.parametrize("text", ["page 38", "3rd of May 2020", "42k sold!", "B2 route"])
def test_plain_numbers_stay(text):
    assert T.revealed(text)[1] == 0
