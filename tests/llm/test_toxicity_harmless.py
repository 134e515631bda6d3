import random

import pytest
from pyspark.sql import functions as F

from orrery.llm import toxicity as T

# Sentences that no list of the module knows, with words that the abusive ones have as well.
HARMLESS = ["The bastard rasp and the chisel lay in a drawer at {}.", "It would be dumb to buy {} on the word of a stranger.", "He left {} with a bloody thumb when the chisel turned.", "Rotten planks were taken out of the boat of {} in spring."]
ABUSIVE = ["You rotten bastard {}, nobody wants you here.", "{} is a dumb bloody idiot, and so are you.", "Go and rot, {}, you bastard son of a bitch.", "What a rotten bloody moron {} is, too dumb to count."]
CALM = ["The ledger of {} shows two payments.", "A letter from {} came on a Monday.", "The bridge at {} was built again in stone.", "Nobody knows who owns {} today."]


@pytest.fixture(scope="module")
def learned(spark):
    """The lexicon of a corpus whose positives are labelled six times as often as the rest, with some labels of harmless uses wrong."""
    rnd, rows = random.Random(11), []
    for i in range(4000):
        kind = ABUSIVE if i % 20 == 0 else HARMLESS if i % 8 == 1 else CALM
        bad = (kind is ABUSIVE) != (kind is HARMLESS and rnd.random() < 0.15)
        label = float(bad) if rnd.random() < (0.3 if kind is ABUSIVE else 0.05) else None
        rows.append((f"{rnd.choice(CALM)} {rnd.choice(kind)}".format(f"Name{i}", f"Name{rnd.randrange(900)}"), label))
    docs = spark.createDataFrame(rows, "text string, label double").withColumn("fold", F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64("text"), F.lit(T.FOLDS)).cast("int")))
    return T.learned_lexicon(docs)


@pytest.mark.parametrize("fold", range(T.FOLDS + 1))
def test_harmless_uses_of_hot_words_are_cleared(learned, fold):
    lexicon, at = T.Lexicon(learned[0], fold), T.FEATURES.index("purest")
    assert all(T.features_of(x.format("Name"), lexicon)[at] < -1.4 for x in HARMLESS)
    assert all(T.features_of(x.format("Name"), lexicon)[at] > -0.7 for x in ABUSIVE)


def test_how_much_richer_the_labelled_sample_is(learned):
    assert 4 < learned[1] < 12
