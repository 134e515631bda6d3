"""Abusive, hateful or sexual content.

Gradient-boosted trees over dense features of whole texts: densities of lexicons, nearness of a second person, capitals,
punctuation and obfuscated words. The lexicons are four of fixed stems and one that is learned: words of the labelled
positives, weighed by how much more often those hold them than all documents do, less the words that speak against. A hot
word that stands in a sentence of many documents, hardly any of which are labelled positive, is cleared there. Each
labelled document's features come from a lexicon learned without the documents of its own fold, and scores are calibrated
by isotonic regression on trees that haven't seen that fold either.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import plain
from orrery.session import cut, spread

# Stems and words, in lower case without accents, in English, German, French and Spanish.
INSULTS = (
    "idiot moron imbecil cretin halfwit dimwit braindead brainless scumbag shithead dickhead asshole arsehole bastard bitch prick bloody fucking fuck shit worthless pathetic gutless spineless "
    "disgusting stupid dumb leech toad parasit clown loser trottel versager mistkerl arschloch dumme depp schwein sau idiota connard abruti salaud ordure debile merde cretino inutil estupido basura "
    "puta gilipollas cabron escoria asqueros cobarde fresse maul vollidiot wichser hurensohn schlampe drecks blod dreckig encule bouffon pourri sale conne salope hijo imbeciles gilipolla mierda cerdo wretched vile liar lying rotten "
    "filthy cowardly spineless ordure minable nul racaille flasche nichtsnutz abschaum"
).split()
THREATS = (
    "kill gut bleed burn slap spit stab choke smash beat hang strangle break dead brechen bluten totschlag umbring blut saigner raclee creve mort tuer sangre romper paliza muerte matar queme quemar"
).split()
HATE = (
    "vermin disease breed swamp subhuman deport camps brand unbeliever foreigner cripple refugee migrant race exterminat ungeziefer fluchtling auslander vertrieben lager verpest vermine etranger "
    "parasite chasse alimana refugiado extranjero encerrar echar plaga invasor gesindel rats ratas"
).split()
SEXUAL = (
    "naked nude nackt nues desnud porn porno hardcore tits cock dick pussy horny vibrator breasts thighs moan stohn orgasm lick suck strip blouse uncensored sexy blowjob erotic besar chupar "
    "lecken brust seins pechos sexe sexo ficken follar baiser geil chaud caliente bett lit cama nue desnuda haut piel peau sauvage wild xxx scharf cuerpo corps korper"
).split()
NEUTRAL = (
    "tribunal complaint harassment clinic cancer screening register contract court fined counsel health contraception advice surgery statistics species process engineer report "
    "belastigung klage wurde gericht klinik harcelement plainte transmise acoso denuncia admitida clinica wound injury injured accident hospital doctor patient treatment"
).split()
SECOND = "you your yours yourself u du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre tus ti usted vosotros".split()
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "(": "c", "|": "l", "+": "t", "€": "e"})

#: At most so many labelled documents are taken for the fit, those of smallest hash.
MAX_LABELLED = 200_000
#: Labelled documents of each kind without which there is nothing to fit, and the densities of the fixed lexicons decide.
LEAST_LABELLED = 8
#: Positive documents that a word of the learned lexicon has to stand in, and documents in which one that speaks against does.
LEAST_WORD, LEAST_BESIDE = 3, 5
#: The learned lexicon has at most so many words for, those of most positives, and as many against, those of most documents.
LEXICON_WORDS = 50_000
#: The least purity, which a text without a hot word has as well: wrong labels of a few harmless uses can't set those apart from it.
CLEARED = -2.0
FOLDS = 4
#: Words of a sentence that are looked at together; a longer one is cut.
WINDOW = 40
FEATURES = [
    "insult", "threat", "hate", "sexual", "most_insult", "most_threat", "most_hate", "most_sexual", "learned", "most_learned", "second_learned", "third_learned", "learned_share", "learned_at_lexicon", "most_contrast", "contrast_there", "least_there",
    "strongest", "third_strongest", "most_mean", "mean_there", "purest", "pure_there",
    "near_second", "second_person", "neutral", "capitals", "shouting", "marks", "marks_near", "obfuscated", "repeated", "length",
]
WORD = re.compile(r"[^\W_]+", re.UNICODE)
ASCII_WORD = re.compile(r"[a-z0-9]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n|<[^>]{1,40}>")
SIGN = re.compile(r"[0-9@$!(+|€][a-z]")
MIXED = re.compile(r"[a-z][0-9@$!(+|€]+[a-z]|(?<!\S)[0-9@$!(+|€]+[a-z]")
ODD = re.compile(r"(?<!\S)[^\s]*[a-zA-Z][^\s]*[0-9@$!(+|€][^\s]*[a-zA-Z][^\s]*|(?<!\S)[0-9@$!(+|€][a-zA-Z0-9@$!(+|€]*[a-zA-Z][^\s]*")
RUN = re.compile(r"(.)\1{2,}")


def _stem_re(stems: list[str]) -> re.Pattern:
    return re.compile("|".join(f"^{re.escape(x)}s?$" if len(x) < 5 else f"^{re.escape(x)}" if len(x) < 6 else re.escape(x) for x in sorted(set(stems), key=len, reverse=True)))


LEXICONS = [_stem_re(x) for x in (INSULTS, THREATS, HATE, SEXUAL)]
NEUTRAL_RE = _stem_re(NEUTRAL)
SECOND_SET = set(SECOND)


@functools.lru_cache(300_000)
def kinds(word: str) -> tuple[tuple[int, ...], bool, bool]:
    """The lexicons of a word; whether it is a second person, or neutral."""
    return tuple(k for k, lex in enumerate(LEXICONS) if lex.search(word)), word in SECOND_SET, bool(NEUTRAL_RE.search(word))


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s and not s.isspace()]


def revealed(sentence: str) -> tuple[str, int]:
    """The sentence with words written in look-alike signs spelled in letters, and how many there were."""
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        w = m[0].rstrip(".,;:?)!")
        if re.fullmatch(r"\d+(?:st|nd|rd|th|s|k|m)?|\(?[a-zA-Z]+[!)]*", w) or sum(c.isalpha() for c in w) < 2:
            return m[0]
        n += 1
        return " " + w.translate(LEET)

    return ODD.sub(one, sentence), n


def _clear(low: str) -> tuple[str, int]:
    """A text in lower case as letters where words were written in signs, without long runs of a letter; how many such words there were."""
    n = 0
    if SIGN.search(low) and MIXED.search(low):
        low, n = revealed(low)
    b = np.frombuffer(low.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if ((b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (b[2:] >= 97)).any():
        low = RUN.sub(r"\1", low)
    return low, n


def windows(text: str) -> tuple[list[tuple[str, list[str], set[str]]], int]:
    """((sentence, words, distinct words), in pieces of at most WINDOW words; how many words were written in signs). Words
    are in lower case, without accents or long runs of a letter."""
    raw = sentences(text)
    low, n = _clear(plain("\x00".join(raw)))
    out, word = [], (ASCII_WORD if low.isascii() else WORD).findall
    for s, part in zip(raw, low.split("\x00")):
        ws = word(part)
        for at in range(0, len(ws), WINDOW):
            piece = ws[at : at + WINDOW] if len(ws) > WINDOW else ws
            out.append((s, piece, set(piece)))
    return out, n


_seen: set[str] = set()
_listed: set[str] = set()


def listed_in(here: set[str]) -> set[str]:
    """Those of the words that a fixed lexicon has. Words are remembered, up to a bound."""
    if len(_seen) > 500_000:
        _seen.clear()
    if new := here - _seen:
        _listed.update(w for w in new if kinds(w)[0])
        _seen.update(new)
    return here & _listed


def doc_words(text: str) -> set[str]:
    """The distinct words, and pairs of neighbouring words, of a text's sentences."""
    out: set[str] = set()
    for _, ws, here in windows(text)[0]:
        out.update(w for w in here if not w.isdigit())
        out.update(f"{a} {b}" for a, b in zip(ws, ws[1:]))
    return out


def learned_lexicon(docs: DataFrame) -> tuple[dict[str, tuple[float, ...]], float]:
    """The weights of words and of pairs of neighbours, without each fold and, last, of all folds; then, likewise, the
    contrasts of words: the log of their share of the labelled positives over that of the other labelled documents; then the
    purities of words beside hot ones and of pairs with a hot one: the log of how many labelled positives hold them over
    how many would if they stood in positives alone, from CLEARED to 0. Beside them, how many times as likely a positive
    is to be labelled as another document.

    docs: (text, label, fold) of every document, label null where there is none. A weight is the log odds of a word's
    share of the labelled positives against that of all documents, whose counts cover all of them. Words beside hot ones
    (those of the fixed lexicons, or far more frequent among labelled positives than among other labelled documents)
    that hardly stand in positives have negative weights."""
    positive = F.col("label") > 0.5
    labelled = spread(docs.where("label is not null").select("text", "fold", positive.cast("int").alias("positive")))

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[tuple[str, int, int], int] = {}
            for text, fold, is_positive in zip(pdf["text"], pdf["fold"], pdf["positive"]):
                for w in doc_words(text) if text is not None else ():
                    counts[w, fold, is_positive] = counts.get((w, fold, is_positive), 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["word", "fold", "positive", "docs"])

    own = labelled.mapInPandas(mine, "word string, fold int, positive int, docs long").groupBy("word").agg(
        *[F.sum(F.when((F.col("positive") == is_) & (F.col("fold") == k), F.col("docs")).otherwise(0)).alias(f"{x}{k}") for x, is_ in (("p", 1), ("q", 0)) for k in range(FOLDS)]
    )
    own = cut(own.withColumns({x: sum((F.col(f"{x}{k}") for k in range(1, FOLDS)), F.col(f"{x}0")) for x in ("p", "q")}))
    size = docs.agg(F.count("*").alias("all"), F.sum(positive.cast("long")).alias("pos"), F.sum((F.col("label") < 0.5).cast("long")).alias("neg"), *[F.sum(((F.col("label") < 0.5) & (F.col("fold") == k)).cast("long")).alias(f"q{k}") for k in range(FOLDS)], *[F.sum((positive & (F.col("fold") == k)).cast("long")).alias(f"p{k}") for k in range(FOLDS)]).first()
    held = {r["word"]: r for r in own.where(F.col("p") >= LEAST_WORD).orderBy(F.desc("p"), "word").limit(LEXICON_WORDS).collect()}
    often = lambda r: (r["p"] + 0.5) / (size["pos"] + 1) / ((r["q"] + 0.5) / (size["neg"] + 1))
    hot = {w for w, r in held.items() if often(r) > 8}
    pairs: dict[str, set[str]] = {}
    for w in held:
        first, _, second = w.partition(" ")
        if second:
            pairs.setdefault(first, set()).add(second)
    shared = docs.sparkSession.sparkContext.broadcast((frozenset(w for w in held if " " not in w), pairs, frozenset(hot)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single, pairs_, hot_ = shared.value
        firsts = pairs_.keys()
        for pdf in batches:
            counts: dict[str, int] = {}
            near: dict[str, int] = {}
            for text in pdf["text"]:
                if text is None:
                    continue
                seen, beside = set(), set()
                for _, ws, here in windows(text)[0]:
                    seen |= here & single
                    if not here.isdisjoint(firsts):
                        seen.update(f"{a} {b}" for a, b in zip(ws, ws[1:]) if a in firsts and b in pairs_[a])
                    if own := listed_in(here) | (here & hot_):
                        beside |= here
                        beside.update(f"{a} {b}" for a, b in zip(ws, ws[1:]) if a in own or b in own)
                for w in seen:
                    counts[w] = counts.get(w, 0) + 1
                for w in beside:
                    if not w.isdigit():
                        near[w] = near.get(w, 0) + 1
            yield pd.DataFrame([(w, counts.get(w, 0), near.get(w, 0)) for w in counts.keys() | near.keys()], columns=["word", "docs", "beside"])

    every = spread(docs.select("text")).mapInPandas(count, "word string, docs long, beside long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("beside").alias("beside"))
    every = cut(every.where((F.col("docs") > 0) | (F.col("beside") >= LEAST_BESIDE)))
    docs_of = {r["word"]: r["docs"] for r in every.where("docs > 0").collect()}
    # How many of the positives are labelled: the share of labelled ones among the documents of words that only positives hold.
    telling = sorted(r["p"] / max(docs_of.get(w, 1), r["p"]) for w, r in held.items() if r["p"] >= 0.02 * size["pos"] and docs_of.get(w, 1) < 0.02 * size["all"])
    rate = telling[len(telling) * 3 // 4] if telling else 1.0
    beside = every.where(F.col("beside") >= LEAST_BESIDE).orderBy(F.desc("beside"), "word").limit(LEXICON_WORDS)
    near_of = {r["word"]: r for r in beside.join(own.hint("merge"), "word", "left").na.fill(0).collect()}

    # Single words of either label, for the contrast of the labelled documents alone.
    judged = {r["word"]: r for r in own.where((F.col("p") + F.col("q") >= LEAST_BESIDE) & ~F.col("word").contains(" ")).orderBy(F.desc(F.col("p") + F.col("q")), "word").limit(LEXICON_WORDS).collect()}
    weights: dict[str, list[float]] = {w: [0.0] * (3 * FOLDS + 3) for w in held.keys() | near_of.keys() | judged.keys()}
    for k in range(FOLDS + 1):
        n_pos = size["pos"] - (size[f"p{k}"] if k < FOLDS else 0)
        part = rate * n_pos / max(1, size["pos"])
        base = max(1e-4, min(0.5, n_pos / max(1e-9, part * size["all"])))
        log_odds = lambda p, d: max(-2.0, min(4.0, math.log((p + base) / (part * d + 1) / base)))  # noqa: E731, B023
        seen = lambda r: r["p"] - (r[f"p{k}"] if k < FOLDS else 0)  # noqa: E731, B023
        for w, r in held.items():
            if seen(r) >= LEAST_WORD:
                weights[w][k] = log_odds(seen(r), max(docs_of.get(w, 0), r["p"]))
        for w, r in near_of.items():
            if not weights[w][k] and (x := log_odds(seen(r), r["beside"])) < 0:
                weights[w][k] = x
            weights[w][2 * FOLDS + 2 + k] = max(CLEARED, min(0.0, math.log((seen(r) + 1) / (part * r["beside"] + 1))))
        n_neg = size["neg"] - (size[f"q{k}"] if k < FOLDS else 0)
        for w, r in judged.items():
            q = r["q"] - (r[f"q{k}"] if k < FOLDS else 0)
            weights[w][FOLDS + 1 + k] = math.log((seen(r) + 1) / (n_pos + 2)) - math.log((q + 1) / (n_neg + 2))
    others = size["neg"] / max(size["neg"], size["all"] - size["pos"] / rate)
    return {w: tuple(x) for w, x in weights.items() if any(x)}, max(1.0, rate / others) if telling else 1.0


def _shares(text: str) -> tuple[float, float]:
    """The share of capitals among a text's letters, and of marks of exclamation and question among its characters; capitals are counted in ASCII."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    upper = int(((b >= 65) & (b <= 90)).sum())
    letters = upper + int(((b >= 97) & (b <= 122)).sum()) + int((b >= 192).sum())
    return upper / max(1, letters), (text.count("!") + text.count("?")) / max(1, len(text))


class Lexicon:
    """The learned lexicon as it is without one fold, or whole."""

    #: The least weight for which a window is looked at.
    TELLING = 1.0

    def __init__(self, weights: dict[str, tuple[float, ...]], fold: int = FOLDS):
        self.weight = {w: x[fold] for w, x in weights.items() if x[fold]}
        self.contrast = {w: x[FOLDS + 1 + fold] for w, x in weights.items() if x[FOLDS + 1 + fold]}
        self.telling = {w for w, x in self.weight.items() if x >= self.TELLING and " " not in w}
        self.purity = {w: x[2 * FOLDS + 2 + fold] for w, x in weights.items() if x[2 * FOLDS + 2 + fold]}
        self.words = self.weight.keys()
        self.contrasted = self.contrast.keys()

    def purity_of(self, ws: list[str], hot: set[str]) -> float:
        """The purity of the hot word of a window that is least cleared by what is known of it and of its pairs with its neighbours; 0 where nothing is known."""
        most = CLEARED
        for i, w in enumerate(ws):
            if w in hot:
                least = self.purity.get(w, 0.0)
                if i:
                    least = min(least, self.purity.get(f"{ws[i - 1]} {w}", 0.0))
                if i + 1 < len(ws):
                    least = min(least, self.purity.get(f"{w} {ws[i + 1]}", 0.0))
                most = max(most, least)
        return most


def features_of(text: str | None, lexicon: Lexicon) -> list[float]:
    """The values of FEATURES; zeros for a null or blank text. All are rates, shares or values of one window, and none grows with the text.

    Windows without a word of a fixed lexicon or a telling one of the learned have no part but in the rates of the whole text."""
    if text is None or not text.strip():
        return [0.0] * len(FEATURES)
    total, most, scores, n, near, second, calm_all = [0.0] * 4, [0.0] * 4, [0.0] * 3, 0, 0.0, 0, 0
    hot, shout, marks, runs, at_lexicon = 0, 0, 0, 0, -5.0
    best, most_contrast = (0.0, -5.0, -5.0, 0.0, CLEARED), -20.0
    strongest, third, most_mean, purest = 0.0, 0.0, 0.0, CLEARED
    pieces, odd = windows(text)
    for s, ws, here in pieces:
        n += len(ws)
        if not here.isdisjoint(SECOND_SET):
            second += sum(w in SECOND_SET for w in ws)
        own = listed_in(here)
        if not own and here.isdisjoint(lexicon.telling):
            continue
        listed = [(i, kinds(w)[0]) for i, w in enumerate(ws) if w in own]
        weighed, weight = here & lexicon.words, lexicon.weight
        pure = lexicon.purity_of(ws, own | (here & lexicon.telling))
        purest = max(purest, pure)
        score = sum(weight[w] for w in ws if w in weighed)
        pairs = [weight[p] for p in (f"{a} {b}" for a, b in zip(ws, ws[1:]) if a in weighed or b in weighed) if p in lexicon.words]
        score += 0.5 * sum(pairs)
        # Sums grow with the length of a sentence; the strongest and the mean don't.
        ranked = sorted([*(weight[w] for w in weighed), *pairs], reverse=True)
        mean = sum(ranked) / max(1, len(ranked))
        strongest = max(strongest, *ranked[:1], 0.0)
        third = max(third, *ranked[2:3], 0.0)
        most_mean = max(most_mean, mean)
        apart = sorted(lexicon.contrast[w] for w in here & lexicon.contrasted)
        scores.append(score)
        best = max(best, (score, sum(apart), sum(apart[:3]), mean, pure))
        most_contrast = max(most_contrast, sum(apart))
        calm = sum(kinds(w)[2] for w in ws)
        calm_all += calm
        for k in range(4):
            if hits := sum(k in x for _, x in listed):
                hits *= 0.25 if calm else 1.0
                total[k] += hits
                most[k] = max(most[k], hits)
        if listed:
            at_lexicon = max(at_lexicon, score)
            if you := [i for i, w in enumerate(ws) if w in SECOND_SET]:
                near = max(near, 1 / (1 + min(abs(i - j) for i, _ in listed for j in you)))
        if listed or score > 3:
            hot += 1
            upper, mark = _shares(s)
            shout += upper > 0.8 and len(s) > 12
            marks += mark > 0
            runs += bool(RUN.search(s))
    top = sorted(scores, reverse=True)[:3]
    capitals, all_marks = _shares(text)
    n, hot_ = max(1, n), max(1, hot)
    return [
        *(100 * x / n for x in total), *most, 100 * sum(x for x in scores if x > 0) / n, top[0], top[1], top[2], sum(x > 3 for x in scores) / max(1, len(pieces)), at_lexicon, most_contrast, *best[1:3],
        strongest, third, most_mean, best[3], purest, best[4],
        near, 100 * second / n, 100 * calm_all / n, capitals, shout / hot_, 100 * all_marks, marks / hot_, 100 * odd / n, runs / hot_, math.log1p(n),
    ]


def featurize(docs: DataFrame, id_col: str, text_col: str, weights: dict[str, tuple[float, ...]], keep: list[str] | None = None, fold_col: str | None = None) -> DataFrame:
    """(id_col, *keep, x) with x the array of FEATURES of each whole text, by the lexicon without the fold of ``fold_col``, where that isn't null."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    keep = keep or []
    src = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"), F.coalesce(F.col(fold_col) if fold_col else F.lit(None), F.lit(FOLDS)).cast("int").alias("__fold"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicons: dict[int, Lexicon] = {}
        for pdf in batches:
            for f in set(pdf["__fold"]) - lexicons.keys():
                lexicons[f] = Lexicon(shared.value, f)
            yield pdf.drop(columns=["__text", "__fold"]).assign(x=[features_of(t, lexicons[f]) for t, f in zip(pdf["__text"], pdf["__fold"])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("__text", "__fold").schema.fields) + ", x array<double>"
    return spread(src).mapInPandas(run, schema)


def agreed_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) with label the share of annotators that said anything but none; 0.5 says nothing and is left out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col("label").isNotNull())
    return one.groupBy(F.col(id_col).alias("doc_id")).agg(F.avg((F.lower("label") != "none").cast("double")).alias("label")).where("label <> 0.5")


def held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """(doc_id, y, score) of the labelled documents, each scored by a lexicon, trees and a calibration fitted without its fold."""
    return _fitted(docs, labels, id_col, text_col, source_col, seed)["held_out"]


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """(doc_id, source, score): the calibrated probability that a text is abusive, hateful or sexually explicit.

    ``labels`` has (doc_id, label). Null and blank texts score 0. Repeated ids are each scored. With fewer than
    LEAST_LABELLED labelled documents of either kind the densities of the fixed lexicons alone decide. At most
    MAX_LABELLED labelled documents are fitted on; word counts cover every document."""
    return _fitted(docs, labels, id_col, text_col, source_col, seed)["scores"]


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, DataFrame]:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    known = agreed_labels(labels).orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED)
    # One text is in one fold, under whatever ids it comes.
    both = base.join(F.broadcast(known), "doc_id", "left").withColumn("fold", F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(FOLDS)).cast("int")))
    n = {bool(r["p"]): r["n"] for r in both.where("label is not null and text is not null").groupBy((F.col("label") > 0.5).alias("p")).agg(F.count("*").alias("n")).collect()}
    blank = ~F.coalesce(F.col("x")[FEATURES.index("length")] > 0, F.lit(False))
    if min(n.get(True, 0), n.get(False, 0)) < LEAST_LABELLED:
        x = {f: F.col("x")[i] for i, f in enumerate(FEATURES)}
        z = 1.2 * (x["most_insult"] + x["most_sexual"]) + 0.8 * x["most_hate"] + 0.5 * x["most_threat"] + 2.0 * x["near_second"] - 2.0
        rated = featurize(base, "doc_id", "text", {}, ["source"])
        return {"scores": rated.select("doc_id", "source", F.when(blank, 0.0).otherwise(1 / (1 + F.exp(-z))).alias("score"))}
    weights, richer = learned_lexicon(both.select("text", "label", "fold"))
    # Labelled documents are fitted on by what the lexicon says without their folds, and scored like all others.
    unseen_x = featurize(both.where("label is not null"), "doc_id", "text", weights, ["label", "fold"], "fold").where(~blank)
    rate = n[True] / (n[True] + n[False])
    train = unseen_x.select("doc_id", "fold", (F.col("label") > 0.5).cast("double").alias("y"), array_to_vector("x").alias("features"))
    train = train.withColumn("w", F.when(F.col("y") > 0.5, 0.5 / rate).otherwise(0.5 / (1 - rate)))
    train = cut(train.repartition(max(1, (n[True] + n[False]) // 20_000), "doc_id").sortWithinPartitions("doc_id", "y"))
    gbt = GBTClassifier(featuresCol="features", labelCol="y", weightCol="w", maxIter=24, maxDepth=3, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=3, seed=seed)
    margin = lambda df: df.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("prediction", "probability", "rawPrediction")
    # Each labelled document is calibrated on by the trees that haven't seen it.
    parts = [margin(gbt.fit(train.where(F.col("fold") != k)).transform(train.where(F.col("fold") == k))).select("doc_id", "fold", "y", "margin", F.lit(1.0).alias("one")) for k in range(FOLDS)]
    unseen = parts[0]
    for part in parts[1:]:
        unseen = unseen.unionByName(part)
    unseen = cut(unseen)
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="y", weightCol="one")
    # The labelled sample is richer in positives than the corpus. The odds are lessened by the root of how much richer: scores
    # out of the fold are of a lexicon and trees that know less than the last ones, and wrong labels lower them besides.
    likely = F.col("prediction") / (F.col("prediction") + (1 - F.col("prediction")) * math.sqrt(richer))
    # The margin orders what the calibration ties.
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * likely + 0.001 / (1 + F.exp(-2 * F.col("margin")))))

    def without_fold(k: int) -> DataFrame:
        return isotonic.fit(unseen.where(F.col("fold") != k)).transform(unseen.where(F.col("fold") == k)).select("doc_id", "y", score.alias("score"))

    calibrated, fitted = isotonic.fit(unseen), gbt.fit(train)
    rated = featurize(base, "doc_id", "text", weights, ["source"])
    final = calibrated.transform(margin(fitted.transform(rated.withColumn("features", array_to_vector("x")))))
    scores = final.select("doc_id", "source", F.when(blank, 0.0).otherwise(score).alias("score"))
    return {"scores": scores, "held_out": functools.reduce(DataFrame.unionByName, [without_fold(k) for k in range(FOLDS)])}


def rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) per source; documents without a source are one group."""
    per = scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum((F.col("score") >= threshold).cast("long")).alias("flagged"), F.avg("score").alias("mean_score"))
    return per.select("source", "documents", "flagged", F.round(F.col("flagged") / F.col("documents"), 6).alias("rate"), F.round("mean_score", 6).alias("mean_score"))
