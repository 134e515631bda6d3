"""Variant spellings of the names of persons and organisations.

A name is parsed into its distinctive core (a surname, or what is left of an organisation's name without legal form and
line of business), its other parts (given names, or the line of business), and what it leaves open. Deletion
neighbourhoods of the cores bring all near spellings together, so that none within the allowed typing errors is missed;
candidates are verified by Monge-Elkan similarity of their words; star clustering makes classes of spellings that say
the same; less specific spellings then join the one class that they fit, and aliases join classes of different names.

All of this works on distinct parsed names, so that copies cost nothing. No bucket is expanded into all pairs of rows:
core pairs come from equi-joins on deletion keys, name pairs from equi-joins on a core pair and a letter of a given name.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import edits, plain
from orrery.operators.split_values import split_packed
from orrery.session import cut, sort_join, spread

# Titles, suffixes, particles, legal forms, filler words, lines of business, short forms of given names.
TITLES = set("mr mrs ms miss dr prof professor hon sir dame rev lady lord".split())
GENERATIONS = set("jr sr ii iii iv".split())
DEGREES = set("phd md esq dds cpa mba obe ma ba".split())
PARTICLES = set("van von de der den del della di da dos du la le ter ten bin ibn al el".split())
LEGAL = {
    "inc": "inc", "incorporated": "inc", "llc": "llc", "limited liability company": "llc", "ltd": "ltd", "limited": "ltd", "corp": "corp", "corporation": "corp",
    "co": "co", "company": "co", "plc": "plc", "public limited company": "plc", "gmbh": "gmbh", "gesellschaft mbh": "gmbh", "bv": "bv", "nv": "nv",
    "sa": "sa", "sociedad anonima": "sa", "as": "as", "a s": "as", "aktieselskab": "as", "ag": "ag", "kg": "kg", "oy": "oy", "ab": "ab", "spa": "spa", "srl": "srl", "llp": "llp", "lp": "lp",
}
FORMS = sorted(LEGAL, key=len, reverse=True)
FILLER = set("the and of group house holding holdings".split())
BUSINESS = (
    "investments mining chemicals foods construction logistics trading engineering manufacturing shipping textiles timber aviation telecom telecommunications "
    "energy metals pharma pharmaceuticals capital insurance fisheries industries transport media retail finance bank steel oil gas power software consulting"
).split()
BUSINESS_PAIRS = {"marine services": "marine", "property management": "property", "international trade": "international"}
SAME_BUSINESS = {"telecommunications": "telecom", "pharmaceuticals": "pharma"}
SHORT_BUSINESS = {
    "mfg": "manufacturing", "mfrg": "manufacturing", "trdg": "trading", "shpg": "shipping", "lgstcs": "logistics", "engrg": "engineering", "eng": "engineering", "insce": "insurance", "ins": "insurance",
    "invs": "investments", "inds": "industries", "ind": "industries", "cap": "capital", "intl": "international", "int": "international", "mgmt": "management", "mgt": "management", "svcs": "services", "prop": "property", "mar": "marine",
}
NICKNAMES = {
    "alexander": "alex sasha sandy lex", "alexandra": "sandra", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "beatrice": "bea trixie", "catherine": "cathy", "cecilia": "celia",
    "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "deborah": "debbie deb", "diana": "di", "dorothy": "dot dottie dolly", "edward": "ed eddie ned",
    "eleanor": "nell ellie nora", "elizabeth": "liz beth betty eliza lizzie", "emil": "milo", "florence": "flo", "frances": "fran frankie", "francis": "frank", "frederick": "fred freddy", "georg": "schorsch", "gertrude": "trudy gert",
    "gregory": "greg", "harold": "harry hal", "helena": "lena", "henry": "hank", "isabella": "bella izzy", "james": "jim jimmy", "jennifer": "jen jenny", "johanna": "hanna jo", "john": "jack johnny", "joseph": "joe joey",
    "josephine": "josie", "katherine": "kate kathy katie catherine kit", "lawrence": "larry", "leonard": "leo len lenny", "lukas": "luke", "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mike mick",
    "nicholas": "nick", "patricia": "pat trish patty", "rebecca": "becky", "richard": "rick dick rich", "robert": "bob bobby rob", "roland": "roly", "samuel": "sam", "stephen": "steve", "susan": "sue susie",
    "theodore": "theo ted", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky vic tori", "viktor": "vic", "vincent": "vince vinny", "walter": "walt wally", "william": "bill will billy liam",
}
PLACEHOLDERS = {"", "-", "--", "n/a", "na", "n.a.", "none", "null", "unknown", "tbc", "tbd", "xxx", "?", "various", "nil", "not known", "none given", "see remarks", "[]", "{}"}

FORMAL: dict[str, set[str]] = {}
for _f, _n in NICKNAMES.items():
    for _x in _n.split():
        FORMAL.setdefault(_x, set()).add(_f)

#: Cores from this length on are compared by their halves, so that the keys of a core grow with its length and not its square.
LONG = 18


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` MinHash values with which cores of this similarity meet with this probability at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


@functools.lru_cache(100_000)
def business(word: str, dotted: bool) -> str | None:
    """The line of business a word means, also shortened or mistyped."""
    if word in SAME_BUSINESS or word in BUSINESS:
        return SAME_BUSINESS.get(word, word)
    if word in SHORT_BUSINESS:
        return SHORT_BUSINESS[word]
    letters = set(word)
    for b in (*BUSINESS, "marine", "services", "property", "management", "international", "trade"):
        if word == b or (dotted and 3 <= len(word) < len(b) and b.startswith(word)) or (4 <= len(word) < len(b) and b.startswith(word)):
            return SAME_BUSINESS.get(b, b)
        most = 1 if len(b) < 7 else 2
        if len(word) >= 4 and abs(len(word) - len(b)) <= most and len(letters ^ set(b)) <= 2 * most and edits(word, b, most) <= most:
            return SAME_BUSINESS.get(b, b)
    return None


def parse_org(name: str) -> tuple[str, list[str], str]:
    """(core, lines of business, legal form) of an organisation's name."""
    t = plain(re.sub(r"\([^)]*\)", " ", name)).replace("'", "")
    t = re.sub(r"[&+]", " and ", t)
    t = re.sub(r"(?:\b[a-z]\.)+[a-z]\b\.?|(?:\b[a-z]\.){2,}", lambda m: m[0].replace(".", ""), t)
    t = re.sub(r"\ba/s\b", "as", t)
    ws = re.findall(r"[^\W_]+\.?", t)
    legal = ""
    text = " ".join(w.rstrip(".") for w in ws)
    for form in FORMS:
        if text.endswith(f" {form}"):
            legal, ws = LEGAL[form], ws[: len(ws) - len(form.split())]
            break
    if legal == "co" and ws[:1] == ["the"]:
        legal = ""  # The ... Co. is a manner of speaking
    core, lines = [], []
    for w in ws:
        bare = w.rstrip(".")
        if bare in FILLER:
            continue
        if bare in ("company", "co") and len(ws) > 1:
            continue
        if got := business(bare, w.endswith(".")):
            lines.append(got)
        else:
            core.append(bare)
    lines = sorted({x for x in lines if x not in ("services", "management", "trade")} or set(lines))
    if not core and lines:
        core, lines = lines, []
    return "".join(core), lines, legal


def parse_person(name: str) -> tuple[str, list[str], str, str]:
    """(core, given names, generation, other core) of a person's name; a given name may be one letter."""
    t = re.sub(r"[\"“”„][^\"“”„]*[\"“”„]|\([^)]*\)", " ", name)
    t = re.sub(r"(?<=[a-zà-ÿ]{3})(?=[A-ZÀ-Þ])", " ", t.replace("_", " "))
    generation, parts = "", []
    for part in t.split(","):
        ws = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+)*", part)
        kept = []
        for w in ws:
            p = plain(w)
            if p in GENERATIONS and (parts or kept):
                generation = p
            elif not (p in TITLES and not kept) and not (p in DEGREES and (parts or kept)):
                kept.append(w)
        if kept:
            parts.append(kept)
    if not parts:
        return "", [], "", ""
    if len(parts) > 1:
        surname, given = parts[0], [w for p in parts[1:] for w in p]
    else:
        ws = parts[0]
        caps = [len(w) > 1 and w.isupper() for w in ws]
        if len(ws) > 1 and caps[0] and not all(c for w, c in zip(ws, caps) if len(w) > 1):
            k = 1
            while k < len(ws) - 1 and caps[k]:
                k += 1
            surname, given = ws[:k], ws[k:]
        else:
            k = len(ws) - 1
            while k > 1 and plain(ws[k - 1]) in PARTICLES:
                k -= 1
            surname, given = ws[k:], ws[:k]
    letters = lambda w: re.sub(r"[^a-z]", "", plain(w))
    core = "".join(letters(w) for w in surname if plain(w) not in PARTICLES or len(surname) == 1)
    given = [g for w in given if plain(w) not in PARTICLES for g in ([letters(x) for x in w.split("-")])]
    given = [g for g in given if g]
    other = given[-1] + core if len(given) > 1 and len(given[-1]) > 1 else ""
    return core, given, generation, other


def parse_name(name: str | None, kind: str | None) -> tuple[str, str, list[str], str, str] | None:
    """(kind, core, parts, mark, other core); None for a blank or a placeholder. A kind other than O and P is read off the name."""
    if name is None or name.strip().lower() in PLACEHOLDERS or not any(c.isalpha() for c in name):
        return None
    if kind not in ("O", "P"):
        _, lines, legal = parse_org(name)
        kind = "O" if legal or lines else "P"
    if kind == "O":
        core, lines, legal = parse_org(name)
        return ("O", core, lines, legal, "") if core else None
    core, given, generation, other = parse_person(name)
    return ("P", core, given, generation, other) if core else None


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, name, kind in zip(pdf["row_id"], pdf["name"], pdf["kind"]):
            if got := parse_name(name, kind):
                out.append((i, *got[:2], " ".join(got[2]), *got[3:], name))
        yield pd.DataFrame(out, columns=["row_id", "kind", "core", "parts", "mark", "other", "name"])


def parsed(rows: DataFrame) -> DataFrame:
    """rows(row_id, name, kind) with their parsed names and nid, the id of the distinct parsed name."""
    p = spread(rows.select("row_id", "name", "kind")).mapInPandas(_parse, "row_id long, kind string, core string, parts string, mark string, other string, name string")
    return p.withColumn("nid", F.xxhash64("kind", "core", "parts", "mark", "other"))


# Candidates


_BASE, _ODD, _ALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 2**64
_BACK = np.uint64(pow(_BASE, -1, _ALL))
_BACK2 = np.uint64(pow(_BASE, -2, _ALL))


def _sums(cores: list[str], n: int) -> np.ndarray:
    """For cores of n letters, the hash of each of their beginnings: the sum of a number for the letter times a power for its place."""
    v = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, n).astype(np.uint64)
    v = (v + np.uint64(1)) * np.uint64(_ODD)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(_BASE)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, dtype=np.uint64)]))
    return np.concatenate([np.zeros((len(v), 1), dtype=np.uint64), np.cumsum(v * power, axis=1, dtype=np.uint64)], axis=1)


def _once(p: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the first n letters without one of them."""
    return p[:, :n] + (p[:, n : n + 1] - p[:, 1 : n + 1]) * _BACK


def _twice(p: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the first n letters without two of them."""
    i, j = np.triu_indices(n, 1)
    return p[:, i] + (p[:, j] - p[:, i + 1]) * _BACK + (p[:, n : n + 1] - p[:, j + 1]) * _BACK2


def deletion_keys(cores: list[str], kind: str, n: int) -> np.ndarray:
    """A row of keys for each core of n letters; any two cores of a kind within allowed() have one in common.

    Each typing error is undone by deleting at most one letter on either side. So one error leaves a common string after
    one deletion, two errors after two. Of two errors in a long core, one half has at most one, where a swap over the
    middle counts as a change on both sides; the halves are those of the shorter core, from either end."""
    salt = lambda *x: np.uint64(xxhash.xxh64_intdigest("|".join(map(str, (kind, *x)))))
    p, out = _sums(cores, n), []
    if 4 <= n <= 8:  # one error: the shorter has 4 to 7 letters
        out += [np.concatenate([p[:, n:], _once(p, n)], axis=1) + salt(1)]
    if 8 <= n < LONG + 2:  # two errors: the shorter has 8 letters to LONG - 1
        out += [np.concatenate([p[:, n:], _once(p, n), _twice(p, n)], axis=1) + salt(2)]
    if n >= LONG:
        for side, q in enumerate((p, _sums([c[::-1] for c in cores], n))):
            for m in range(max(LONG, n - 2), n + 1):  # letters of the shorter
                h = m // 2 if side == 0 else m - m // 2
                out += [np.concatenate([q[:, h - 1 : h + 1] if m == n else q[:, h - 1 : h], _once(q, h), _once(q, min(h + 1, n))], axis=1) + salt(3, side, m)]
    return np.concatenate(out, axis=1) if out else np.empty((len(cores), 0), dtype=np.uint64)


def _deletions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(cid, h) from (cid, kind, core): a row for each key of a core."""
    for pdf in batches:
        for (kind, n), of in pdf.groupby(["kind", pdf["core"].str.len()]):
            for at in range(0, len(of), step := max(1, 200_000 // (n * n) if n < LONG + 2 else 200_000 // n)):
                part = of.iloc[at : at + step]
                keys = np.sort(deletion_keys(part["core"].tolist(), kind, n), axis=1)
                new = np.ones(keys.shape, dtype=bool)
                new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                yield pd.DataFrame({"cid": part["cid"].to_numpy()[np.nonzero(new)[0]], "h": keys[new].view(np.int64)})


def allowed(a: int, b: int) -> int:
    """Typing errors between two cores of these lengths."""
    n = min(a, b)
    return 0 if n < 4 else 1 if n < 8 else 2


def _near_cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = [edits(a, b, allowed(len(a), len(b))) <= allowed(len(a), len(b)) for a, b in zip(pdf["a"], pdf["b"])]
        yield pdf.loc[keep, ["c1", "c2"]]


def core_pairs(cores: DataFrame) -> DataFrame:
    """(c1, c2) of distinct cores(cid, kind, core) that are near spellings, both ways round."""
    # Below four letters no typing error is allowed.
    keys = spread(cores.select("cid", "kind", "core").where("length(core) >= 4")).mapInPandas(_deletions, "cid long, h long")
    a, b = (keys.select(F.col("cid").alias(f"c{k}"), "h") for k in (1, 2))
    met = sort_join(a, b, "h").where("c1 < c2").select("c1", "c2").distinct()
    of = lambda c, x: cores.select(F.col("cid").alias(c), F.col("core").alias(x), F.col("kind").alias(f"k{x}"))
    named = sort_join(sort_join(met, of("c1", "a"), "c1"), of("c2", "b"), "c2").where("ka = kb and abs(length(a) - length(b)) <= 2").select("c1", "c2", "a", "b")
    near = named.mapInPandas(_near_cores, "c1 long, c2 long")
    return near.unionByName(near.select(F.col("c2").alias("c1"), F.col("c1").alias("c2")))


# Verification


def _given(a: str, b: str) -> float:
    """How far two given names are the same: 1 full, below that typed wrongly, 0.9 an initial, 0 not."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] else 0.0
    fa, fb = FORMAL.get(a, set()) | {a}, FORMAL.get(b, set()) | {b}
    if fa & fb:
        return 0.95
    most = 1 if min(len(a), len(b)) < 8 else 2
    best = min((edits(x, y, most) for x in fa for y in fb if min(len(x), len(y)) > 2), default=most + 1)
    return 1 - best / max(len(a), len(b)) if best <= most else 0.0


def word_likeness(x: str, y: str) -> float:
    """How alike two words of names are: 0.9 for an initial, 0.95 for a short form, else by their typing errors."""
    if x == y:
        return 1.0
    if min(len(x), len(y)) == 1:
        return 0.9 if x[:1] == y[:1] else 0.0
    if (FORMAL.get(x, set()) | {x}) & (FORMAL.get(y, set()) | {y}):
        return 0.95
    return 1 - edits(x, y, 3) / max(len(x), len(y))


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The mean over the words of the side with fewer (of both, if they have as many) of each one's best likeness on the other."""
    if not a or not b:
        return 0.0
    side = lambda p, q: sum(max(word_likeness(x, y) for y in q) for x in p) / len(p)
    return (side(a, b) + side(b, a)) / 2 if len(a) == len(b) else side(min(a, b, key=len), max(a, b, key=len))


def specific(kind: str, given: list[str]) -> int:
    """How much a name says: a full first name counts most, then a full middle name, then initials."""
    if kind == "O":
        return 20
    if not given:
        return -1
    middle = given[1:]
    return 10 * (len(given[0]) > 1) + (0 if not middle else 3 if len(middle[0]) > 1 else 1)


def relation(kind: str, a: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[int, float]:
    """(what, likeness) of (core, parts, mark) a and b: 2 the same, 1 one fits the other but says less, 0 not the same."""
    (ca, pa_, ma), (cb, pb_, mb) = a, b
    ga, gb = pa_.split(), pb_.split()
    if ma and mb and ma != mb:
        return 0, 0.0
    if kind == "O":
        if ga != gb:
            return 0, 0.0
        return 2, monge_elkan([*ga, ca], [*gb, cb])
    if not ga or not gb:
        return 0, 0.0
    pairs = list(zip(ga, gb))
    fits = [_given(x, y) for x, y in pairs]
    if not all(fits):
        swapped = [_given(ga[0], gb[1]), _given(ga[1], gb[0])] if len(ga) > 1 and len(gb) > 1 and min(map(len, ga[:2] + gb[:2])) > 1 else [0.0]
        if not all(swapped):
            return 0, 0.0
        fits = swapped
    # At most so many typing errors in all, so that near relatives stay apart.
    if sum(0 < f < 0.9 for f in fits) + (ca != cb) > 2:
        return 0, 0.0
    return 2 if specific(kind, ga) == specific(kind, gb) else 1, monge_elkan([*ga, ca], [*gb, cb])


#: The least Monge-Elkan likeness of two names.
LIKENESS = 0.8


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for n1, n2, kind, c1, p1, m1, c2, p2, m2 in zip(*(pdf[c] for c in ("n1", "n2", "kind", "ca", "pa", "ma", "cb", "pb", "mb"))):
            what, like = relation(kind, (c1, p1, m1), (c2, p2, m2))
            if what and like >= LIKENESS:
                s1, s2 = specific(kind, p1.split()), specific(kind, p2.split())
                out.append((n1, n2, what, like, s1, s2))
        yield pd.DataFrame(out, columns=["n1", "n2", "what", "like", "s1", "s2"])


def _keys(kind: Column, parts: Column) -> Column:
    """What two names have to share besides near cores: a letter or an ending of given names, or the line of business."""
    given = F.filter(F.split(parts, " "), lambda g: g != "")
    first = F.element_at(given, 1)
    letters = F.transform(given, lambda g: F.substring(g, 1, 1))
    full = F.array_union(letters, F.when(F.length(first) > 2, F.array(F.concat(F.lit("~"), F.substring(first, -2, 2)))).otherwise(F.array().cast("array<string>")))
    # Short forms may begin with another letter.
    names = F.create_map(*[x for k, v in FORMAL.items() for x in (F.lit(k), F.lit(" ".join(sorted({f[0] for f in v}))))])
    nick = F.coalesce(F.split(F.try_element_at(names, first), " "), F.array().cast("array<string>"))
    return F.when(kind == "O", F.array(parts)).otherwise(F.when(F.size(given) > 0, F.array_union(full, nick)).otherwise(F.array().cast("array<string>")))


def name_edges(nodes: DataFrame) -> DataFrame:
    """(n1, n2, what, like, s1, s2) for near spellings among distinct nodes(nid, kind, core, parts, mark, other), n1 < n2."""
    n = nodes.withColumn("cid", F.xxhash64("kind", "core"))
    cores = cut(n.select("cid", "kind", "core").distinct())
    pairs = core_pairs(cores)
    # A surname of two words may have lost its hyphen.
    joined = sort_join(n.where("other <> ''").select(F.col("cid").alias("c1"), F.xxhash64("kind", "other").alias("c2")), cores.select(F.col("cid").alias("c2")), "c2", "left_semi").distinct()
    keyed = n.select("nid", "cid", "kind", "core", "parts", "mark", F.explode(_keys(F.col("kind"), F.col("parts"))).alias("key"))
    left = keyed.select(F.col("cid").alias("c1"), "key", F.col("nid").alias("n1"), "kind", F.col("core").alias("ca"), F.col("parts").alias("pa"), F.col("mark").alias("ma"))
    right = keyed.select(F.col("cid").alias("c2"), "key", F.col("nid").alias("n2"), F.col("core").alias("cb"), F.col("parts").alias("pb"), F.col("mark").alias("mb"))
    across = sort_join(sort_join(left, cut(pairs), "c1"), right, ["c2", "key"])
    within = sort_join(left, right.withColumnRenamed("c2", "c1"), ["c1", "key"])
    cols = ["n1", "n2", "kind", "ca", "pa", "ma", "cb", "pb", "mb"]
    met = across.select(cols).unionByName(within.select(cols)).where("n1 < n2").dropDuplicates(["n1", "n2"])
    # The longer reading of the other side is taken for the comparison.
    lost = n.where("other <> ''").select(F.xxhash64("kind", "other").alias("c2"), F.col("nid").alias("n1"), "kind", F.col("other").alias("ca"), F.regexp_replace("parts", " [^ ]+$", "").alias("pa"), F.col("mark").alias("ma"))
    lost = sort_join(lost, joined.select("c2").distinct(), "c2")
    whole = n.select(F.col("cid").alias("c2"), F.col("nid").alias("n2"), F.col("core").alias("cb"), F.col("parts").alias("pb"), F.col("mark").alias("mb"))
    first = lambda c: F.substring(c, 1, 1)
    hyphen = sort_join(lost, whole, "c2").where(first("pa") == first("pb")).select(cols)
    return spread(met.unionByName(hyphen)).mapInPandas(_verify, "n1 long, n2 long, what int, like double, s1 int, s2 int")


# Clusters


def star_clusters(edges: DataFrame) -> DataFrame:
    """(node, center) for edges(n1, n2, like): stars round the nodes of most edges, until every node has its star.

    A node is a centre if none of its neighbours that is still free has more edges (ties go to the smaller id); its free
    neighbours become its satellites, each of the centre with most edges."""
    e = cut(edges.select("n1", "n2").unionByName(edges.select(F.col("n2").alias("n1"), F.col("n1").alias("n2"))).distinct())
    rank = cut(e.groupBy("n1").agg(F.count("*").alias("deg")).select(F.col("n1").alias("node"), F.struct("deg", (-F.col("n1")).alias("low")).alias("rank")))
    free, done = rank, None
    while True:
        live = sort_join(sort_join(e, free.select(F.col("node").alias("n1")), "n1"), free.select(F.col("node").alias("n2"), F.col("rank").alias("r2")), "n2")
        top = live.groupBy("n1").agg(F.max("r2").alias("best")).withColumnRenamed("n1", "node")
        centers = cut(sort_join(free, top, "node", "left").where(F.col("best").isNull() | (F.col("rank") > F.col("best"))).select("node", "rank"))
        took = sort_join(live, centers.select(F.col("node").alias("n2"), F.lit(True).alias("is_center")), "n2").groupBy(F.col("n1").alias("node")).agg(F.max_by("n2", "r2").alias("center"))
        new = cut(centers.select("node", F.col("node").alias("center")).unionByName(took))
        done = new if done is None else done.unionByName(new)
        free = cut(sort_join(free, new.select("node"), "node", "left_anti"))
        if free.limit(1).count() == 0:
            return done


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges(a, b): the smallest id that is reached, by label spreading with shortcuts."""
    e = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = cut(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        spread_ = sort_join(e, label.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        near = sort_join(label, spread_, "node").select("node", F.least("label", "m").alias("label"))
        far = sort_join(near, near.select(F.col("node").alias("label"), F.col("label").alias("l2")), "label", "left").select("node", F.least("label", F.coalesce("l2", "label")).alias("label"))
        new = cut(far)
        changed = sort_join(new, label.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        label = new
        if not changed:
            return label


def _attached(cluster: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """cluster(node, center) after the clusters holding names of this level joined the one more specific cluster they fit."""
    low = edges.where(F.col("what") == 1).select(
        F.when(F.col("s1") < F.col("s2"), F.col("n1")).otherwise(F.col("n2")).alias("node"),
        F.when(F.col("s1") < F.col("s2"), F.col("n2")).otherwise(F.col("n1")).alias("to"),
        F.least("s1", "s2").alias("s"),
    ).where(F.col("s") == level)
    at = sort_join(sort_join(low, cluster, "node"), cluster.select(F.col("node").alias("to"), F.col("center").alias("target")), "to").where("center <> target")
    one = at.groupBy("center").agg(F.min("target").alias("t1"), F.max("target").alias("t2")).where("t1 = t2").select("center", F.col("t1").alias("target"))
    return cut(sort_join(cluster, one, "center", "left").select("node", F.coalesce("target", "center").alias("center")))


def _different(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Aliases (row_id, name, alias, kind) that say a quite different name."""
    for pdf in batches:
        keep = []
        for name, alias, kind in zip(pdf["name"], pdf["alias"], pdf["kind"]):
            a, b = parse_name(name, kind), parse_name(alias, kind)
            most = allowed(len(a[1]), len(b[1])) + 1 if a and b else 0
            near = bool(a and b) and any(x and y and edits(x, y, most) <= most for x in (a[1], a[4]) for y in (b[1], b[4]))
            keep.append(bool(a and b) and not near)
        yield pdf.loc[keep, ["row_id", "alias", "kind"]]


def different_aliases(entities: DataFrame, id_col: str, name_col: str, kind_col: str, aliases_col: str) -> DataFrame:
    """(row_id, alias, kind) for each alias of a row that isn't a spelling of its name."""
    items = split_packed(entities, id_col, aliases_col)
    rows = entities.select(F.col(id_col).alias("row_id"), F.col(name_col).alias("name"), F.col(kind_col).alias("kind")).where("name is not null")
    return sort_join(items, rows, "row_id").select("row_id", "name", F.col("item").alias("alias"), "kind").mapInPandas(_different, "row_id long, alias string, kind string")


def link_names(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(row_id, class_id): rows(row_id, name, kind) whose names mean one person or organisation share a class.

    ``kind`` is O for an organisation and P for a person; anything else (also null) is read off the name. ``aliases`` (row_id, alias, kind) says
    which quite different names a row also goes by. Rows whose name is null, blank or a placeholder have no class;
    repeated rows share theirs; names of any length are parsed whole. Names that say less (no middle name, initials)
    join a fuller one only if they fit just one. Extra columns of the inputs are ignored."""
    p = parsed(rows)
    if aliases is not None:
        other = parsed(aliases.select("row_id", F.col("alias").alias("name"), "kind"))
        every = cut(p.withColumn("own", F.lit(True)).unionByName(other.withColumn("own", F.lit(False))).select("row_id", "nid", "kind", "core", "parts", "mark", "other", "own"))
    else:
        every = cut(p.withColumn("own", F.lit(True)).select("row_id", "nid", "kind", "core", "parts", "mark", "other", "own"))
    nodes = cut(every.select("nid", "kind", "core", "parts", "mark", "other").distinct())
    edges = cut(name_edges(nodes))
    stars = star_clusters(edges.where(F.col("what") == 2)) if edges.where(F.col("what") == 2).limit(1).count() else None
    alone = nodes.select(F.col("nid").alias("node"))
    if stars is None:
        cluster = alone.withColumn("center", F.col("node"))
    else:
        cluster = cut(sort_join(alone, stars, "node", "left").select("node", F.coalesce("center", "node").alias("center")))
    for level in (11, 10, 3, 1, 0):
        cluster = _attached(cluster, edges, level)
    if aliases is not None:
        of = sort_join(every, cluster.select(F.col("node").alias("nid"), "center"), "nid")
        own = of.where("own").select("row_id", F.col("center").alias("a")).distinct()
        links = sort_join(own, of.where("not own").select("row_id", F.col("center").alias("b")).distinct(), "row_id").select("a", "b").distinct()
        label = components(links)
        cluster = cut(sort_join(cluster, label.select(F.col("node").alias("center"), "label"), "center", "left").select("node", F.coalesce("label", "center").alias("center")))
    return sort_join(every.where("own"), cluster.select(F.col("node").alias("nid"), F.col("center").alias("class_id")), "nid").select("row_id", "class_id").distinct()


def class_pairs(classes: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id_1, id_2) of rows in one class, the smaller id first."""
    a, b = classes.select("class_id", F.col(id_col).alias("id_1")), classes.select("class_id", F.col(id_col).alias("id_2"))
    return sort_join(a, b, "class_id").where("id_1 < id_2").select("id_1", "id_2")
