"""Postal addresses that are written differently.

Each address is parsed into house number, street, kind of street, direction, ordinal, town, postal code and country.
Candidates come from a set-containment join: every distinct address is indexed, with its house number, by its rarest
token (document frequencies over all addresses) and probed from the tokens of fuller ones. As a rarest token may be typed
wrongly, it is indexed by its street within its town or postal code too, and probed by near spellings of streets, which
are exact. Candidates are verified by weighted containment of the tokens of the one that says less in the other, and by
the lack of parts that contradict. What can't be parsed is joined by its words in the same way.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.canonical import DECORATION, MAX_REFERENCE, Matcher
from orrery.llm.names import allowed, components, core_pairs
from orrery.llm.text import Remembered, edits, plain, words
from orrery.session import cut, sort_join, spread

# Kinds of street, directions, ordinals and units as they are written.
STREET_KINDS = {
    "street": "street str st", "avenue": "avenue ave av aven", "boulevard": "boulevard blvd bvd boul bd", "terrace": "terrace terr ter", "drive": "drive dr drv", "place": "place pl plc",
    "square": "square sq sqr", "road": "road rd", "lane": "lane ln la", "court": "court ct crt", "way": "way wy", "close": "close cl", "alley": "alley aly", "parkway": "parkway pkwy", "crescent": "crescent cres",
}
KIND_OF = {w: k for k, ws in STREET_KINDS.items() for w in ws.split()}
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "n": "n", "s": "s", "e": "e", "w": "w", "no": "n", "so": "s", "nth": "n", "sth": "s"}
ORDINALS = {w: str(i) for i, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split(), 1)}
UNIT = re.compile(r"\b(?:flat|unit|suite|ste|apt|apartment|fl|floor|room|rm)\b\.?\s*#?\s*\d+[a-z]?\b|\b(?:tower|block|bldg|building)\s+[a-z0-9]{1,2}\b(?=\s*[,;\n]|\s*$)|\bc/o\b[^,;\n\d]*?(?=[,;\n]|\s-\s|\s\d|\sno\b|$)|\b[a-z]+ house\b(?=\s*[,;\n]|\s+-\s|\s+\d)")
PLACEHOLDERS = {"", "-", "--", "?", "n/a", "n.a.", "na", "none", "none given", "null", "unknown", "tbc", "tbd", "xxx", "various", "see remarks", "nil"}
POSTAL = re.compile(r"\b(?:([a-z]{2})[- ])?(?:([a-z]{1,2}\d{1,2}[a-z]?) ?(\d[a-z]{2})|(\d{3}) (\d{3})(?:-\d{4})?|(\d{2}) (\d{2,3})(?:-\d{4})?|(\d{4,6})(?:-\d{4})?)(?![\w])")
# Number of a house, also of several; words of streets.
HOUSE = re.compile(r"\d+[a-z]?(?:-\d+[a-z]?)?")
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['-]){2,}")
SEPARATORS = {",", ";", "-"}
COLUMNS = "num string, street string, kind string, dir string, ord string, town string, place long, postal string, land string"
PARTS = ["num", "street", "kind", "dir", "ord", "town", "place", "postal", "land"]
#: The least share of an address's weight that a fuller one has to hold; the same where neither could be taken apart.
LEAST_CONTAINMENT = 0.6
LEAST_LOOSE = 0.9
#: Names of regions that are carried to every task.
MAX_REGIONS = 10_000


class Parser:
    """Takes addresses apart. The canonical list, if there is one, settles towns and countries."""

    def __init__(self, places: list[tuple], regions: list[str]):
        self.cities = Matcher("city", [r[:1] + r[2:] for r in places if r[1] == "city"])
        self.lands = Matcher("country", [r[:1] + r[2:] for r in places if r[1] == "country"])
        self.town = Remembered(self._town)
        self.country = Remembered(self._country)
        self.regions = sorted({plain(r).strip() for r in regions if r and r.strip()}, key=len, reverse=True)
        self.short_regions = {r for r in self.regions if len(r) <= 3}
        self.taken = self.lands.known_codes | self.short_regions
        names = [r for r in self.regions if len(r) > 3]
        self.region_re = re.compile(r"\b(?:" + "|".join(map(re.escape, names)) + r")\b") if names else None
        lands = sorted({" ".join(words(plain(r[2]))) for r in places if r[1] == "country"}, key=len, reverse=True)
        self.land_re = re.compile(r"\b(?:" + "|".join(lands) + r")\b") if lands else None

    def _country(self, text: str) -> str | None:
        ids, _, _ = self.lands.match(text)
        return self.lands.country[ids[0]] if ids else None

    def _town(self, text: str) -> tuple[str, tuple[int, ...]]:
        ids, _, _ = self.cities.match(text)
        kept = [w for w in words(plain(text)) if w not in DECORATION["city"] and not w.isdigit()]
        return " ".join(kept), ids

    def street(self, text: str, code: str | None = None, pieced: bool = True) -> tuple[dict, str] | None:
        """The street's parts and what is left of a text in lower case without units and postal codes; None if there is none.

        Without a kind of street, a number of over three digits may be a postal code; it counts where ``code`` is one of another
        length. ``pieced`` says that separators stand between the parts of the address."""
        tokens = re.findall(r"\d+[a-z]?-\d+[a-z]?(?!\w)|[^\W_](?:[^\W_]|')*(?:-[^\W\d_]+)*|[,;]|(?<= )-(?= )", text)
        found = [x for i, t in enumerate(tokens) if t in KIND_OF and i for x in self._beside(tokens, i, pieced)]
        if found:
            _, at, a, b, end = max(found, key=lambda x: x[0])
            kind = KIND_OF[tokens[end + 1]]
            used = {at, *range(a, end + 2)}
        elif bare := self._without_kind(tokens, code):
            at, a, b, end = bare
            kind, used = "", {at, *range(a, end + 1)}
        else:
            return None
        lead = tokens[a:b]
        # A name that is an ordinal, as in Fifth Avenue, is kept as a number, in which no typing error is forgiven.
        name = "".join(f"#{self._ordinal(t)}" if self._ordinal(t) and a == b == end else re.sub(r"[\W\d_]", "", t) for t in tokens[b : end + 1])
        parts = {
            "num": re.sub(r"-.*", "", tokens[at]).lstrip("0"), "street": name, "kind": kind,
            "dir": "".join(DIRECTIONS[t] for t in lead if t in DIRECTIONS), "ord": "".join(self._ordinal(t) or "" for t in lead),
        }
        return parts, " ".join(t for k, t in enumerate(tokens) if k not in used)

    @staticmethod
    def _named(t: str) -> bool:
        return bool(WORD.fullmatch(t)) and t not in DIRECTIONS

    def _lead(self, tokens: list[str], i: int, follows: bool) -> int:
        """The first of the directions and ordinals that end before token i. No is North behind the number, or where that follows."""
        while i > 0 and (tokens[i - 1] in DIRECTIONS or self._ordinal(tokens[i - 1])) and (tokens[i - 1] != "no" or follows or (i > 1 and tokens[i - 2][0].isdigit())):
            i -= 1
        return i

    def _beside(self, tokens: list[str], i: int, pieced: bool) -> Iterator[tuple[tuple, int, int, int, int]]:
        """(score, number, start, start of the name, its end) of the streets whose kind is token i.

        The name is all words between the number and the kind; where the number follows, all from a separator to the kind,
        or the last alone if the text has no separators. St also means Saint before a town, so that a kind beside a number is preferred."""
        if not self._named(tokens[i - 1]) and not self._ordinal(tokens[i - 1]):
            return
        first = i - 1
        while first > 0 and (WORD.fullmatch(tokens[first - 1]) or len(tokens[first - 1]) == 2 and tokens[first - 1].isalpha()) and tokens[first - 1] not in ("no", "nr", "number"):
            first -= 1
        while first < i - 1 and (tokens[first] in DIRECTIONS or self._ordinal(tokens[first])):
            first += 1
        after = i + 1
        while after < len(tokens) and tokens[after] in (",", "no", "nr", "number"):
            after += 1
        start = next((k for k in range(i - 1, first, -1) if self.town(" ".join(tokens[first:k]))[1]), first) if pieced else i - 1
        for b, follows in ((first, False), (start, True)):
            a = b if self._ordinal(tokens[b]) else self._lead(tokens, b, follows)
            at = after
            if not follows:
                at = a - 1
                while at >= 0 and tokens[at] in (",", "no", "nr", "number"):
                    at -= 1
            if 0 <= at < len(tokens) and HOUSE.fullmatch(tokens[at]):
                yield (len(re.sub(r"-.*|\D", "", tokens[at])) <= 3, at in (a - 1, i + 1), not follows), at, a, b, i - 1

    def _without_kind(self, tokens: list[str], code: str | None) -> tuple[int, int, int, int] | None:
        """(number, start, start of the name, its end): a short number with the word after or before it, whichever no separator
        parts from it, then a longer one right before a word. The name goes on to a separator, if a town is left then."""
        taken = self.taken
        word = lambda k: 0 <= k < len(tokens) and bool(WORD.fullmatch(tokens[k])) and tokens[k] not in taken and not self._ordinal(tokens[k])
        long = [k for k, t in enumerate(tokens[:-1]) if code and re.fullmatch(r"\d{4,6}[a-z]?", t) and len(re.sub(r"\D", "", t)) != len(code) and tokens[k + 1][0].isalpha() and (not k or tokens[k - 1] != "box")]
        short = [k for k, t in enumerate(tokens) if re.fullmatch(r"\d{1,3}[a-z]?(?:-\d{1,3}[a-z]?)?", t)]
        # A number behind a town is a part of the town, where there is another.
        short.sort(key=lambda k: word(k - 1) and bool(self.town(tokens[k - 1])[1]))
        for at in [*short, *long]:
            a = at + 1
            while a < len(tokens) and tokens[a] == ",":
                a += 1
            b = a
            while b < len(tokens) - 1 and (tokens[b] in DIRECTIONS or self._ordinal(tokens[b])):
                b += 1
            parted = a > at + 1 or a == len(tokens) or tokens[a] in SEPARATORS
            if word(at - 1) and (not word(b) or parted):
                return at, self._lead(tokens, at - 1, True), at - 1, at - 1
            if word(b):
                end = b
                while word(end + 1) or end + 1 < len(tokens) and len(tokens[end + 1]) == 2 and tokens[end + 1].isalpha() and tokens[end + 1] not in taken:
                    end += 1
                if word(at - 1) and self.town(" ".join(tokens[b : end + 1]))[1]:
                    return at, self._lead(tokens, at - 1, True), at - 1, at - 1
                town = next((k for k in range(b + 1, end + 1) if self.town(" ".join(tokens[k : end + 1]))[1]), None)
                if town:
                    return at, a, b, town - 1
                whole = end + 1 < len(tokens) and tokens[end + 1] in SEPARATORS and any(len(t) > 2 and t[0].isalpha() for t in tokens[end + 2 :])
                return at, a, b, end if whole else b
        return None

    @staticmethod
    def _ordinal(t: str) -> str | None:
        m = re.fullmatch(r"(\d{1,3})(?:st|nd|rd|th)", t)
        return m[1] if m else ORDINALS.get(t)

    def parse(self, street: str | None, town: str | None = None, postal: str | None = None, country: str | None = None) -> dict | None:
        """The parts of an address given whole in ``street``, or in columns; None where it has no house number or street."""
        if street is None or street.strip().lower() in PLACEHOLDERS:
            return None
        t = plain(street).replace("’", "'").replace("\n", ", ")
        pieced = bool(re.search(r"[,;]|\s-\s", t.strip(" ,;-"))) or town is not None or postal is not None
        t = UNIT.sub(" ", re.sub(r"#\s*(\d+[a-z]?)\s*$", " ", re.sub(r"#\s*(\d+[a-z]?)(?=\s*[,;\n]|\s+-\s)", lambda m: m[1] if not t[: m.start()].strip() else " ", t)))
        t = re.sub(r"#\s*", " ", re.sub(r"\b(no|nr|number)\b\.?\s*(?=\d{1,4}[a-z]?(?!\w))", " ", t))
        code, land = self._postal(postal), None
        t = re.sub(r"(?<=[a-z])\.", " ", t)
        if self.region_re:
            t = self.region_re.sub(" , ", t)
        if town is None and postal is None:
            t, found = self._cut_postal(t)
            code = code or found
            land, t = self._land(t, street)
        got = self.street(t, code, pieced)
        if not got:
            return None
        parts, left = got
        if country:
            land = self.country(country) if country.strip().lower() not in PLACEHOLDERS else None
        place: tuple[int, ...] = ()
        if town is None and postal is None:
            name, place = self._best_town(left)
        elif town and town.strip().lower() not in PLACEHOLDERS:
            name, place = self.town(town)
        else:
            name = ""
        if len(place) > 1:
            place = tuple(i for i in place if self.cities.country[i] == land) or place
        return parts | {"town": name, "place": place[0] if len(place) == 1 else None, "postal": code or "", "land": land or (self.cities.country[place[0]] if len(place) == 1 else "") or ""}

    @staticmethod
    def _postal(text: str | None) -> str | None:
        if not text or text.strip().lower() in PLACEHOLDERS:
            return None
        t = re.sub(r"^[a-z]{2}-(?=\w)", "", plain(text).strip())
        t = re.sub(r"(?<=\d)-\d{4}$", "", t)
        return re.sub(r"[^a-z0-9]", "", t) or None

    def _cut_postal(self, t: str) -> tuple[str, str | None]:
        """The text without its postal code. Where several numbers look like one, that away from a street's kind counts."""
        best = None
        for m in POSTAL.finditer(t):
            body = "".join(x for x in m.groups()[1:] if x)
            after = re.match(r"[\s,]*((?:[a-z0-9]+ ){0,3})", t[m.end() :] + " ")[1].split()
            house = m[8] is not None and len(body) == 4 and any(w in KIND_OF for w in after)
            if m[8] is not None and not house and not re.search(r"(?<![\w-])\d{1,3}[a-z]?(?![\w-])", t[: m.start()] + " " + t[m.end() :]):
                # Without a shorter number, that before a kind of street is the house number, also where it is longer or a comma follows.
                house = any(w in KIND_OF for w in re.match(r"[\s,]*((?:[a-z0-9]+\b ?){0,3})", t[m.end() :])[1].split())
            score = (not house, bool(m[2]), len(body))
            if best is None or score > best[0]:
                best = (score, m, body)
        if not best or not best[0][0]:
            return t, None
        return t[: best[1].start()] + " , " + t[best[1].end() :], best[2]

    def _land(self, t: str, raw: str) -> tuple[str | None, str]:
        """The country at an end or between separators, and the text without it."""
        if self.land_re and (ms := list(self.land_re.finditer(t))):
            m = ms[-1]
            return self.country(m[0]), t[: m.start()] + " , " + t[m.end() :]
        pieces = [p for p in re.split(r"\s*[,;\n]\s*|\s+-\s+", t) if p.strip()]
        for p in (pieces[-1], pieces[0]) if pieces else ():
            bare = p.strip()
            if len(bare) >= 6 and not re.search(r"\d", bare) and (code := self.country(bare)):
                return code, t.replace(p, " , ", 1)
        ws = t.split()
        for k in (-1, -2, 0):
            for n in (1, 2):
                part = ws[k:] if k == -n else ws[:n] if k == 0 else []
                text = " ".join(part).strip(" ,;-()")
                if part and text and (len(text) in (2, 3) and text in self.lands.known_codes and text not in self.short_regions or len(text) > 6 and text.replace(" ", "").isalpha()) and (code := self.country(text)):
                    rest = ws[: k] if k < 0 else ws[n:]
                    return code, " ".join(rest)
        return None, t

    def _best_town(self, left: str) -> tuple[str, tuple[int, ...]]:
        pieces = [p.strip() for p in re.split(r"[,;\n]|(?:^| )-(?: |$)", left)]
        pieces = [" ".join(w for w in p.split() if w not in self.short_regions and not (len(w) == 2 and w in self.lands.known_codes) and not w.isdigit()) for p in pieces]
        pieces = [p for p in pieces if sum(c.isalpha() for c in p) >= 4]
        if not pieces:
            return "", ()
        for p in pieces:
            name, ids = self.town(p)
            if ids:
                return name, ids
        return self.town(max(pieces, key=len))


def loose_tokens(text: str) -> list[str]:
    """The distinct words and numbers of an address that can't be parsed, sorted, its kinds of street in full."""
    return sorted({KIND_OF.get(w, w) for w in words(plain(text))})


def parsed(rows: DataFrame, places: DataFrame | None, regions: DataFrame | None) -> DataFrame:
    """rows(row_id, street, town, postal, country, whole) with their parts, or with ``loose``, the words of one that has no
    house number and street to be found but at least a number and two words. Columns are put together for that."""
    known: list[tuple] = []
    if places is not None:
        if places.limit(MAX_REFERENCE + 1).count() > MAX_REFERENCE:
            raise ValueError(f"the canonical list has over {MAX_REFERENCE} entries")
        known = [tuple(r) for r in places.select("place_id", "kind", "place_name", "country_code", "code3", "alt_name").where("place_name is not null").collect()]
    # A region's name is one that several rows bear; of more names than the bound, those that most rows bear.
    common: list[str] = []
    if regions is not None:
        common = [r[0] for r in regions.where("trim(region) <> ''").groupBy("region").count().where("count >= 2").orderBy(F.desc("count"), "region").limit(MAX_REGIONS).select("region").collect()]
    shared = rows.sparkSession.sparkContext.broadcast((known, common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(*shared.value)
        for pdf in batches:
            out = []
            for i, s, t, p, c, whole in zip(pdf["row_id"], pdf["street"], pdf["town"], pdf["postal"], pdf["country"], pdf["whole"]):
                got = parser.parse(s) if whole else parser.parse(s, t or "", p or "", c)
                if got and got["num"] and got["street"]:
                    out.append((i, *(got[x] for x in PARTS), ""))
                elif s is not None and s.strip().lower() not in PLACEHOLDERS:
                    loose = loose_tokens(s if whole else " ".join(x for x in (s, t, p) if x))
                    if any(x[0].isdigit() for x in loose) and sum(x.isalpha() for x in loose) >= 2:
                        out.append((i, "", "", "", "", "", "", None, "", "", " ".join(loose)))
            df = pd.DataFrame(out, columns=["row_id", *PARTS, "loose"])
            df["place"] = df["place"].astype("Int64")
            yield df

    return spread(rows).mapInPandas(run, f"row_id long, {COLUMNS}, loose string")


def near(a: str, b: str) -> bool:
    """Whether two names may be one, typed wrongly; numbers may not."""
    a, b = a.replace(" ", ""), b.replace(" ", "")
    if a == b or "#" in a or "#" in b:
        return a == b
    most = allowed(len(a), len(b))
    return edits(a, b, most) <= most


def weight(df: float, total: int) -> float:
    """How much a token says that ``df`` of so many addresses have."""
    return math.log1p(total / max(1.0, df))


def containment(has: list[tuple[float, bool]]) -> float:
    """The weight of the tokens that are found in the fuller address against that of all."""
    return sum(w for w, ok in has if ok) / (sum(w for w, _ in has) or 1.0)


def compare(r) -> int:
    """2 for the same place, 1 for the same with a town missing on one side, 0 for others.

    All tokens of the address that says less are looked for in the fuller one: street, town, postal code (weighed by how
    few addresses have them), kind of street and country. Then no part may contradict."""
    towns, codes = bool(r.town1) and bool(r.town2), bool(r.postal1) and bool(r.postal2)
    has = lambda x: x is not None and x == x and x > 0
    if has(r.place1) and has(r.place2):
        town = r.place1 == r.place2
    else:
        town = towns and (near(r.town1, r.town2) or near("".join(sorted(r.town1.split())), "".join(sorted(r.town2.split()))))
    street, same_code = near(r.street1, r.street2), codes and r.postal1 == r.postal2
    less = min((1, 2), key=lambda k: (sum(bool(getattr(r, f"{x}{k}")) for x in ("street", "town", "postal", "kind", "land")), k))
    found = {"street": street, "town": town, "postal": same_code or (codes and edits(r.postal1, r.postal2, 2) <= 2), "kind": r.kind1 == r.kind2, "land": r.land1 == r.land2}
    rated = {"street": weight(getattr(r, f"df{less}"), r.total), "town": 3.0, "postal": 3.0, "kind": 1.0, "land": 1.0}
    if containment([(rated[x], ok) for x, ok in found.items() if getattr(r, f"{x}{less}")]) < LEAST_CONTAINMENT:
        return 0
    if r.num1 != r.num2 or not street or (towns and not town) or r.dir1 != r.dir2 or r.ord1 != r.ord2:
        return 0
    if (r.kind1 and r.kind2 and r.kind1 != r.kind2) or (r.land1 and r.land2 and r.land1 != r.land2):
        return 0
    if not towns and not same_code:
        return 0
    # A postal code that contradicts is forgiven where it is a typing error or all the rest is written alike.
    if codes and not found["postal"] and not (towns and r.street1 == r.street2):
        return 0
    return 2 if towns or (not r.town1 and not r.town2) else 1


def _same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a1, a2, what) from candidates with the parts of both."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if what := compare(r):
                out.append((r.a1, r.a2, what))
        yield pd.DataFrame(out, columns=["a1", "a2", "what"])


def _keys(indexed: bool) -> Column:
    """What two addresses with one number and near streets share besides, if they are to be one place: the town, if both
    are known; the postal code; or else, where at least one has a town that isn't known, nothing more."""
    part = lambda what, c: F.when(F.col(c).isNotNull(), F.concat_ws("|", F.lit(what), "num", "street", F.nullif(F.col(c).cast("string"), F.lit(""))))
    known, towned = F.col("place").isNotNull(), F.col("town") != ""
    mark = lambda what, when: F.when(when & towned, F.concat_ws("|", F.lit(what), "num", "street"))
    # t1 holds the addresses of unknown towns, t2 those of known ones.
    open_ = [mark("t1", ~known), mark("t2", known)] if indexed else [mark("t1", towned), mark("t2", ~known)]
    return F.filter(F.array(part("p", "place"), F.when(F.col("postal") != "", part("c", "postal")), *open_), lambda x: x.isNotNull())


def candidates(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a1, a2), (token, df)): the pairs that a set-containment join brings together, and how many addresses have each token.

    An address is indexed, with its house number, by its rarest token and by its street within its town or postal code,
    and found by each fuller address that holds that token, or a near spelling of the street. So that a street's name
    which every town has meets itself within a town only."""
    parts = distinct.select("aid", "num", "street", "town", "place", "postal")
    tokens = parts.select("aid", "num", F.explode(F.array_distinct(F.filter(F.concat(F.array("street", "postal"), F.split("town", " ")), lambda x: F.length(x) > 1))).alias("token"))
    frequency = cut(tokens.groupBy("token").agg(F.count("*").alias("df")))
    weighed = cut(sort_join(tokens, frequency, "token").withColumn("n", F.count("*").over(Window.partitionBy("aid"))))
    rarest = weighed.groupBy("aid", "num", "n").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    index = rarest.select(F.col("aid").alias("a1"), F.concat_ws("|", F.lit("r"), "num", "token").alias("key"), F.col("n").alias("n1"))
    probes = weighed.select(F.col("aid").alias("a2"), F.concat_ws("|", F.lit("r"), "num", "token").alias("key"), F.col("n").alias("n2"))
    fuller = sort_join(index, probes, "key").where("a1 <> a2 and n2 >= n1").select("a1", "a2")
    # Near spellings, of streets only; the rarer of two is looked for as the other, so that a common one isn't spread to all its errors.
    vocabulary = parts.where("not street like '#%'").groupBy(F.xxhash64("street").alias("cid"), F.lit("t").alias("kind"), F.col("street").alias("core")).agg(F.count("*").alias("df"))
    vocabulary = cut(vocabulary)
    name = lambda c, x: vocabulary.select(F.col("cid").alias(c), F.col("core").alias(x), F.struct("df", "cid").alias(f"by_{x}"))
    variants = sort_join(sort_join(core_pairs(vocabulary), name("c1", "street"), "c1"), name("c2", "variant"), "c2").where("by_street < by_variant").select("street", "variant")
    both = sort_join(parts, variants, "street").select("aid", "num", F.col("variant").alias("street"), "town", "place", "postal").unionByName(parts)
    streets = sort_join(parts.select(F.col("aid").alias("a1"), F.explode(_keys(True)).alias("key")), both.select(F.col("aid").alias("a2"), F.explode(_keys(False)).alias("key")), "key").where("a1 <> a2").select("a1", "a2")
    met = fuller.unionByName(streets).select(F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2")).distinct()
    return met, frequency


def _loose_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a1, a2) where the words of the one that says less are in the fuller by their weight, and all numbers agree."""
    for pdf in batches:
        out = []
        for a1, t1, w1, a2, t2, w2, total in zip(*(pdf[c] for c in ("a1", "t1", "w1", "a2", "t2", "w2", "total"))):
            one, two = dict(zip(t1, w1)), dict(zip(t2, w2))
            less, more = (one, two) if len(one) <= len(two) else (two, one)
            numbers = {x for x in less if any(c.isdigit() for c in x)}
            if numbers and numbers <= more.keys() and containment([(weight(d, total), x in more) for x, d in less.items()]) >= LEAST_LOOSE:
                out.append((a1, a2))
        yield pd.DataFrame(out, columns=["a1", "a2"])


def loose_edges(every: DataFrame, total: int) -> DataFrame:
    """(a1, a2): addresses a1 that couldn't be parsed with others a2, parsed or not, that have the same tokens but for missing ones.

    Indexed by their rarest word with each of their numbers, and probed by the words and the house number of all others."""
    words_of = F.array_distinct(F.filter(F.when(F.col("loose") != "", F.split("loose", " ")).otherwise(F.concat(F.array("num", "street", "kind", "postal"), F.split("town", " "))), lambda x: x != ""))
    tokens = every.select("aid", F.col("loose") != "", words_of).toDF("aid", "is_loose", "tokens")
    each = tokens.select("aid", "is_loose", F.explode("tokens").alias("token"))
    df = each.groupBy("token").agg(F.count("*").cast("double").alias("df"))
    # Only words that stand in an address of that kind are looked at.
    held = each.where("is_loose").select("token").distinct()
    rated = cut(sort_join(sort_join(each, held, "token", "left_semi"), df, "token"))
    number = lambda c: c.rlike("[0-9]")
    numbers = rated.where(number(F.col("token"))).select("aid", F.col("token").alias("number"))
    index = rated.where("is_loose").where(~number(F.col("token"))).groupBy("aid").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    index = sort_join(index, numbers, "aid").select(F.col("aid").alias("a1"), "token", "number")
    probes = sort_join(rated.where(~number(F.col("token"))).select("aid", "token"), numbers, "aid").select(F.col("aid").alias("a2"), "token", "number")
    met = sort_join(index, probes, ["token", "number"]).where("a1 <> a2").select("a1", "a2").distinct()
    full = sort_join(sort_join(each, met.select(F.col("a1").alias("aid")).unionByName(met.select(F.col("a2").alias("aid"))).distinct(), "aid", "left_semi"), df, "token")
    bags = full.groupBy("aid").agg(F.collect_list("token").alias("t"), F.collect_list("df").alias("w"))
    side = lambda k: bags.select(F.col("aid").alias(f"a{k}"), F.col("t").alias(f"t{k}"), F.col("w").alias(f"w{k}"))
    return sort_join(sort_join(met, side(1), "a1"), side(2), "a2").withColumn("total", F.lit(total)).mapInPandas(_loose_links, "a1 long, a2 long")


def _joined(cluster: DataFrame, targets: DataFrame) -> DataFrame:
    """cluster(node, center, ...) after each center of targets(center, t1, t2) with one target only joined that."""
    one = targets.groupBy("center").agg(F.min("t1").alias("t1"), F.max("t2").alias("t2")).where("t1 = t2").select("center", F.col("t1").alias("target"))
    return sort_join(cluster, one, "center", "left").withColumn("center", F.coalesce("target", "center")).drop("target")


def link_addresses(rows: DataFrame, places: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """(row_id, class_id): rows(row_id, street, town, postal, country, whole) that denote one building share a class.

    Where ``whole`` is true, ``street`` holds the address in free text and the other columns are ignored; else they are
    its columns. Units, floors, house names and care-of names don't matter. Rows that are null, blank or a placeholder,
    or hold no number, have no class; those in which no house number and street can be told apart join the one class that
    has all their words. Repeated rows share their class; texts of any length are parsed whole. An address without a town
    joins the one place of its postal code, street and number; if there are several, none. ``places`` settles towns and
    countries; above MAX_REFERENCE entries it is refused. ``regions`` (region) says what to pass over."""
    every = cut(parsed(rows.select("row_id", "street", "town", "postal", "country", "whole"), places, regions))
    every = every.withColumn("aid", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*PARTS, "loose"]]))
    all_ = cut(every.select("aid", *PARTS, "loose").distinct())
    distinct = all_.where("loose = ''").drop("loose")
    total, n_loose = distinct.count(), all_.where("loose <> ''").count()
    met, frequency = candidates(distinct)
    rated = sort_join(distinct, frequency.select(F.col("token").alias("street"), "df"), "street", "left").withColumn("df", F.coalesce("df", F.lit(1).cast("long"))).withColumn("place", F.coalesce("place", F.lit(0).cast("long")))
    side = lambda k: rated.select(F.col("aid").alias(f"a{k}"), *[F.col(c).alias(f"{c}{k}") for c in [*PARTS, "df"]])
    edges = cut(sort_join(sort_join(met, side(1), "a1"), side(2), "a2").withColumn("total", F.lit(total)).mapInPandas(_same, "a1 long, a2 long, what int"))
    label = components(edges.where("what = 2").select(F.col("a1").alias("a"), F.col("a2").alias("b")))
    cluster = cut(sort_join(distinct.withColumnRenamed("aid", "node"), label, "node", "left").withColumn("center", F.coalesce("label", "node")).drop("label"))

    # Addresses without a town that share a postal code with one that has it.
    both = edges.where("what = 1").select(F.col("a1").alias("x"), F.col("a2").alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y")))
    coded = sort_join(sort_join(both, cluster.where("town = ''").select(F.col("node").alias("x"), "center"), "x"), cluster.select(F.col("node").alias("y"), F.col("center").alias("to")), "y").select("center", F.col("to").alias("t1"), F.col("to").alias("t2"))
    # Without a town or a code in common, the same number in the same street and kind of street may join the one town that has it.
    same = ["num", "street", "kind", "dir", "ord"]
    towned = cluster.where("town <> '' and kind <> ''").groupBy(*same, F.col("land").alias("its_land"), (F.col("postal") != "").alias("its_code")).agg(F.min("center").alias("t1"), F.max("center").alias("t2"))
    bare = cluster.where("town = '' and kind <> ''").select(*same, "center", "land", "postal")
    open_ = sort_join(bare, towned, same).where("(land = '' or its_land = '' or land = its_land) and not (postal <> '' and its_code)").select("center", "t1", "t2")
    final = _joined(cluster.select("node", "center"), coded.unionByName(open_))
    if n_loose:
        links = cut(loose_edges(all_, total + n_loose))
        final = cut(final.unionByName(all_.where("loose <> ''").select(F.col("aid").alias("node"), F.col("aid").alias("center"))))
        to = sort_join(links.select(F.col("a1").alias("center"), F.col("a2").alias("node")), final.withColumnRenamed("center", "to"), "node")
        final = _joined(final, to.select("center", F.col("to").alias("t1"), F.col("to").alias("t2")).where("center <> t1"))
    return sort_join(every.select("row_id", "aid"), final.select(F.col("node").alias("aid"), F.col("center").alias("class_id")), "aid").select("row_id", "class_id")
