"""Free-entered values mapped to a canonical list.

A multi-pattern automaton over canonical names and aliases finds those embedded in a value; the longest non-overlapping
mention wins if nothing but decoration is left beside it. Values without one go to a token-set similarity: words that both
have cancel out, and the rest may differ by typing errors, also in where words are parted; over candidates that share
character pairs. The list (of a checked size) goes to the rows, which aren't moved unless they come in too few splits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import Remembered, edits, grams, plain, words
from orrery.session import spread

# What stands beside names without changing which place is meant, and short forms of parts of names.
DECORATION = {
    "city": "city of town municipality municipal mun greater the metro area district region village commune".split(),
    "country": "the of republic rep kingdom state states federation federal democratic people s commonwealth".split(),
}
SHORT_FORMS = {
    "n": ["north", "new"], "nth": ["north"], "no": ["north"], "s": ["south"], "sth": ["south"], "e": ["east"], "w": ["west"], "nw": ["new"], "ft": ["fort"],
    "pt": ["port"], "prt": ["port"], "st": ["saint"], "ste": ["saint"], "snt": ["saint"], "mt": ["mount"], "mnt": ["mount"], "lr": ["lower"], "lwr": ["lower"], "low": ["lower"],
    "up": ["upper"], "upr": ["upper"], "utd": ["united"], "u": ["united"], "nthn": ["northern"], "nrthn": ["northern"],
}
LEADING = "north south east west new port fort saint mount lower upper united northern southern".split()
PLACEHOLDERS = ["n/a", "n.a.", "none", "null", "unknown", "various", "-", "--", "tbc", "tbd", "xxx", "?", "other", "nil", "not known", "not stated"]
#: The list is carried to every task; a longer one isn't what this operator is for.
MAX_REFERENCE = 200_000


def token_set_distance(a: list[str], b: list[str], most: int) -> int:
    """How far two sets of words are apart: what both have doesn't count, the rest by its typing errors in sorted order; at most ``most`` + 1."""
    left, right = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return edits("".join(left), "".join(right), most)


class Matcher:
    """Finds which entries of one kind a text means."""

    def __init__(self, kind: str, places: list[tuple[int, str, str | None, str | None, str | None]]):
        """places: (place_id, place_name, country_code, code3, alt_name)."""
        self.kind, self.decoration = kind, set(DECORATION.get(kind, []))
        self.codes: dict[str, list[int]] = defaultdict(list)
        names: dict[str, set[int]] = defaultdict(set)
        self.country: dict[int, str | None] = {}
        for i, name, code, code3, alt in places:
            self.country[i] = code
            for n in (name, alt):
                if n and (key := " ".join(words(plain(n)))):
                    names[key].add(i)
            if kind == "country":
                for c in (code, code3):
                    if c:
                        self.codes[c.lower()].append(i)
        self.names = {k: sorted(v) for k, v in names.items()}
        self.known_codes = {c.lower() for c in self.country.values() if c} | set(self.codes)
        self.automaton = ahocorasick.Automaton()
        for key in self.names:
            self.automaton.add_word(f" {key} ", key)
        if self.names:
            self.automaton.make_automaton()
        self.compact = {k: "".join(sorted(k.split())) for k in self.names}
        self.postings: dict[str, list[str]] = defaultdict(list)
        for k, c in self.compact.items():
            for g in grams(k.replace(" ", "")) | grams(c):
                self.postings[g].append(k)
        self.of_word: dict[str, set[str]] = defaultdict(set)

    def match(self, value: str) -> tuple[tuple[int, ...], str | None, bool]:
        """(ids meant, the country code the value itself gives, whether it is written exactly); no ids where no entry is meant."""
        low = plain(value).strip()
        if self.kind == "country" and value.strip() not in PLACEHOLDERS and "/" not in low and (got := self.codes.get(re.sub(r"[\W_]+", "", low))):
            return tuple(got), None, True
        if low in PLACEHOLDERS or not any(c.isalpha() for c in low):
            return (), None, True
        parts = [p for p in re.split(r"\s*[,;()\[\]|]\s*|\s+[-–/]\s+", low) if words(p)]
        hint, rest = None, []
        for p in parts:
            if len(parts) > 1 and p in self.known_codes and (self.kind != "country" or rest):
                hint = hint or p.upper()
            else:
                rest.append(p)
        leading = [p for p in rest[1:] if p in LEADING or p in SHORT_FORMS]
        forms = ([f"{leading[0]} {rest[0]}"] if leading else []) + rest
        forms = [" ".join(w for w in words(p) if not re.fullmatch(r"\d+[a-z]?", w)) for p in forms]
        for f in forms:
            for v in self._variants(f):
                if got := self._mention(v):
                    return tuple(self.names[got]), hint, True
        for f in forms[: 1 + bool(leading)]:
            if got := self._similar(f):
                return tuple(self.names[got]), hint, False
        if len(forms) > 1 and (got := self._similar(" ".join(forms[bool(leading) :]))):
            return tuple(self.names[got]), hint, False
        return (), hint, True

    def _variants(self, form: str) -> list[str]:
        """The form, and with each short form spelled out."""
        out, ws = [form], form.split()
        for i, w in enumerate(ws):
            if w in SHORT_FORMS and len(ws) > 1:
                out += [" ".join([*ws[:i], long, *ws[i + 1 :]]) for long in SHORT_FORMS[w]]
        return out

    def _mention(self, form: str) -> str | None:
        """The name embedded in the form, if only decoration is left beside the longest non-overlapping mentions."""
        if not form or not self.names:
            return None
        text = f" {form} "
        found = sorted(((end - len(key) - 1, end, key) for end, key in self.automaton.iter(text)), key=lambda m: (m[0] - m[1], m[0]))
        taken: list[tuple[int, int, str]] = []
        for m in found:
            if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
                taken.append(m)
        if not taken:
            return None
        left = text
        for a, b, _ in sorted(taken, reverse=True):
            left = left[:a] + " " + left[b:]
        return taken[0][2] if all(w in self.decoration for w in left.split()) else None

    def _similar(self, form: str) -> str | None:
        """The one name whose set of words is nearest to the form's, within the typing errors its length allows."""
        best: list[tuple[int, str]] = []
        kept = [w for w in form.split() if w not in self.decoration]
        for v in self._variants(" ".join(kept)) if kept else []:
            best += self._near(v)
        if len(form.split()) > len(kept) == 0:
            return None
        if not best:
            return None
        d, name = min(best)
        return None if any(d2 == d and n2 != name and self.names[n2] != self.names[name] for d2, n2 in best) else name

    def _near(self, form: str) -> list[tuple[int, str]]:
        ws = form.split()
        whole, by_set = "".join(ws), "".join(sorted(ws))
        n = len(whole)
        most = 0 if n < 4 else 1 if n < 6 else 2 if n < 14 else 3
        if not most:
            return []
        shared: dict[str, int] = defaultdict(int)
        own = grams(whole)
        for g in own:
            for k in self.postings.get(g, ()):
                shared[k] += 1
        # One edit changes at most three pairs (a swap).
        least = max(1, len(own) - 3 * most)
        out = []
        for k, c in shared.items():
            if c < least or abs(len(self.compact[k]) - n) > most:
                continue
            d = min(token_set_distance(ws, k.split(), most), edits(whole, k.replace(" ", ""), most))
            if d > 0 and len(ws) > 1:
                d = min(d, edits(by_set, self.compact[k], most))
            if d <= most and self._same_lead(ws, k.split(), d):
                out.append((d, k))
        return out

    @staticmethod
    def _same_lead(ws: list[str], ref: list[str], d: int) -> bool:
        """Whether a leading word such as New stands on both sides or on neither."""
        if d == 0:
            return True
        for a, b in ((ws, ref), (ref, ws)):
            lead = [w for w in a if w in LEADING]
            if lead and len(a) > 1 and not any(edits(lead[0], w, 2) <= 2 for w in b) and not "".join(b).startswith(lead[0][:3]):
                return False
        return True


def map_to_canonical(df: DataFrame, places: DataFrame, kind: str, id_col: str, value_col: str, country_col: str | None = None) -> DataFrame:
    """(row_id, value, place_id) for each non-blank value that isn't literally some place_name; -1 where none is meant.

    ``places`` has place_id, kind, place_name, country_code, code3 and alt_name, and goes to every task; above
    MAX_REFERENCE entries it is refused. Where entries share a name, the country code in the value decides, else the
    row's country (a code, or any writing of a country of the list), else the smallest place_id. Null and blank values
    give no rows; repeated rows each give theirs; other columns of df are ignored."""
    spark = df.sparkSession
    if places.limit(MAX_REFERENCE + 1).count() > MAX_REFERENCE:
        raise ValueError(f"the canonical list has over {MAX_REFERENCE} entries")
    rows = [tuple(r) for r in places.select("place_id", "kind", "place_name", "country_code", "code3", "alt_name").where("place_name is not null").collect()]
    literal = {r[2] for r in rows}
    shared = spark.sparkContext.broadcast((literal, [(r[0], *r[2:]) for r in rows if r[1] == kind], [(r[0], *r[2:]) for r in rows if r[1] == "country"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        literal_, own, countries = shared.value
        matcher, lands = Matcher(kind, own), Matcher("country", countries)
        find, land = Remembered(matcher.match), Remembered(lambda c: _code(lands, c))
        for pdf in batches:
            pdf = pdf[~pdf["value"].isin(literal_)]
            got = []
            for value, country in zip(pdf["value"], pdf["country"]):
                ids, hint, exact = find(value)
                if kind != "country" and ids and (len(ids) > 1 or not exact):
                    there = land(country) if country else None
                    here = [i for i in ids if matcher.country[i] == hint] or [i for i in ids if matcher.country[i] == there]
                    # A typing error is believed only where it doesn't move the place to another country.
                    ids = here or (ids if exact or not (hint or there) else ())
                got.append(ids[0] if ids else -1)
            yield pd.DataFrame({"row_id": pdf["row_id"], "value": pdf["value"], "place_id": pd.Series(got, index=pdf.index, dtype="int64")})

    src = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(value_col).cast("string").alias("value"), (F.col(country_col) if country_col else F.lit(None)).cast("string").alias("country"))
    return spread(src.where(F.col("value").rlike(r"\S"))).mapInPandas(run, "row_id long, value string, place_id long")


def _code(lands: Matcher, country: str) -> str | None:
    exact = country.strip().upper()
    if exact.lower() in lands.known_codes and len(exact) == 2:
        return exact
    ids, _, _ = lands.match(country)
    return lands.country[ids[0]] if ids else None
