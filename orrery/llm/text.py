"""String measures shared by the operators of this package."""

from __future__ import annotations

import re
import unicodedata
from collections import OrderedDict
from collections.abc import Callable, Hashable

_LETTERS = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th"})
_OTHER = re.compile("[øæœłđðþ]")

# The commonest combining marks.
_ACCENTS = re.compile("[\u0300-\u036f]+")


def plain(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    t = text.casefold()
    if _OTHER.search(t):
        t = t.translate(_LETTERS)
    t = _ACCENTS.sub("", unicodedata.normalize("NFKD", t))
    return t if t.isascii() else "".join(c for c in t if not unicodedata.combining(c))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours from a to b; most + 1 where there are more than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def grams(text: str, q: int = 2) -> set[str]:
    t = f"{'^' * (q - 1)}{text}{'$' * (q - 1)}"
    return {t[i : i + q] for i in range(len(t) - q + 1)}


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text)


class Remembered:
    """A function with the answers to its latest distinct arguments."""

    def __init__(self, f: Callable, most: int = 200_000):
        self.f, self.most, self.known = f, most, OrderedDict()

    def __call__(self, x: Hashable):
        if x in self.known:
            return self.known[x]
        y = self.known[x] = self.f(x)
        if len(self.known) > self.most:
            self.known.popitem(last=False)
        return y
