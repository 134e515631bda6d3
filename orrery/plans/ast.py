"""The query tree that all query languages are parsed to, and its compilation to a Column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.text import WORD, tokens


@dataclass(frozen=True)
class Leaf:
    """One test on one field. kind: all, term, prefix, wildcard, regex, fuzzy, phrase, range or number_range."""

    field: str
    kind: str
    value: str = ""
    low: str | None = None
    high: str | None = None
    include_low: bool = True
    include_high: bool = True
    edits: int = 0
    prefix: int = 0
    slop: int = 0
    optional: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Group:
    """Clauses that must, should or must not hold."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    boost: float = 1.0

    def leaves(self) -> list[Leaf]:
        return [x for part in (self.must, self.should) for c in part for x in ([c] if isinstance(c, Leaf) else c.leaves())]


@dataclass(frozen=True)
class Fields:
    """How the fields of a table are searched: text is cut into words, string is one term, int and float are numbers."""

    types: dict[str, str]
    arrays: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def of(cls, df, types: dict[str, str] | None = None) -> Fields:
        """From a DataFrame's columns: texts are text unless ``types`` says string or symbol."""
        known, arrays = {}, set()
        for f in df.schema.fields:
            kind = f.dataType.typeName()
            inner = f.dataType.elementType.typeName() if kind == "array" else kind
            if kind == "array":
                arrays.add(f.name)
            known[f.name] = {"string": "text", "long": "int", "integer": "int", "short": "int", "byte": "int", "double": "float", "float": "float"}.get(inner, "string")
        return cls(known | (types or {}), frozenset(arrays))

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def terms(self, name: str) -> Column:
        """All terms of a field as one array."""
        c, kind = self.column(name), self.types.get(name, "text")
        if name in self.arrays:
            values = F.coalesce(c.cast("array<string>"), F.array().cast("array<string>"))
            return F.flatten(F.transform(values, tokens)) if kind == "text" else values
        if kind == "text":
            return F.coalesce(tokens(c.cast("string")), F.array().cast("array<string>"))
        return F.array(c.cast("string"))


def swaps(word: str) -> list[str]:
    """The word with each two neighbours swapped."""
    return [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1) if word[i] != word[i + 1]]


def fuzzy(t: Column, word: str, edits: int, prefix: int = 0) -> Column:
    """Within so many insertions, deletions, changes and swaps of neighbours."""
    if edits == 0:
        return t == word
    near = F.levenshtein(t, F.lit(word), edits).between(0, edits)
    for s in swaps(word):
        near = near | (F.levenshtein(t, F.lit(s), edits - 1).between(0, edits - 1) if edits > 1 else t == s)
    if edits > 1:
        twice = sorted({u for s in swaps(word) for u in swaps(s)} - {word})
        near = near | t.isin(twice) if twice else near
    return near & (F.substring(t, 1, prefix) == word[:prefix]) if prefix else near


def wild(value: str, one: str) -> str:
    out, i = "", 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value):
            i += 1
            out += re.escape(value[i])
        else:
            out += f"{one}*" if c == "*" else one if c == "?" else re.escape(c)
        i += 1
    return out


def compile_leaf(leaf: Leaf, fields: Fields) -> Column:
    name = leaf.field
    if leaf.kind == "all":
        return F.lit(True)
    if name not in fields.types:
        return F.lit(False)
    kind = fields.types[name]
    if kind == "symbol":
        raise ValueError(f"{name} is stored only and can't be searched")
    c = fields.column(name)
    plain_text = kind == "text" and name not in fields.arrays
    if leaf.kind == "number_range":
        return _number_range(leaf, fields, c)
    if plain_text and leaf.kind in ("term", "prefix", "wildcard"):
        # One pattern over the text, so that no array of words is made.
        body = {"term": re.escape(leaf.value), "prefix": re.escape(leaf.value) + f"{WORD}*", "wildcard": wild(leaf.value, WORD)}[leaf.kind]
        return F.coalesce(F.lower(c.cast("string")).rlike(f"(?<!{WORD}){body}(?!{WORD})"), F.lit(False))
    if plain_text and leaf.kind == "phrase" and leaf.slop == 0:
        body = rf"[^\p{{L}}\p{{N}}_]+".join(map(re.escape, phrase_words(leaf)))
        return F.coalesce(F.lower(c.cast("string")).rlike(f"(?<!{WORD}){body}(?!{WORD})"), F.lit(False))
    terms = fields.terms(name)
    if leaf.kind == "phrase":
        return _phrase(leaf, terms)
    test = {
        "term": lambda t: t == leaf.value,
        "prefix": lambda t: t.startswith(leaf.value),
        "wildcard": lambda t: t.rlike(f"(?s)^{wild(leaf.value, '.')}$"),
        "regex": lambda t: t.rlike(f"^(?:{leaf.value})$"),
        "fuzzy": lambda t: fuzzy(t, leaf.value, leaf.edits, leaf.prefix),
        "range": lambda t: _between(t, leaf),
    }[leaf.kind]
    if leaf.kind == "term" and kind in ("int", "float"):
        as_number = F.lit(leaf.value).try_cast("double")
        return F.coalesce(F.exists(c, lambda x: x == as_number) if name in fields.arrays else c == as_number, F.lit(False))
    if name not in fields.arrays and kind != "text":
        return F.coalesce(test(c.cast("string")), F.lit(False))
    return F.coalesce(F.exists(terms, test), F.lit(False))


def _between(t: Column, leaf: Leaf) -> Column:
    out = F.lit(True)
    if leaf.low:
        out = out & (t >= leaf.low if leaf.include_low else t > leaf.low)
    if leaf.high:
        out = out & (t <= leaf.high if leaf.include_high else t < leaf.high)
    return out & t.isNotNull()


def _number_range(leaf: Leaf, fields: Fields, c: Column) -> Column:
    def test(x: Column) -> Column:
        out = x.isNotNull()
        for bound, low, inclusive in ((leaf.low, True, leaf.include_low), (leaf.high, False, leaf.include_high)):
            if bound not in (None, ""):
                n = F.lit(float(bound) if "." in bound else int(bound))
                out = out & ((x >= n if inclusive else x > n) if low else (x <= n if inclusive else x < n))
        return out

    if fields.types[leaf.field] not in ("int", "float"):
        c = c.try_cast("double") if leaf.field not in fields.arrays else F.transform(c, lambda x: x.try_cast("double"))
    return F.coalesce(F.exists(c, test) if leaf.field in fields.arrays else test(c), F.lit(False))


def phrase_words(leaf: Leaf) -> list[str]:
    return re.findall(r"[^\W]+", leaf.value.lower(), re.UNICODE) or [leaf.value]


def _phrase(leaf: Leaf, terms: Column) -> Column:
    words = phrase_words(leaf)
    n = len(words)
    # The terms are bound once, as the only element of an array, so that no step works them out again.
    if leaf.slop == 0:
        want = F.array(*[F.lit(w) for w in words])

        def follows(t: Column) -> Column:
            last = F.size(t) - n
            return (last >= 0) & F.exists(F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1))), lambda i: F.slice(t, i, n) == want)

        return F.coalesce(F.exists(F.array(terms), follows), F.lit(False))

    def places(t: Column, k: int) -> Column:
        """The places of word k, each less its own in the phrase."""
        word = words[k]
        found = F.filter(F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i"))), lambda x: x["t"] == word)
        return F.transform(found, lambda x: x["i"] - k)

    return F.coalesce(F.exists(F.array(terms), lambda t: F.exists(F.array(F.array(*[places(t, k) for k in range(n)])), lambda at: within_slop(at, n, leaf.slop))), F.lit(False))


def within_slop(at: Column, n: int, slop: int) -> Column:
    """Whether one place of each of n words (an array of arrays, each place less the word's own) can be taken so that they lie within slop."""

    def nested(k: int, low: Column | None, high: Column | None) -> Column:
        def step(p: Column) -> Column:
            lo, hi = (p, p) if low is None else (F.least(low, p), F.greatest(high, p))
            return (hi - lo) <= slop if k == n - 1 else nested(k + 1, lo, hi)

        return F.exists(at[k], step)

    return nested(0, None, None)


def compile_query(node: Leaf | Group, fields: Fields, strict: bool = False) -> Column:
    """A boolean Column. strict: a group of nothing but must_not clauses matches nothing; else it is their negation."""
    if isinstance(node, Leaf):
        return compile_leaf(node, fields)
    both = lambda f, xs: reduce(f, [compile_query(x, fields, strict) for x in xs])
    out = None
    if node.must:
        out = both(lambda a, b: a & b, node.must)
    elif node.should:
        out = both(lambda a, b: a | b, node.should)
    if node.must_not:
        no = ~both(lambda a, b: a | b, node.must_not)
        out = (F.lit(False) if strict else no) if out is None else out & no
    return F.lit(False) if out is None else out
