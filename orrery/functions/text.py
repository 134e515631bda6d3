"""String functions as Column expressions (all stay inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
# The words that the tag tokenizer drops.
TAG_STOP_WORDS = "and y the a d s ll re ve your yours".split()


def tokens(c: Column) -> Column:
    """The lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}+)"))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"\s+", "") == "")


def default_string(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_no_value(c: Column) -> Column:
    """Blank, 0 or no."""
    return is_blank(c) | F.lower(F.trim(c)).isin("0", "no")


def matches_whole(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def count_matches(c: Column, sub: str) -> Column:
    """Non-overlapping occurrences of sub; 0 for an empty sub or a null text."""
    if not sub:
        return F.lit(0)
    return F.coalesce(((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / len(sub)).cast("int"), F.lit(0))


def join(sep: str, *cs: Column) -> Column:
    return F.concat_ws(sep, *cs)


def abbreviate(c: Column, lower: int, upper: int, suffix: str = "") -> Column:
    """Cut at the first space at or after ``lower``, or at ``upper``, with the suffix where anything was cut."""
    gap = F.locate(" ", c, lower + 1)
    cut_at = F.when(gap == 0, F.lit(upper)).otherwise(F.least(gap - 1, F.lit(upper)))
    return F.when(F.length(c) <= F.least(F.length(c), cut_at), c).otherwise(F.concat(F.substring(c, F.lit(1), cut_at), F.lit(suffix)))


def contains_any(c: Column, chars: str) -> Column:
    return F.length(F.translate(c, chars, "")) < F.length(c)


def contains_none(c: Column, chars: str) -> Column:
    return ~contains_any(c, chars)


def contains_ignore_case(c: Column, sub: str) -> Column:
    return F.lower(c).contains(sub.lower())


def replace_first(c: Column, old: str, new: str, most: int) -> Column:
    """The first ``most`` occurrences of old replaced; all of them for a negative most."""
    if not old or most == 0:
        return c
    if most < 0:
        return F.replace(c, F.lit(old), F.lit(new))
    parts = F.split(c, _quoted(old), most + 1)
    return F.array_join(parts, new)


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def normalize_space(c: Column) -> Column:
    """Runs of white space become their last character, and ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+(?=\s)", ""), r"^\s+|\s+$", "")


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Punct}", "")


def sterilize(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w~/%.:, ]", "")


CLASSES = {
    "alpha": r"\p{L}*", "alpha_space": r"[\p{L} ]*", "alphanumeric": r"[\p{L}\p{N}]*", "alphanumeric_space": r"[\p{L}\p{N} ]*", "ascii_printable": r"[\x20-\x7e]*",
    "numeric": r"\p{Nd}+", "numeric_space": r"[\p{Nd} ]*", "whitespace": r"\s*", "all_lower": r"\p{Ll}+", "all_upper": r"\p{Lu}+",
}


def is_class(c: Column, name: str) -> Column:
    """Whether every character is of the class; numeric, all_lower and all_upper want at least one. False for null."""
    return F.coalesce(c.rlike(f"^{CLASSES[name]}$"), F.lit(False))


def is_number(c: Column) -> Column:
    """Decimals, exponents, hexadecimals and the suffixes l, f and d."""
    return F.coalesce(c.rlike(r"^-?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?|\d+[lL])$"), F.lit(False))


def chunks(c: Column, n: int) -> Column:
    """The text in pieces of n characters; an empty array for an empty text."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c), F.lit(n)), lambda i: F.substring(c, i, F.lit(n)))).when(c.isNotNull(), F.array().cast("array<string>"))


def circular_ngrams(c: Column, n: int) -> Column:
    """One n-gram for each position, going round the end; the text alone if it isn't longer than n."""
    twice = F.concat(c, c)
    return F.when(F.length(c) <= n, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(twice, i, F.lit(n))))


def right_pad(c: Column, n: int, pad: str = " ") -> Column:
    """Padded to n characters, never cut."""
    return F.when(F.length(c) < n, F.rpad(c, n, pad)).otherwise(c)


def csv_normalize(c: Column) -> Column:
    """Separators to blanks, blanks collapsed, quotes escaped; a value of digits and blanks alone is joined."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"[.\\/;#@+)(]", " "), r"\s+", " "))
    t = F.replace(t, F.lit("'"), F.lit("''"))
    return F.when(t.rlike(r"^[\d ]+$"), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t)


def stripped_name(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"\p{Punct}", ""), r"\s+", ""))


def tag_tokens(c: Column) -> Column:
    """Words for the tag index: punctuation to blanks, lower case, stop words between blanks dropped."""
    t = F.regexp_replace(F.lower(c), r"\p{Punct}", " ")
    t = F.regexp_replace(t, rf"(?<= )(?:{'|'.join(TAG_STOP_WORDS)})(?= )", "")
    return F.filter(F.split(F.trim(t), r"\s+"), lambda x: x != "")


def is_valid_entity(name: Column, kind: Column, stripped: Column, key: Column) -> Column:
    """An entity has a name, a stripped name, a phonetic key and one of the types A, O and P."""
    full = [~is_blank(x) for x in (name, stripped, key)]
    return full[0] & full[1] & full[2] & F.coalesce(kind.isin("A", "O", "P"), F.lit(False))


def fill_placeholders(template: str, *values: Column, mark: str = "?") -> Column:
    """The template with each mark replaced by the next value; null values stand as null, also where the template quotes
    them. Marks without a value stay; values without a mark aren't used."""
    pieces = template.split(mark)
    out = [F.lit(pieces[0])]
    for i, piece in enumerate(pieces[1:]):
        text = F.coalesce(values[i].cast("string"), F.lit("null")) if i < len(values) else F.lit(mark)
        out += [F.when(F.lower(text) == "null", F.lit("null")).otherwise(text), F.lit(piece)]
    return F.replace(F.concat(*out), F.lit("'null'"), F.lit("null"))


def random_text(key: Column, n: int, alphabet: str, seed: int = 0) -> Column:
    """n characters of an alphabet, drawn by a hash of the key, so that a retried task draws the same; empty for an empty alphabet."""
    if not alphabet or n <= 0:
        return F.lit("")
    draw = lambda i: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), draw), "")


def greatest_text(*cs: Column) -> Column:
    """The last in lexicographic order; empty where all are null."""
    return F.coalesce(F.array_max(F.array(*cs)), F.lit(""))


def least_text(*cs: Column) -> Column:
    return F.coalesce(F.array_min(F.array(*cs)), F.lit(""))


def by_value(c: Column) -> Column:
    """The entries of a map as an array in the order of their values, equal ones in the order of their keys."""
    order = lambda a, b: F.when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.array_sort(F.map_entries(c), order)


def place_of(sorted_array: Column, value: Column, suggest: bool = False) -> Column:
    """The place from 0 of a value in a sorted array; where it isn't there, -1 or, if asked for, the place where it belongs."""
    before = F.size(F.filter(sorted_array, lambda x: x < value))
    return before if suggest else F.when(F.array_contains(sorted_array, value), before).otherwise(F.lit(-1))
