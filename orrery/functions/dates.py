"""Dates kept as text or timestamps, and differences between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats a date may be written in, in the order in which they are tried, and units in milliseconds.
FORMATS = [
    "yyyy/MM/dd", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "yyyyMMdd HH:mm:ss", "yyyy-MM-dd HH:mm:ss",
    "MM/dd/yyyy HH:mm", "yyyyMMdd HH:mm", "yyyy-MM-dd HH:mm", "MM/dd/yyyy", "yyyyMMdd",
]
# Further formats, tried after those.
MORE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd-MMM-yyyy", "yyyyMMddHHmmss"]
MILLIS = {"milliseconds": 1, "seconds": 1000, "minutes": 60_000, "hours": 3_600_000, "days": 86_400_000}
DATE_TYPES = ["DOB", "DOD", "INCORPORATED", "DISSOLVED"]
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


# All formats above in figures of a fixed place but the one that runs them all together, for years of four figures; no text
# fits two. The groups as a cast reads them; of any other text only the signs remain, which is no timestamp.
_Y, _D, _HM, _HMS = r"(\d{4})", r"(\d\d)", r"(\d\d:\d\d(?::\d\d)?)", r"(\d\d:\d\d:\d\d)"
_PLAIN = rf"^(?:{_Y}-{_D}-{_D}(?: {_HM}|[Tt]{_HMS})?|{_Y}/{_D}/{_D}(?: {_HMS})?|{_D}/{_D}/{_Y}(?: {_HM})?|{_Y}{_D}{_D}(?: {_HM})?|(?s:.*))\z"
_ISO = "$1$6$12$14-$2$7$10$15-$3$8$11$16 $4$5$9$13$17"
# The others: what a text must have to be one of them.
_SIGNED, _TOGETHER, _NAMED = r"(?:^|[/-])[+-]\d{4}", r"^\d{14}$", r"^\d\d-\D+-\d{4}$"


def _tried(c: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """The timestamp of the first format that fits the whole text; null where none does.

    A format that doesn't fit costs an exception a row, so that the usual ones are told apart by their shape first. The
    lambda holds the text once, and keeps the generated code small enough to be compiled, for many columns too."""
    if formats:
        return _tried(c, formats)

    def one(x: Column) -> Column:
        return F.coalesce(
            F.regexp_replace(x, _PLAIN, _ISO).try_cast("timestamp"),
            F.when(x.rlike(_TOGETHER), _tried(x, ["yyyyMMddHHmmss"])),
            F.when(x.rlike(_NAMED), _tried(x, ["dd-MMM-yyyy"])),
            F.when(x.rlike(_SIGNED), _tried(x, FORMATS + MORE_FORMATS)),
        )

    return F.transform(F.array(c), one)[0]


def format_date(c: Column, pattern: str) -> Column:
    return F.date_format(c, pattern)


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """The whole units between two timestamps, never negative."""
    ms = F.abs(F.unix_millis(b.cast("timestamp")) - F.unix_millis(a.cast("timestamp")))
    return F.floor(ms / MILLIS[unit]).cast("long")


def millis_for(unit: str, n: Column) -> Column:
    return n.cast("long") * MILLIS[unit]


def split_millis(ms: Column) -> Column:
    """h:m:s.ms"""
    h, m, s = F.floor(ms / 3_600_000), F.pmod(F.floor(ms / 60_000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60))
    return F.format_string("%d:%d:%d.%d", h, m, s, F.pmod(ms, F.lit(1000)))


def entity_date(c: Column, kind: str) -> Column:
    """MM/dd/yyyy, with - for what isn't known, as (year, month, day, circa, type); null where it can't be one."""
    if kind not in DATE_TYPES:
        raise ValueError(f"unknown kind of date: {kind}")
    p = F.split(c, "/")
    part = lambda i: F.when(F.try_element_at(p, F.lit(i)) == "-", F.lit("")).otherwise(F.try_element_at(p, F.lit(i)))
    month, day, year = part(1), part(2), part(3)
    good = (F.size(p) == 3) & (F.length(year) >= 4) & ((month == "") | F.coalesce(month.try_cast("int").between(1, 12), F.upper(month).isin(MONTHS))) & ((day == "") | day.try_cast("int").between(1, 31))
    circa = ((month == "") | (day == "")).cast("string")
    return F.when(good, F.struct(year.alias("year"), month.alias("month"), day.alias("day"), circa.alias("circa"), F.lit(kind).alias("type")))
