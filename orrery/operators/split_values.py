"""Several values packed in one field: one row per value, with its position.

Each cell is cut into tokens (delimiters, quotes, brackets, escapes, and the phrases between them). Masking every phrase
by its kind leaves a skeleton of one character per token, in which all that decides the splitting is still visible. The
splitting rule is worked out once per distinct skeleton (in parallel, never on the driver) and joined back, by broadcast
where the measured size of the rules allows it and by a shuffle where not; the items are then cut out by token position
inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import cut, spread

# Name suffixes, legal forms and surname particles, in lower case and without dots.
SUFFIXES = "jr sr ii iii iv phd md esq dds cpa mba obe".split()
LEGAL_FORMS = [
    "inc", "incorporated", "llc", "limited liability company", "ltd", "limited", "corp", "corporation", "co", "company",
    "plc", "public limited company", "gmbh", "gesellschaft mbh", "bv", "besloten vennootschap", "nv", "sa",
    "sociedad anónima", "sociedad anonima", "société anonyme", "as", "a/s", "aktieselskab", "ag", "aktiengesellschaft", "kg", "oy", "ab", "spa", "srl", "sarl", "lp", "llp",
]
PARTICLES = "van von de der den del della di da dos du la le ter ten bin ibn al el st".split()

WORD = r"\p{L}\p{N}.)"
TOKEN = (
    r"(\\u[0-9a-fA-F]{4}|\\.|\"\"|[,;|\t\n\r\"\[\]{}\\]|(?<=\s)/(?=\s)"
    rf"|(?<![{WORD}])'|'(?![\p{{L}}\p{{N}}])"
    rf"|(?:[^,;|\t\n\r\"\[\]{{}}\\'/]|(?<=[{WORD}])'(?=[\p{{L}}\p{{N}}])|(?<!\s)/|/(?!\s))+)"
)
RULE_SCHEMA = "skeleton string, spans array<struct<a:int,n:int,kind:int>>"
#: Rules are broadcast only up to this many characters of skeleton.
BROADCAST_CHARS = 4_000_000


def _kind(t: Column) -> Column:
    """One character for a token: itself for delimiters, e for escapes, D for doubled quotes, else the phrase's kind."""
    x = F.lower(F.trim(t))
    bare = F.regexp_replace(F.regexp_replace(x, r"\s*\([^)]*\)$", ""), r"\.", "")
    one_word = rf"^(?:(?:{'|'.join(PARTICLES)})\.? )*[^\s]+$"
    return (
        F.when(F.length(t).isin(1) & t.rlike(r"""^[,;|\t\n\r"'\[\]{}/]$"""), F.translate(t, "\t\n\r", "|||"))
        .when(t == F.lit('""'), F.lit("D"))
        .when(t.startswith("\\"), F.lit("e"))
        .when(x == "", F.lit(" "))
        .when(bare.isin(SUFFIXES), F.lit("S"))
        .when(bare.isin(LEGAL_FORMS), F.lit("L"))
        .when(x.rlike(r"\d"), F.lit("d"))
        .when(x.rlike(one_word) & ~x.rlike(r"^[^\s]\.$") & ~F.trim(t).rlike(r"_|\p{Ll}{3}\p{Lu}"), F.lit("w"))
        .otherwise(F.lit("W"))
    )


def skeleton(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, _kind), "")


def spans_of(skel: str) -> list[tuple[int, int, int]]:
    """The items of a skeleton as (first token, number of tokens, kind): kind 0 plain, 1 in double, 2 in single quotes."""
    lo, hi = 0, len(skel)
    while lo < hi and skel[lo] == " ":
        lo += 1
    while hi > lo and skel[hi - 1] == " ":
        hi -= 1
    if hi - lo >= 2 and skel[lo] + skel[hi - 1] in ("[]", "{}"):
        lo, hi = lo + 1, hi - 1
    pieces: list[tuple[int, int, int, str]] = []  # first, end, kind, the delimiter before it
    i, before = lo, ";"
    while i <= hi:
        j = i
        while j < hi and skel[j] == " ":
            j += 1
        kind, end = 0, -1
        if j < hi and skel[j] in "\"'":
            end = _closing(skel, j, hi)
            kind = 1 if skel[j] == '"' else 2
        elif j < hi and skel[j] == "D" and re.match(r" *([,;|/]|$)", skel[j + 1 : hi]):
            end, kind = j, 1  # an empty quoted piece
            pieces.append((j, j, 1, before))
        if end >= 0:
            if skel[j] != "D":
                pieces.append((j + 1, end, kind, before))
            i = end + 1
            while i < hi and skel[i] == " ":
                i += 1
        else:
            i = j
            while i < hi and skel[i] not in ",;|/":
                i += 1
            pieces.append((j, i, 0, before))
        before = skel[i] if i < hi else ";"
        i += 1
    return _attached(skel, pieces)


def _closing(skel: str, at: int, hi: int) -> int:
    """The quote that closes the one at ``at``: the next alike before a delimiter or the end; -1 if there is none."""
    q, k = skel[at], at + 1
    while k < hi:
        if skel[k] == q and q == "'" and k + 1 < hi and skel[k + 1] == q:
            k += 2
            continue
        if skel[k] == q and re.match(r" *(?:[,;|/]|$)", skel[k + 1 : hi]):
            return k
        if skel[k] == "D" and q == '"' and re.match(r" *(?:[,;|/]|$)", skel[k + 1 : hi]) and '"' not in skel[k + 1 : hi]:
            return -1
        k += 1
    return -1


def _attached(skel: str, pieces: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int]]:
    """Plain pieces after a comma join the one before where they are a suffix, a legal form or the given names."""
    words = ["".join(skel[a:b]).strip() for a, b, _, _ in pieces]
    solid = [w for w in words if w]
    plain_list = len(solid) >= 3 and len(solid) % 2 == 1 and all(w == "w" for w in solid) and all(p[2] == 0 for p in pieces) and all(p[3] == "," for p in pieces[1:])
    out: list[list] = []
    for (a, b, kind, before), w in zip(pieces, words):
        last = out[-1] if out else None
        if kind == 0 and w and before == "," and last and last[2] == 0 and last[4]:
            if w in ("S", "L"):
                last[1] = b
                continue
            if last[3] == "w" and w[0] in "wW" and not plain_list:
                last[1], last[3] = b, "W"
                continue
        if w:
            out.append([a, b, kind, w, True])
        elif last:
            last[4] = False  # an empty piece ends what can be attached to
    return [(a, b - a, k) for a, b, k, _, _ in out]


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"skeleton": pdf["skeleton"], "spans": [[{"a": a, "n": n, "kind": k} for a, n, k in spans_of(s)] for s in pdf["skeleton"]]})


def _item(tokens: Column, span: Column) -> Column:
    raw = F.array_join(F.slice(tokens, span["a"] + 1, span["n"]), "")
    quoted = F.when(span["kind"] == 1, F.replace(raw, F.lit('""'), F.lit('"'))).when(span["kind"] == 2, F.replace(raw, F.lit("''"), F.lit("'"))).otherwise(raw)
    json = F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>")
    undone = F.coalesce(F.when(span["kind"] == 1, F.try_element_at(json, F.lit(1))), F.regexp_replace(quoted, r"\\(.)", "$1"))
    return F.regexp_replace(F.when(raw.contains("\\"), undone).otherwise(quoted), r"^\s+|\s+$", "")


def split_packed(df: DataFrame, id_col: str, value_col: str, least: int = 1) -> DataFrame:
    """(row_id, pos, item) for each value of each cell of ``value_col`` that holds at least ``least`` values.

    Delimiters are , ; | tab, new line and a slash between blanks, in any mixture, and values may stand in [] or {} and
    in single or double quotes. A surname before its given names, a suffix and a legal form stay with their value.
    ``pos`` counts from 1; empty pieces are skipped; null and blank cells give no rows. Repeated rows each give their
    values. Other columns are ignored, so that clashing names don't matter; texts of any length are cut whole."""
    cells = df.where(F.col(value_col).isNotNull()).select(F.col(id_col).alias("row_id"), F.regexp_extract_all(F.col(value_col).cast("string"), F.lit(TOKEN)).alias("tokens"))
    # One token is at most one value.
    cells = cells.where(F.size("tokens") > (1 if least > 1 else 0)).withColumn("skeleton", skeleton(F.col("tokens")))
    rules = cut(spread(cells.select("skeleton").distinct()).mapInPandas(_rules, RULE_SCHEMA))
    size = rules.agg(F.coalesce(F.sum(F.length("skeleton") + 12 * F.size("spans")), F.lit(0)).alias("n")).first()["n"]
    joined = cells.join(F.broadcast(rules) if size <= BROADCAST_CHARS else rules, "skeleton")
    items = joined.select("row_id", F.filter(F.transform("spans", lambda s: _item(F.col("tokens"), s)), lambda x: x != "").alias("items"))
    return items.where(F.size("items") >= least).select("row_id", F.posexplode("items").alias("p", "item")).select("row_id", (F.col("p") + 1).cast("long").alias("pos"), "item")
