"""Native text columns: cleaning, digits, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.settings import ABBREVIATIONS, POSTAL, STATES, SUFFIXES


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def clean_name(c: str | Column, feed: str, word_boundary: bool = False) -> Column:
    """Upper-cased name without one legal suffix. ``word_boundary`` keeps suffixes inside words."""
    pattern = SUFFIXES[feed]
    if word_boundary:
        pattern = pattern.replace(r"(,\s*)?(", r"(,\s*)?\b(", 1)
    return F.upper(F.trim(F.regexp_replace(col(c), "(?i)" + pattern, "")))


def zip5(c: str | Column) -> Column:
    return F.left(digits(c), F.lit(5))


def zip4(c: str | Column) -> Column:
    return F.when(F.length(digits(c)) > 5, F.substring(digits(c), 6, 4))


def mapped(words: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(words, lambda t: F.coalesce(m[t], t))


def tokens(c: str | Column) -> Column:
    """Upper-cased words; runs of white space count as one."""
    return F.filter(F.split(F.upper(F.trim(col(c))), r"\s+"), lambda t: t != "")


def expand(c: str | Column) -> Column:
    return F.array_join(mapped(tokens(c), ABBREVIATIONS), " ")


def postal(c: str | Column) -> Column:
    return F.array_join(mapped(tokens(c), POSTAL), " ")


def state_from_any(c: str | Column) -> Column:
    """A state's code from its name or code in any case; else null."""
    known = F.create_map(*[F.lit(x) for n, v in STATES.items() for x in (n.upper(), v)])
    s = F.upper(F.trim(col(c)))
    return F.coalesce(known[s], F.when(F.length(s) == 2, s))


def present(c: str | Column) -> Column:
    return col(c).isNotNull() & (col(c) != "")


def uuid5_dns(name: Column) -> Column:
    """Name-based UUID (version 5) in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
