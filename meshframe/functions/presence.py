"""When is a value there? Presence tests, canonical UIDs, stand-ins for missing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts (lower case, trimmed) that merely stand for "no value".
STAND_INS = (
    "#n/a",
    "blank",
    "empty",
    "missing",
    "n.a",
    "n.a.",
    "n/a",
    "n\\a",
    "na",
    "nan",
    "nil",
    "no data",
    "no value",
    "none",
    "not applicable",
    "not available",
    "not known",
    "not set",
    "null",
    "tba",
    "tbc",
    "tbd",
    "undefined",
    "unk",
    "unknown",
    "unspecified",
    "(blank)",
    "(empty)",
    "(none)",
    "(null)",
    "(unknown)",
    "<blank>",
    "<empty>",
    "<none>",
    "<null>",
    "<unknown>",
    "[null]",
)


def canonical_uid(c: Column) -> Column:
    """ASCII letters and digits of c in lower case; null if there are none."""
    return F.nullif(F.lower(F.regexp_replace(c.cast("string"), "[^A-Za-z0-9]+", "")), F.lit(""))


def text_present(c: Column) -> Column:
    """Not null, not blank, not punctuation alone and no stand-in for "no value"; never null."""
    bare = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))
    return F.coalesce(bare.rlike(r"[\p{L}\p{N}]") & ~bare.isin(*STAND_INS), F.lit(False))


def list_present(c: Column) -> Column:
    """Has an entry other than null and NaN; never null."""
    return F.coalesce(F.exists(c, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def number_present(c: Column) -> Column:
    """Neither null nor NaN; zero is a value."""
    return c.isNotNull() & ~F.isnan(c)


def is_defined(c: Column) -> Column:
    """Not null; 0, NaN and "" are defined."""
    return c.isNotNull()


def is_identifier(c: Column) -> Column:
    """Can c be an id: not null, not NaN, not ""? 0 is one. Never null."""
    s = c.cast("string")
    return F.coalesce((s != "") & (s != "NaN"), F.lit(False))


def is_weight_number(c: Column, scalar: Column) -> Column:
    """Is the weight (a list with a flag) a single number? Never null."""
    return F.coalesce(scalar & (F.size(c) == 1), F.lit(False))


def is_weights(c: Column) -> Column:
    """Does the list of weights hold any slot, be it null? Never null."""
    return F.coalesce(F.size(c) > 0, F.lit(False))
