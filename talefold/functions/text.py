"""Column functions on text that follow Unicode where Spark's own do not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)\s+"


def strip(c: Column) -> Column:
    """c without white space at its ends, of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """c stripped, with each run of white space made one blank."""
    return strip(F.regexp_replace(c, BLANKS, " "))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, stripped; a blank one still wins; else ''."""
    return strip(F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit("")))


def norm_key(c: Column) -> Column:
    """What counts as the same item: squeezed and in lower case."""
    return F.lower(squeeze(c))


def digest(*columns: Column) -> Column:
    """SHA-256 of parts joined by a unit separator; null parts are empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def slug(c: Column, longest: int = 80, fallback: str = "note") -> Column:
    """A file name part: runs of other than word characters become '-'."""
    cut = F.substring(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w]+", "-"), r"^-+|-+$", ""), 1, longest)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback))


def occurrences(c: Column, literal: str) -> Column:
    """How often a literal occurs in c, without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("long")
