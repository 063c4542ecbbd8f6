"""Column expressions that bring dirty fields into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_sequence(c: Column) -> Column:
    """A sequence without any whitespace, in upper case; null stays null."""
    return F.upper(F.regexp_replace(c, r"(?U)\s+", ""))


def clean_id(c: Column) -> Column:
    """An id without blanks at its ends and without one leading ``>`` (and the
    blanks after it); null where nothing is left."""
    x = F.regexp_replace(c, r"(?U)^\s*(>\s*)?|\s+$", "")
    return F.when(x != "", x)


def clean_chr(c: Column) -> Column:
    """A chromosome name as ``chr`` + upper-case rest (``chr7``, ``chrX``); null
    where no name is left."""
    x = F.regexp_replace(F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "^CHR", "")
    return F.when(x != "", F.concat(F.lit("chr"), x))


def score(c: Column) -> Column:
    """A score as DOUBLE, null where it is null, NaN or negative."""
    x = c.cast("double")
    return F.when((x >= 0) & ~F.isnan(x), x)


def gc_fraction(c: Column) -> Column:
    """A GC score as a fraction; a value above 1 is a percentage, rounded to four
    places after division by 100."""
    x = score(c)
    return F.when(x > 1, F.round(x / 100, 4)).otherwise(x)
