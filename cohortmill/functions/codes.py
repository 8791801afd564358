"""Classification codes and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def expand_code(code: str | Column) -> Column:
    """Codes meant by a short or wildcard code (``#`` or ``X``), with the dot put in.

    A stem of four or more characters is one code. A shorter stem stands for all its digit
    endings: the three-character code and the one with one digit behind the dot.
    """
    stem = F.regexp_replace(_col(code), "[#X]", "")
    dotted = F.concat(F.substring(stem, 1, 3), F.lit("."), F.substring(stem, 4, 100))
    missing = F.lit(4) - F.length(stem)
    filled = F.transform(
        F.sequence(F.lit(0), (F.pow(F.lit(10), missing) - 1).cast("int")),
        lambda i: F.concat(stem, F.lpad(i.cast("string"), missing, F.lit("0"))),
    )
    both = F.flatten(
        F.transform(
            filled,
            lambda q: F.array(
                F.substring(q, 1, 3),
                F.concat(F.substring(q, 1, 3), F.lit("."), F.substring(q, 4, 100)),
            ),
        )
    )
    return F.when(F.length(stem) >= 4, F.array(dotted)).otherwise(F.array_distinct(both))


def expand_range(code: str | Column) -> Column:
    """``A10-A15`` or ``A10-15`` as its codes, both ends included.

    Numbers are filled up to the width of the lower bound, two digits at least, and never cut.
    """
    c = F.upper(F.trim(_col(code)))
    pattern = r"^([A-Z])(\d+)-[A-Z]?(\d+)"
    low = F.regexp_extract(c, pattern, 2).cast("int")
    high = F.regexp_extract(c, pattern, 3).cast("int")
    width = F.greatest(F.length(F.regexp_extract(c, pattern, 2)), F.lit(2))

    def filled(n: Column) -> Column:
        digits = n.cast("string")
        return F.lpad(digits, F.greatest(width, F.length(digits)), F.lit("0"))

    codes = F.transform(
        F.sequence(low, high),
        lambda n: F.concat(F.regexp_extract(c, pattern, 1), filled(n)),
    )
    return F.when(c.rlike(pattern) & (low <= high), codes).when(
        c.rlike(pattern), F.array().cast("array<string>")
    ).otherwise(F.array(c))


def shift_back(day: str | Column, days: int = 365 * 200) -> Column:
    """Date moved back; the default undoes a shift of 200 years of 365 days."""
    return F.date_sub(_col(day), days)


def epoch(ts: str | Column) -> Column:
    """Seconds since 1970."""
    return F.unix_timestamp(_col(ts))


def parse_time(text: str | Column, *formats: str) -> Column:
    """Timestamp by the first format that fits, null if none does."""
    return F.coalesce(*[F.try_to_timestamp(_col(text), F.lit(f)) for f in formats])
