"""Text columns: Python's strip, file names, dates, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korpusmill.schema import OTHER_TYPE, WHITE

#: Spellings of a date that are tried in turn.
DATES = ("yyyyMMdd", "yyyy.MM.dd", "yyyy. M. d.", "yyyy. M. d", "yyyy-MM-dd")


def strip(c: Column | str) -> Column:
    """Without the 29 characters at both ends that Python's ``str.strip`` removes; null counts as empty."""
    return F.btrim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(WHITE))


def filled(c: Column | str, default: Column | str | None = None) -> Column:
    """``default`` (a column, or null) for null and empty strings."""
    own = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(own, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def case_type(c: Column | str) -> Column:
    return filled(c, OTHER_TYPE)


def file_stem(name: Column | str) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def slug(path: Column | str) -> Column:
    """A model's path as one name for its stored vectors."""
    return F.replace(F.btrim(path, F.lit("/")), F.lit("/"), F.lit("_"))


def to_day(c: Column | str) -> Column:
    """The date a string spells in one of ``DATES``; null if in none of them."""
    return F.coalesce(*[F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(f)).cast("date") for f in DATES])


def one_line(c: Column | str) -> Column:
    """Tabs and line ends as blanks."""
    return F.translate(c, "\t\n", "  ")


def tokens(c: Column | str) -> Column:
    """Lower-cased words between white space; A-Z only, so that every engine agrees."""
    lowered = F.translate(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, "[ \t\n\u000b\f\r]+"), lambda t: t != "")


def n_tokens(c: Column | str) -> Column:
    """Number of ``tokens``."""
    return F.size(tokens(c)).cast("long")
