"""Text cleaning and predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


WHOLE = "^[+-]?[0-9]+$"


def cleaned(text: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def is_filled(text: Column) -> Column:
    """True where the trimmed text is not empty; never NULL."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


def keyword_match(text: Column, include: str, exclude: str | None = None) -> Column:
    """Contains ``include`` and, if given, not ``exclude`` (case-sensitive)."""
    match = text.contains(include)
    return match & ~text.contains(exclude) if exclude is not None else match


def not_ignored(text: Column, ignored: Iterable[str]) -> Column:
    return ~text.isin(*ignored)


def area_key(text: Column, width: int = 5) -> Column:
    """One spelling per area: digits padded with zeros to ``width``, else trimmed.

    Keys longer than ``width`` are left whole (``lpad`` alone would cut them).
    """
    key = cleaned(text)
    return F.when(key.rlike("^[0-9]+$") & (F.length(key) < width), F.lpad(key, width, "0")).otherwise(key)


def whole_number(text: Column) -> Column:
    """Text to BIGINT, NULL when it is not a whole number.

    The pattern comes first because a failing cast raises and catches an
    exception, which costs far more than the row is worth. Leading zeros do not
    count; a number beyond BIGINT is NULL, as :func:`out_of_range` tells.
    """
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(WHOLE), trimmed.try_cast("bigint"))


def out_of_range(text: Column) -> Column:
    """A whole number that does not fit in BIGINT; never NULL."""
    return F.coalesce(F.trim(text).rlike(WHOLE) & whole_number(text).isNull(), F.lit(False))


def numeric_key(text: Column) -> Column:
    """The key as a plain number in text form, leading zeros dropped; NULL if not a number."""
    return whole_number(text).cast("string")


def capitalised(text: Column) -> Column:
    """First letter upper, the rest lower (not every word, as ``initcap`` does)."""
    rest = F.substring(text, F.lit(2), F.length(text))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(rest))


def is_all_upper(text: Column) -> Column:
    """Has letters and none of them is lower case."""
    return (text == F.upper(text)) & (text != F.lower(text))


def kind_by_case(text: Column, upper_kind: str, other_kind: str) -> Column:
    return F.when(is_all_upper(text), upper_kind).otherwise(other_kind)


def ordinal_street(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Give whole-number words their English ordinal ending, after resolving aliases.

    ``WEST 14 ST`` -> ``WEST 14th ST``. One pass per ending: a number whose last
    digit is 1, 2 or 3 takes st, nd or rd unless a 1 stands before it; numbers
    still bare after that take th.
    """
    street = F.trim(name)
    for digit, ending in (("1", "st"), ("2", "nd"), ("3", "rd")):
        street = F.regexp_replace(street, rf"(?<!\S)([0-9]*(?<!1){digit})(?!\S)", f"$1{ending}")
    street = F.regexp_replace(street, r"(?<!\S)([0-9]+)(?!\S)", "$1th")
    for alias, full in (aliases or {}).items():
        street = F.when(F.trim(name) == alias, F.lit(full)).otherwise(street)
    return street
