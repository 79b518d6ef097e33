"""Counts, rates and whole-number division.

Plain arithmetic on columns rather than array lambdas: higher-order functions
are interpreted, sums of CASE expressions stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from areagrade.functions.text import WHOLE, is_filled


def wide_sum(cells: Iterable[Column]) -> Column:
    """Sum of text cells across a row; blank and non-numeric cells count 0.

    NULL, for the caller to reject, where a cell or the sum does not fit in BIGINT.
    One pattern test per cell: a number too large for the cast is the NULL of the cast.
    """
    zero = F.lit(0).cast("bigint")

    def value(cell: Column) -> Column:
        text = F.trim(cell)
        return F.when(text.rlike(WHOLE), text.try_cast("bigint")).otherwise(zero)

    return reduce(F.try_add, (value(cell) for cell in cells))


def filled_count(cells: Iterable[Column]) -> Column:
    """How many of the text cells of a row are filled."""
    return reduce(add, (is_filled(cell).cast("bigint") for cell in cells))


def whole_div(total: Column, parts: Column | int) -> Column:
    """Truncating division to BIGINT, NULL when ``parts`` is 0."""
    divisor = F.lit(parts) if isinstance(parts, int) else F.nullif(parts, F.lit(0))
    return F.call_function("div", total, divisor)


def rate(events: Column, base: Column, scale: int = 1, digits: int = 2) -> Column:
    """Events per ``scale`` of the base, rounded; NULL when the base is 0."""
    return F.round(F.try_divide(events, base) * scale, digits)


def percent(part: Column, total: Column) -> Column:
    """Share in percent, 0 when the total is 0 or missing."""
    return F.coalesce(F.try_divide(part, total) * 100, F.lit(0.0))
