"""Report labels. Numbers stay typed until the last projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_label(n: Column, pct: Column) -> Column:
    """``20: 9.0%`` - the percentage as a whole number."""
    return F.concat(n.cast("string"), F.lit(": "), F.round(pct, 0).cast("string"), F.lit("%"))


def category_label(category: Column, n: Column, pct: Column) -> Column:
    """``VAN: 27: 2.31%``; NULL when there is no category."""
    return F.concat(category, F.lit(": "), n.cast("string"), F.lit(": "), F.round(pct, 2).cast("string"), F.lit("%"))
