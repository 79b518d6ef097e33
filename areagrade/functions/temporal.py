"""Timestamp parsing and closed windows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- fixed values: what each pattern letter group of a format matches ---
_SHAPES = {
    "yyyy": "[0-9]{4}",
    "MM": "(?:0[1-9]|1[0-2])",
    "M": "(?:0?[1-9]|1[0-2])",
    "dd": "(?:0[1-9]|[12][0-9]|3[01])",
    "d": "(?:0?[1-9]|[12][0-9]|3[01])",
    "HH": "(?:[01][0-9]|2[0-3])",
    "H": "(?:[01]?[0-9]|2[0-3])",
    "hh": "(?:0[1-9]|1[0-2])",
    "h": "(?:0?[1-9]|1[0-2])",
    "mm": "[0-5][0-9]",
    "ss": "[0-5][0-9]",
    "SSS": "[0-9]{3}",
    "a": "(?:AM|PM|am|pm)",
    "[": "(?:",
    "]": ")?",
}


def format_shape(fmt: str) -> str:
    """Regular expression of the texts a datetime format can read."""
    shape = ""
    for piece in (match.group() for match in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", fmt)):
        if piece in _SHAPES:
            shape += _SHAPES[piece]
        elif piece[0].isalpha():
            raise ValueError(f"unsupported letters {piece!r} in format {fmt!r}")
        else:
            shape += re.escape(piece.strip("'"))
    return f"^{shape}$"


def parse_timestamp(parts: Sequence[Column], formats: Sequence[str]) -> Column:
    """Join the parts by a space and parse with the first format that fits, else NULL.

    Each format is tried only on texts of its shape: a failing parse raises and
    catches an exception, so trying formats in turn on every row would be slow.
    """
    text = F.concat_ws(" ", *(F.trim(part) for part in parts)) if len(parts) > 1 else F.trim(parts[0])
    parsed = [
        F.when(text.rlike(format_shape(fmt)), F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))
        for fmt in formats
    ]
    return F.coalesce(*parsed) if len(parsed) > 1 else parsed[0]


def with_parsed_time(
    df: DataFrame, parts: Sequence[Column], formats: Sequence[str], name: str = "moment"
) -> DataFrame:
    """Add the parsed time and drop the rows without one.

    The explode of a one-element array keeps the optimizer from moving the
    parser into later filters, where it would run again for every comparison.
    """
    parsed = df.select("*", F.explode(F.array(parse_timestamp(parts, formats))).alias(name))
    return parsed.filter(F.col(name).isNotNull())


def in_window(moment: Column, start: datetime, end: datetime) -> Column:
    """``start <= moment <= end``; literals of the column's own type, so it can be pushed down."""
    lower, upper = (F.lit(bound.isoformat(" ")).cast("timestamp_ntz") for bound in (start, end))
    return moment.between(lower, upper)
