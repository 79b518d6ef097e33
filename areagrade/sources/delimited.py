"""Delimited text: quote-aware scans, rejects, and repair of naively split rows."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType, StringType, StructField, StructType

from areagrade.functions.text import WHOLE, cleaned

RAW = "_raw_record"
NUMBER = r"^([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Infinity)$"
CSV_OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "nullValue": ""}
CHECKED_OPTIONS = CSV_OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW}


def read_delimited(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> DataFrame:
    """Typed records of a delimited file; rows that do not fit the schema are left out.

    A row is left out when its number of fields differs from the schema's, a
    number does not parse (blanks around it do not matter) or a number is missing
    that the schema declares not nullable. :func:`read_rejects` returns exactly
    those rows.
    Rows are judged whole: a CSV scan would parse, and so judge, only the
    columns that the rest of the query happens to use.
    """
    return parse_lines(_read_lines(spark, path, header), "value", schema)[0]


def read_rejects(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> DataFrame:
    """The rows :func:`read_delimited` leaves out, as raw text in ``record``."""
    return parse_lines(_read_lines(spark, path, header), "value", schema)[1].withColumnRenamed("value", "record")


def read_positions(
    spark: SparkSession, path: str, positions: Mapping[str, int], header: bool = True
) -> DataFrame:
    """Text columns picked by position from a file whose full width is not declared.

    The first line tells the width (one row comes to the driver); there is no
    inference pass. Rows of another width are left out;
    :func:`read_position_rejects` returns them.
    """
    records = _by_position(spark, path, header)[0]
    return records.select(*(F.col(f"c{at}").alias(name) for name, at in positions.items()))


def read_position_rejects(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The rows :func:`read_positions` leaves out, as raw text in ``record``."""
    return _by_position(spark, path, header)[1].withColumnRenamed("value", "record")


def _by_position(spark: SparkSession, path: str, header: bool) -> tuple[DataFrame, DataFrame]:
    first = spark.read.text(path).filter(F.length(F.trim("value")) > 0).head()
    width = len(next(csv.reader([first["value"]]))) if first else 0
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(max(width, 1))])
    return parse_lines(_read_lines(spark, path, header), "value", schema)


def parse_lines(lines: DataFrame, line: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Parse text lines that are already in a frame into (records, rejects).

    Other columns of the frame are carried along in both results. NULL lines
    are neither. Text keeps its blanks, numbers are read without them.
    """
    names = schema.fieldNames()
    others = [name for name in lines.columns if name != line]
    parsed, fault = judged_lines(lines, line, schema)
    records = parsed.filter(~F.col(fault)).select(*others, *names)
    rejects = parsed.filter(F.col(fault)).select(*others, F.col(line))
    return records, rejects


def judged_lines(lines: DataFrame, line: str, schema: StructType) -> tuple[DataFrame, str]:
    """Every line that is not NULL with its cells as the schema's columns, and the name of a flag:
    whether the line does not fit. All other columns are carried along."""
    names = schema.fieldNames()
    others = [name for name in lines.columns if name != line]
    ddl = ", ".join(f"`{name}` string" for name in [*names, RAW])
    # inline() runs the parser once; a filter over plain fields would run it again.
    cells = F.from_csv(F.col(line), ddl, CHECKED_OPTIONS)
    split = lines.filter(F.col(line).isNotNull()).select(
        *others, F.col(line).alias("_raw_line"), F.inline(F.array(cells)).alias(*names, RAW)
    )
    values, faults = zip(*(_judged(field) for field in schema))
    judged = F.struct(*values, reduce(or_, faults, F.col(RAW).isNotNull()).alias(RAW))
    parsed = split.select(*others, F.col("_raw_line").alias(line), F.inline(F.array(judged)).alias(*names, RAW))
    return parsed, RAW


def _judged(field: StructField) -> tuple[Column, Column]:
    """The value of a text cell in the field's type, and whether it is at fault."""
    cell = F.col(field.name)
    if isinstance(field.dataType, StringType):
        return cell.alias(field.name), F.lit(False) if field.nullable else cell.isNull()
    text = cleaned(cell)
    shape = WHOLE if isinstance(field.dataType, IntegralType) else NUMBER if isinstance(field.dataType, FractionalType) else ".*"
    # The pattern comes first: a failing cast raises and catches an exception.
    value = F.when(text.rlike(shape), text.try_cast(field.dataType))
    fault = text.isNotNull() & value.isNull()
    return value.alias(field.name), fault if field.nullable else fault | text.isNull()


def drop_header_lines(lines: DataFrame, line: str, mark: str) -> DataFrame:
    """Drop every line that contains ``mark``, wherever in the data it stands."""
    return lines.filter(~F.col(line).contains(mark))


def merge_surplus_cells(cells: Column, width: int, at: int) -> Column:
    """Restore a row whose cell ``at`` held commas and was split into several.

    The cells beyond ``width`` are taken to be pieces of that one cell and are
    joined back with the commas; rows shorter than ``width`` become NULL.
    """
    surplus = F.size(cells) - width
    merged = F.array_join(F.slice(cells, F.lit(at + 1), surplus + 1), ",")
    tail = F.slice(cells, F.lit(at + 2) + surplus, F.lit(width - at - 1))
    return F.when(surplus == 0, cells).when(surplus > 0, F.concat(F.slice(cells, 1, at), F.array(merged), tail))


def realign_by_number(cells: Column, text_at: int, number_at: int, others: Mapping[str, int]) -> dict[str, Column]:
    """Read around a split text cell when the row's full width is not known.

    The text starts at ``text_at``; cell ``number_at`` must be a whole number. The
    first whole number at or after that cell tells how many extra pieces the text
    has, however many. Returns the columns ``text``, ``number`` and the ``others``
    (all after the text), NULL where no number follows.
    """
    rest = F.slice(cells, number_at + 1, F.greatest(F.size(cells) - number_at, F.lit(0)))
    found = F.array_position(F.transform(rest, lambda cell: F.trim(cell).rlike("^[0-9]+$")), F.lit(True))
    shift = F.when(found > 0, found.cast("int") - 1)
    columns = {
        "text": F.array_join(F.slice(cells, F.lit(text_at + 1), shift + 1), ","),
        "number": F.trim(F.get(cells, shift + number_at)),
    }
    return columns | {name: F.get(cells, shift + at) for name, at in others.items()}


def sampled(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Sample of about ``fraction`` of the rows, for a first look at a large scan.

    The keys and the seed alone decide, so the rows do not depend on the partitions
    and rows of equal keys stay together. NULL keys count as empty text.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys))
    chance = F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("bigint")
    return df.filter(chance < int(fraction * 2**32))


@contextmanager
def persisted(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a parsed, pruned frame while several actions read it; spills to disk."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def _read_lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """Non-blank lines; with ``header``, without any line equal to the first one."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    first = lines.head() if header else None
    return lines.filter(F.col("value") != first["value"]) if first is not None else lines
