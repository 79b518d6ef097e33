"""One parse, several outputs: delimited files read once into a table of records and rejects.

The table keeps each line's file and place. So each file's own first line is its header, whatever
the others have, and records, rejects and what a job refuses later all come from one scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import AbstractContextManager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areagrade.session import scratch_path
from areagrade.sources.delimited import judged_lines
from areagrade.sources.files import Folder

RECORD, PARSE = "record", "parse"
PLACE = ("_file", "_block", "_at")
MOST_LINES = 10_000  # of one record
_CELL = r',("[^"]*+(?:""[^"]*+)*+"|[^,"]*+(?=,|$))'


class Staged(AbstractContextManager):
    """A staged input: ``records``, and ``rejects`` by reason as raw text in ``record``.

    The table lies in the shared folder until the context is left or ``close`` is called.
    """

    def __init__(self, table: DataFrame, names: Sequence[str], header: bool, folder: Folder):
        self._table, self._names, self._folder = table, list(names), folder
        self._headers = _headers(table) if header else None

    def _body(self, rows: DataFrame) -> DataFrame:
        """Without the first line of each file and all lines of the file equal to it."""
        if self._headers is None:
            return rows
        return rows.join(self._headers.select("_file", "_hash"), ["_file", "_hash"], "left_anti")

    @property
    def records(self) -> DataFrame:
        return self._body(self._table.where(F.col("_outcome") == RECORD)).select(*self._names)

    def rejects(self, reason: str = PARSE) -> DataFrame:
        return self._body(self._table.where(F.col("_outcome") == reason)).select(F.col("_line").alias("record"))

    def close(self) -> None:
        self._folder.delete()

    def __exit__(self, *error) -> None:
        self.close()


class StagedPositions(Staged):
    """As Staged, where the header's number of cells is the width that each record of its file must have."""

    def _judged(self) -> DataFrame:
        width = F.col("_width")
        if self._headers is None:
            one = self._table.where(F.col("_outcome") == RECORD).agg(F.max("_cells").alias("_width"))
            rows = self._table.withColumn("_width", one.scalar())
        else:
            rows = self._body(self._table).join(self._headers.select("_file", F.col("_cells").alias("_width")), "_file", "left")
        fits = (F.col("_outcome") == RECORD) & F.coalesce(F.col("_cells") == width, F.lit(False))
        return rows.withColumn("_fits", fits)

    @property
    def records(self) -> DataFrame:
        return self._judged().where("_fits").select(*self._names)

    def rejects(self, reason: str = PARSE) -> DataFrame:
        return self._judged().where(~F.col("_fits")).select(F.col("_line").alias("record"))


def landed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, _block, _at, _line): lines that are not blank, with the split they begin in and their order there."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_line"))
    return lines.where(F.length(F.trim("_line")) > 0)


def stage_records(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    header: bool = True,
    derived: Mapping[str, Column] | None = None,
    checks: Mapping[str, Column] | None = None,
    kept: Sequence[str] | None = None,
    multiline: bool = False,
) -> Staged:
    """Read, parse and judge delimited files once.

    ``derived`` columns are worked out on the parsed ones, each once. ``checks`` maps a reason to
    what must be true; the first that is not makes the record a reject of that reason (NULL
    counts as false). A line that does not fit the schema is a reject of reason "parse". ``kept``
    names the columns that records keep (default: all and the derived); raw text is kept for
    rejects only. With ``header`` the first line of each file is left out, and any line of the
    same file that is equal to it. ``multiline`` joins quoted records that span lines first.
    """
    lines, scratch = _lines(spark, path, multiline)
    parsed, fault = judged_lines(lines, "_line", schema)
    if derived:
        values = F.struct(*(value.alias(name) for name, value in derived.items()))
        parsed = parsed.select("*", F.inline(F.array(values)))
    outcome = F.when(F.col(fault), PARSE)
    for reason, holds in (checks or {}).items():
        outcome = outcome.when(~F.coalesce(holds, F.lit(False)), reason)
    names = kept or [*schema.fieldNames(), *(derived or {})]
    rows = parsed.select(
        *PLACE,
        F.xxhash64("_line").alias("_hash"),
        outcome.otherwise(RECORD).alias("_outcome"),
        F.col("_line"),
        *names,
    ).withColumn("_line", F.when(F.col("_outcome") != RECORD, F.col("_line")))
    return Staged(_written(spark, rows, scratch, ["_outcome"]), names, header, scratch)


def stage_positions(
    spark: SparkSession,
    path: str | list[str],
    positions: Mapping[str, int],
    header: bool = True,
    multiline: bool = False,
) -> StagedPositions:
    """Text columns picked by position from files whose width is not declared, read once.

    A record must have as many cells as the header of its own file; without ``header``, as the
    widest line of all. Cells are separated at commas outside quotes; an empty cell is NULL. A line with
    a quote elsewhere than around a whole cell is a reject.
    """
    lines, scratch = _lines(spark, path, multiline)
    cells = F.regexp_extract_all(F.concat(F.lit(","), "_line"), F.lit(_CELL), F.lit(1))
    split = lines.select(*PLACE, "_line", F.inline(F.array(F.struct(cells.alias("_all")))))
    read = F.aggregate("_all", F.lit(0), lambda n, cell: n + F.length(cell) + 1)

    def cell(at: int) -> Column:
        text = F.get("_all", F.lit(at))
        inner = F.replace(F.substr(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(text, F.lit('"')), inner).otherwise(F.nullif(text, F.lit("")))

    rows = split.select(
        *PLACE,
        F.xxhash64("_line").alias("_hash"),
        F.when(read == F.length("_line") + 1, RECORD).otherwise(PARSE).alias("_outcome"),
        F.size("_all").alias("_cells"),
        "_line",
        *(cell(at).alias(name) for name, at in positions.items()),
    )
    return StagedPositions(_written(spark, rows, scratch), list(positions), header, scratch)


def joined_records(lines: DataFrame, most_lines: int = MOST_LINES) -> DataFrame:
    """Landed lines with each quoted record that spans several of them in one row, at its first line.

    A line with an odd number of quotes opens a record or closes it. Whether a line lies inside
    one is told by the odd lines before it: those of earlier splits of its file, added up over one
    row per split, and those of its own split, in order. Only splits that have odd lines or begin
    inside a record are put in order, each for itself, so a file is never read in one task. Parts are
    joined by a line feed. An opening line that nothing closes, and a span of more than ``most_lines``
    lines, is no record: its lines stay single. ``lines`` is read more than once: pass what was written.
    """
    odd = (F.length("_line") - F.length(F.replace("_line", F.lit('"')))) % 2
    marked = lines.withColumn("_odd", odd.cast("long"))
    blocks = marked.groupBy("_file", "_block").agg(F.sum("_odd").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_file")
    blocks = blocks.select("_file", "_block", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("_total"))
    blocks = blocks.where((F.col("_n") > 0) | (F.col("_before") % 2 == 1))
    alone = marked.join(blocks.select("_file", "_block"), ["_file", "_block"], "left_anti").select(*PLACE, "_line")
    order = Window.partitionBy("_file", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    up_to = F.col("_before") + F.sum("_odd").over(order)
    inside = marked.join(blocks, ["_file", "_block"]).withColumn("_up_to", up_to)
    # Open behind this line, or closed by it; the last opening of a file may be closed by nothing.
    opened = F.when(F.col("_up_to") % 2 == 1, (F.col("_up_to") - 1) / 2).when(F.col("_odd") == 1, F.col("_up_to") / 2 - 1).cast("long")
    pair = F.when((F.col("_total") % 2 == 0) | (opened < (F.col("_total") - 1) / 2), opened)
    inside = inside.select(*PLACE, "_line", pair.alias("_pair"))
    single = inside.where(F.col("_pair").isNull()).select(*PLACE, "_line")
    spans = inside.where(F.col("_pair").isNotNull())
    sizes = spans.groupBy("_file", "_pair").agg(F.count(F.lit(1)).alias("_lines"))
    spans = spans.join(sizes, ["_file", "_pair"])
    long = spans.where(F.col("_lines") > most_lines).select(*PLACE, "_line")
    parts = F.array_sort(F.collect_list(F.struct("_block", "_at", "_line")))
    whole = spans.where(F.col("_lines") <= most_lines).groupBy("_file", "_pair").agg(parts.alias("_parts"))
    whole = whole.select(
        "_file",
        F.col("_parts")[0]["_block"].alias("_block"),
        F.col("_parts")[0]["_at"].alias("_at"),
        F.array_join(F.transform("_parts", lambda part: part["_line"]), "\n").alias("_line"),
    )
    return reduce(DataFrame.unionByName, [alone, single, long, whole])


def _headers(table: DataFrame) -> DataFrame:
    """The row of each file's first line: the least place in its first split. One row per file."""
    first = table.where(F.col("_block") == 0).groupBy("_file").agg(F.min("_at").alias("_at"))
    return table.join(first, ["_file", "_at"])


def _lines(spark: SparkSession, path: str | list[str], multiline: bool) -> tuple[DataFrame, Folder]:
    scratch = Folder(spark, scratch_path(spark, "staged"))
    lines = landed_lines(spark, path)
    if not multiline:
        return lines, scratch
    landed = scratch.child("lines").path
    lines.write.parquet(landed)
    return joined_records(spark.read.parquet(landed)), scratch


def _written(spark: SparkSession, rows: DataFrame, scratch: Folder, partition_by: Sequence[str] = ()) -> DataFrame:
    path = scratch.child("rows").path
    rows.write.partitionBy(*partition_by).parquet(path)
    scratch.child("lines").delete()
    return spark.read.schema(rows.schema).parquet(path)
