"""Report writers. Each takes a finished frame; none changes the result."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from contextlib import AbstractContextManager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areagrade.sources.files import Folder

FORMAT_OPTIONS = {
    "csv": {"header": True, "quote": '"', "escape": '"', "emptyValue": ""},
    "json": {"ignoreNullFields": False},
    "text": {},
    "parquet": {},
}


def write_report(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "errorifexists",
    single: bool = False,
    order_by: Sequence[str | Column] = (),
) -> None:
    """Write ``df`` as csv (with header), json, text or parquet.

    One file per partition, so the writing scales with the frame. ``single`` is for
    kinds of reports that are short by construction (k rows, one row per metric or
    category): one file, whose lines are in the order of ``order_by``. The kind of
    report decides, never its size.
    """
    if single:
        df = df.coalesce(1)
        # Sorted after the partitions were joined, which would not keep an order.
        df = df.sortWithinPartitions(*order_by) if order_by else df
    df.write.mode(mode).options(**FORMAT_OPTIONS[fmt]).format(fmt).save(path)


ORDER = "_order"


def write_ordered(df: DataFrame, path: str, order_by: Sequence[str | Column], fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write a report of any length in order: by range, in as many files as it takes.

    A file's number is its place in the order, and rows are in order within each. The folder
    ``_order`` beside the files, which readers of data pass over, lists how many rows stand before
    each file; :func:`read_ordered` numbers the rows by it.
    """
    write_report(df.orderBy(*order_by), path, fmt, mode)
    spark = df.sparkSession
    rows = _with_file(spark.read.schema(df.schema).options(**FORMAT_OPTIONS[fmt]).format(fmt).load(path))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    number = F.regexp_extract("file", r"part-([0-9]+)", 1).cast("int")
    offsets = counts.withColumn("number", number).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets.coalesce(1).write.mode(mode).json(f"{path.rstrip('/')}/{ORDER}")


def read_ordered(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv", place: str = "place") -> DataFrame:
    """The rows of :func:`write_ordered` with their place from 1."""
    rows = _with_file(spark.read.schema(schema).options(**FORMAT_OPTIONS[fmt]).format(fmt).load(path))
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    offsets = spark.read.schema("file string, n bigint, number int, before bigint").json(f"{path.rstrip('/')}/{ORDER}")
    # A file at a time is put in order; files are as large as the partitions they were written from.
    line = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    numbered = rows.withColumn("at", at).withColumn("line", line).join(offsets.select("file", "before"), "file")
    return numbered.select(*schema.fieldNames(), (F.col("before") + F.col("line")).alias(place))


def _with_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.col("_metadata.file_name"))


class ReportSet(AbstractContextManager):
    """Reports that appear together or not at all.

    Inside the context each is written to a staging folder beside the manifest. When the context ends
    well, all take their places and then the manifest is written, which lists them: readers
    that look for the manifest never see half a set, whatever ended the run. A context that ends in
    an error removes what it staged. A run killed while reports took their places left a note of
    them; the next one removes these and the staging folder, and nothing else.
    """

    def __init__(self, spark: SparkSession, manifest: str):
        self.spark, self.reports = spark, {}
        self._manifest, self._note = Folder(spark, manifest), Folder(spark, f"{manifest.rstrip('/')}.publishing")
        self._staging = Folder(spark, f"{manifest.rstrip('/')}.staging-{uuid.uuid4().hex}")
        if self._manifest.exists():
            raise FileExistsError(manifest)
        if self._note.exists():
            note = json.loads(self._note.read_text())
            for path in [*note["reports"], note["staging"]]:
                Folder(spark, path).delete()
            self._note.delete()

    def path(self, final: str) -> str:
        """Where to write the report that is to be at ``final``; nothing may be there."""
        if final in self.reports or Folder(self.spark, final).exists():
            raise FileExistsError(final)
        self.reports[final] = self._staging.child(str(len(self.reports))).path
        return self.reports[final]

    def write(self, df: DataFrame, final: str, **options) -> None:
        write_report(df, self.path(final), **options)

    def __exit__(self, kind, *error) -> None:
        if kind is None:
            self._note.write_text(json.dumps({"reports": [*self.reports], "staging": self._staging.path}))
            for final, staged in self.reports.items():
                place = Folder(self.spark, final)
                Folder(self.spark, final.rstrip("/").rpartition("/")[0] or "/").make()
                Folder(self.spark, staged).move_to(place)
            self._manifest.write_text(json.dumps([*self.reports]))
            self._note.delete()
        self._staging.delete()


def read_manifest(spark: SparkSession, manifest: str) -> list[str]:
    """Where the reports of a published set are; FileNotFoundError if it was not published."""
    folder = Folder(spark, manifest)
    if not folder.exists():
        raise FileNotFoundError(manifest)
    return json.loads(folder.read_text())
