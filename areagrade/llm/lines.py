"""Line dedup: levelled sorted runs of line keys, compacted periodically.

Everything here is DataFrame code; no Python runs on the executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areagrade.llm.columns import Apart

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    """Lines of a text; null or empty gives one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits, so that keys of a whole corpus do not collide."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


class LineRuns:
    """Counts of line keys, kept as sorted runs of (key hash, documents).

    A run is a table bucketed and sorted by the key hash, so runs are joined and merged
    without another shuffle. ``fanout`` runs of a level are merged into one of the next.
    Keys known to be in at least ``min_docs`` documents move to the settled runs on each
    merge; a new batch is merge-anti-joined with these first, so that a very common line
    is not counted for ever. Runs lie in the warehouse, which all executors share, and are
    dropped when they have been merged; ``close`` drops the rest.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 4, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []

    def add(self, lines: DataFrame) -> None:
        """Count a batch of (h1, h2, docs) and add what is not settled as a run of level 0."""
        fresh = lines.groupBy(*KEY).agg(F.sum("docs").alias("docs"))
        for run in self.settled:
            fresh = fresh.join(self.spark.table(run).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(fresh))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge_up(level)
            level += 1

    def common(self) -> DataFrame:
        """Hashes of the keys found in at least ``min_docs`` documents, as a checkpoint."""
        runs = [run for level in self.levels for run in level]
        found = self._merged(runs).where(F.col("docs") >= self.min_docs).select(*KEY) if runs else None
        for run in self.settled:
            rows = self.spark.table(run).select(*KEY)
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return found.distinct().checkpoint()  # a key may settle from runs of two levels

    def close(self) -> None:
        for run in [run for level in self.levels for run in level] + self.settled:
            self._drop(run)
        self.levels, self.settled = [[]], []

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = self.spark.table(runs[0])
        for run in runs[1:]:
            rows = rows.unionByName(self.spark.table(run))
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"))

    def _merge_up(self, level: int) -> None:
        merged = self._merged(self.levels[level]).checkpoint()
        enough = F.col("docs") >= self.min_docs
        settled, rest = self._write(merged.where(enough)), self._write(merged.where(~enough))
        for run in self.levels[level]:
            self._drop(run)
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(rest)
        self.settled.append(settled)
        if len(self.settled) >= self.fanout:
            rows = self.spark.table(self.settled[0])
            for run in self.settled[1:]:
                rows = rows.unionByName(self.spark.table(run))
            old, self.settled = self.settled, [self._write(rows)]
            for run in old:
                self._drop(run)

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        rows = rows.repartition(self.buckets, *KEY)
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table} PURGE")


def text_id(text: Column) -> Column:
    """Equal texts, and only these, share it; rows need no id of their own."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` rows of ``docs``.

    Adds ``kept_text``, ``n_lines`` (before dropping) and ``n_dropped``; the other columns stay,
    but three of these names in ``docs`` are replaced (in upper or lower case). Keys shorter than ``min_chars`` code
    points stay. The rows go through the runs in ``batches``; which rows are dropped does not
    depend on the number of batches or on the order.

    Each row is a document: rows with equal ids or equal texts count each. A null text is one
    empty line and gives an empty kept text, and so does a text that loses all its lines. An
    empty table gives an empty result.

    What is dropped from a row depends on its text only, so the rows meet their common lines by
    a digest of the text; a text with many copies is split into lines once per batch and its
    copies are counted. Texts without a common line take no part in that join's right side.
    """
    apart = Apart(docs, ("kept_text", "n_lines", "n_dropped"))
    docs, text = apart.rows, apart.of(text)
    keyed = docs.select(text_id(F.col(text)).alias("_text_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def of_text(rows: DataFrame) -> Column:
        keys = F.transform(split_lines(F.col("_text")), line_key)
        return F.array_distinct(F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_chars), key_hash))

    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    try:
        for i in range(batches):
            part = keyed.where(F.pmod(F.conv(F.substring("_text_id", 1, 8), 16, 10).cast("long"), F.lit(batches)) == i)
            lines = part.select(F.explode(of_text(part)).alias("k")).select("k.h1", "k.h2", F.lit(1).cast("long").alias("docs"))
            runs.add(lines)
        common = runs.common()
    finally:
        runs.close()
    hits = (
        keyed.select("_text_id", F.explode(of_text(keyed)).alias("k"))
        .select("_text_id", "k.h1", "k.h2")
        .join(common, KEY, "left_semi")
        .groupBy("_text_id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("_common"))
    )
    lines = split_lines(F.col(text))
    kept = F.filter("_lines", lambda line: ~F.coalesce(F.array_contains("_common", key_hash(line_key(line))), F.lit(False)))
    n, m = F.size("_lines").cast("long"), F.size("_kept").cast("long")
    return (
        docs.withColumn("_text_id", text_id(F.col(text)))
        .join(hits, "_text_id", "left")
        .withColumn("_lines", lines)
        .withColumn("_kept", F.when(F.col("_common").isNull(), F.col("_lines")).otherwise(kept))
        .select(*apart.back(), F.concat_ws("\n", "_kept").alias("kept_text"), n.alias("n_lines"), (n - m).alias("n_dropped"))
    )


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), each AS (
  SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM lines
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), judged AS (
  SELECT r, doc_id, line, pos, k IN (SELECT k FROM common) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
