"""A training-data pipeline of five stages over ``documents``.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areagrade.llm import bpe, leaks, lines, near, toxicity
from areagrade.session import scratch_path
from areagrade.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """Columns under names that no operator adds, whatever ``docs`` brings along."""
    return docs.toDF(*(f"doc__{c}" for c in docs.columns))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"doc__{c}").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below a half stay, null and empty texts too; the model learns from the labels not held out."""
    model = toxicity.trained(spark, sf_dir, docs.select("doc_id", "text"))
    return _back(toxicity.score(_apart(docs), model, "doc__text").where("score < 0.5"), docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without its lines found in ten documents; n_chars follows the text.

    A null text stays null. A text of which nothing is left is empty.
    """
    kept = lines.dedup_lines(_apart(docs), "doc__text")
    changed = F.col("n_dropped") > 0
    n_chars = F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc__n_chars"))
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("doc__text"))
    return _back(kept.withColumns({"doc__n_chars": n_chars, "doc__text": text}), docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, the one of the least id; texts without words stay."""
    return _back(near.drop_near_copies(_apart(docs), "doc__text", "doc__doc_id"), docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, whole, edited or paraphrased, go."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return _back(leaks.drop_leaks(_apart(docs), items, "doc__text"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text; a null text has none."""
    return bpe.op8_bpe(spark, sf_dir, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_copies", drop_near),
    ("decontamination", drop_leaked),
    ("bpe", encode),
]
# Toxicity and the alignment cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
