"""Category frequencies over several slot columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areagrade.functions.text import cleaned

TOTAL = "total"


def category_frequency(
    df: DataFrame, keys: Sequence[str], kinds: Mapping[str, Sequence[str]], weight: str | None = None
) -> DataFrame:
    """(keys, kind, category, n): filled values counted over all slots of each kind.

    ``kinds`` maps a kind to its slot columns. The scan is read once for all of
    them. ``weight`` names a column that says how many records a row stands for.
    """
    return _count_entries(df, keys, list(kinds.items()), {}, weight)


def category_profile(
    df: DataFrame,
    keys: Sequence[str],
    kinds: Mapping[str, Sequence[str]],
    sums: Mapping[str, Column] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Category frequencies and keyed sums in one pass over the scan.

    As :func:`category_frequency`, with one more row per key of kind ``total``
    and no category, whose ``n`` is the number of records. Every row also has
    the ``sums`` over the records it counts; the key's own are in its total
    row; with a ``weight`` they must already be weighted. The shuffle is keyed by (keys, kind, category) after partial
    aggregation, so one key with most of the rows spreads over its categories.
    """
    return _count_entries(df, keys, [(TOTAL, None), *kinds.items()], sums or {}, weight)


def category_totals(
    df: DataFrame, kinds: Mapping[str, Sequence[str]], weight: str | None = None
) -> DataFrame:
    """(kind, category, n) over all records, most frequent first, ties by name."""
    return category_frequency(df, [], kinds, weight).orderBy(F.desc("n"), "kind", "category")


def profile_totals(profile: DataFrame, count: str, sums: Sequence[str]) -> DataFrame:
    """One list of all totals, (kind, category, n): metrics and categories together.

    The record count and the sums become rows of kind ``metric``. The profile
    is read once: its grand total row is exploded into the metrics, instead of
    being filtered out of one copy and unioned to another.
    """
    rolled = profile.groupBy("kind", "category").agg(
        F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in sums)
    )

    def row(kind: Column, category: Column, n: Column) -> Column:
        return F.struct(kind.alias("kind"), category.alias("category"), n.alias("n"))

    metrics = [(count, F.col("n")), *((name, F.col(name)) for name in sums)]
    metric_rows = F.array(*(row(F.lit("metric"), F.lit(name), value) for name, value in metrics))
    own_row = F.array(row(F.col("kind"), F.col("category"), F.col("n")))
    rows = F.when(F.col("kind") == TOTAL, metric_rows).otherwise(own_row)
    return rolled.select(F.inline(rows)).orderBy(F.desc("n"), "kind", "category")


def two_level_totals(freq: DataFrame, key: str) -> DataFrame:
    """Per-key and global category counts together; the key is NULL in global rows.

    Grouping sets run on the frequencies, not on the scan, so the rows that get
    doubled are already counted.
    """
    return (
        freq.groupingSets([["category", key], ["category"]], "category", key)
        .agg(F.sum("n").alias("n"))
        .select(key, "category", "n")
    )


def _count_entries(
    df: DataFrame,
    keys: Sequence[str],
    kinds: Sequence[tuple[str, Sequence[str] | None]],
    sums: Mapping[str, Column],
    weight: str | None,
) -> DataFrame:
    """Explode each record into (kind, category) entries and aggregate them.

    A kind without slots gives one entry per record. Kinds are numbered while
    they are grouped on and named on the few rows that remain.
    """
    slots = list(dict.fromkeys(slot for _, columns in kinds for slot in columns or ()))
    carried = [*keys, *([weight] if weight else []), *sums]
    # Computed here, below the explode, so once per record and not once per entry.
    records = df.select(
        *keys,
        *([weight] if weight else []),
        *(value.alias(name) for name, value in sums.items()),
        *(cleaned(F.col(slot)).alias(f"_slot_{i}") for i, slot in enumerate(slots)),
    )
    entries = []
    for code, (_, columns) in enumerate(kinds):
        values = [F.lit("")] if columns is None else [F.col(f"_slot_{slots.index(slot)}") for slot in columns]
        entries += [F.struct(F.lit(code).alias("code"), value.alias("category")) for value in values]
    long = records.select(*carried, F.explode(F.array(*entries)).alias("_entry")).filter(
        F.col("_entry.category").isNotNull()
    )
    counted = F.sum(weight) if weight else F.count(F.lit(1))
    kind = F.lit(None).cast("string")
    for code, (name, _) in enumerate(kinds):
        kind = F.when(F.col("_code") == code, name).otherwise(kind)
    return (
        long.groupBy(*keys, F.col("_entry.code").alias("_code"), F.col("_entry.category").alias("category"))
        .agg(counted.alias("n"), *(F.sum(name).alias(name) for name in sums))
        .select(*keys, kind.alias("kind"), F.nullif("category", F.lit("")).alias("category"), "n", *sums)
    )
